"""HTTP contracts from source files."""

import pytest

from larchgraph import api
from larchgraph.extract import calls as C
from larchgraph.extract import http as H
from larchgraph.operators import radar as R

FILES = {
    "web/a.ts": "fetch(`/shop/carts/${id}`, {headers: {Authorization: t}});\nfetch('/shop/carts', {method: 'POST', body: JSON.stringify({name, 'age': 1})});\nfetch(url);\nconst api = axios.create({baseURL: 'https://h.com/shop'});\napi.delete('/carts/7');\naxios.get('/none');",
    "srv/app.js": "import carts from './carts';\nconst app = express();\napp.use('/shop', carts);\n",
    "srv/carts.js": "const router = express.Router();\nrouter.get('/carts/:id', requireAuth, (req, res) => { res.json({id, name}); });\nrouter.post('/carts', (req, res) => {\n  save(req.body.name, req.body.mail);\n  res.status(201).json({ok: true});\n});\nexport default router;\n",
    "app/(x)/items/[id]/route.ts": "export async function GET() {}\nexport const DELETE = 1;",
    "srv/carts.test.js": "await request(app).get('/shop/carts/3');\nfetch('/shop/carts');",
}


def frame(spark, files, project="p"):
    return spark.createDataFrame([(project, p, c) for p, c in files.items()], "project_id string, path string, content string")


def test_contracts(spark):
    files = frame(spark, FILES | {"x.md": None, "y.js": None})
    rows = H.parsed(files)
    clients = H.clients(rows)
    got = {(r["method"], r["path"]): r for r in clients.collect()}
    assert set(got) == {("GET", "/shop/carts/:dynamic"), ("POST", "/shop/carts"), ("DELETE", "/shop/carts/7"), ("GET", "/none")}
    assert got["GET", "/shop/carts/:dynamic"]["auth"] == "present" and got["POST", "/shop/carts"]["request_fields"] == ["age", "name"]
    routes = H.routes(rows)
    found = {(r["method"], r["path"]): r for r in routes.collect()}
    assert set(found) == {("GET", "/shop/carts/:id"), ("POST", "/shop/carts"), ("GET", "/items/:id"), ("DELETE", "/items/:id")}
    post = found["POST", "/shop/carts"]
    assert (post["request_fields"], post["response_fields"], post["statuses"], post["auth"]) == (["mail", "name"], ["ok"], [201], "absent")
    assert found["GET", "/shop/carts/:id"]["auth"] == "required" and found["GET", "/shop/carts/:id"]["response_fields"] == ["id", "name"]
    assert [r["expression"] for r in H.unknowns(rows).collect()] == ["fetch(url)"]
    m = R.matches(clients, routes)
    kinds = sorted(r["kind"] for r in R.status_issues(clients, routes, m).collect() if r["severity"] == "error")
    assert kinds == ["method-mismatch", "missing-route"]
    assert {(r["kind"], r["detail"]) for r in R.drift(clients, routes, m).collect()} == {("request-schema-mismatch", "mail")}
    assert sorted(r["n_tests"] for r in R.coverage(routes, H.observations(rows)).collect()) == [0, 0, 0, 1]


MORE = {
    "pay/use.ts": "async function pay() {\n  const answer = await fetch('/pay/orders', { method: 'POST', body: JSON.stringify({ sum: 1 }) });\n  if (answer.status === 200) done();\n  const body = await answer.json();\n  return body.receipt;\n}\nclient.get(u); axios.get(u); fetch('/a', { method: verb });",
    "pay/server.ts": "import express from 'express'; import stock from '../stock/plugin'; import fastify from 'fastify';\nconst app = express();\napp.post('/pay/orders', verifyToken, (req, res) => { log(req.body.sum, req.body.card); return res.status(201).json({ id: 1 }); });\napp.use('/x', missing); app.get(where, h); app.get('title');\napp.route('/pay/state').get(h).put(h);\nconst f = fastify(); f.register(stock, { prefix: '/stock' }); f.register(gone); f.register(async (fastify) => { fastify.get('/inline', h); }, { prefix: '/in' });",
    "stock/plugin.ts": "export default async function stock(fastify) { fastify.get('/items/:id', async (_q, reply) => reply.code(200).send({ left: 1 })); }",
    "desk/desk.controller.ts": "@Controller('desk')\nclass Desk {\n  @UseGuards(Team) @Post('open') @HttpCode(202) open(@Body() form: any) { if (form.kind) return { ticket: form.kind, by: { a: 1 } }; }\n  @Get() all() { return { list: [] }; }\n  @All() rest() { return 1; }\n}",
    "typed/a.ts": "export function routes(app: Express) { app.get('/typed', h); }",
    "broken.ts": "const a = {",
}


def test_more_frameworks_and_unknowns(spark):
    radar = api.contract_radar(frame(spark, MORE))
    routes = {(r["framework"], r["method"], r["path"]): (r["request_fields"], r["response_fields"], r["statuses"], r["auth"]) for r in radar.routes.collect()}
    assert routes == {
        ("express", "POST", "/pay/orders"): (["card", "sum"], ["id"], [201], "required"), ("express", "GET", "/pay/state"): ([], [], [], "absent"), ("express", "GET", "/typed"): ([], [], [], "absent"),
        ("fastify", "GET", "/stock/items/:id"): ([], ["left"], [200], "absent"), ("fastify", "GET", "/in/inline"): ([], [], [], "absent"),
        ("nest", "POST", "/desk/open"): (["kind"], ["by", "ticket"], [202], "required"), ("nest", "GET", "/desk"): ([], ["list"], [200], "absent"),
    }
    assert sorted((r["side"], r["reason"]) for r in radar.unknowns.collect()) == sorted([("client", "dynamic-axios-url"), ("client", "method-unknown"), ("server", "unresolved-mount"), ("server", "dynamic-route-path"), ("server", "unresolved-plugin"), ("server", "syntax-error")])
    [client] = radar.clients.collect()
    assert (client["response_fields"], client["statuses"], client["auth"]) == (["receipt"], [200], "absent")
    assert {r["kind"] for r in radar.drift.collect()} == {"request-schema-mismatch", "response-schema-mismatch", "missing-auth", "status-mismatch"}
    counts = radar.summary.first().asDict()
    assert (counts["client_calls"], counts["server_routes"], counts["matches"], counts["missing_auth"], counts["routes_without_tests"], counts["unknowns"], counts["no_local_consumers"]) == (1, 7, 1, 1, 7, 6, 6)
    gate = radar.gate.first()
    assert (gate["passed"], gate["errors"], gate["unknowns"]) == (False, 4, 6)
    kinds = [r["kind"] for r in radar.issues.collect()]
    assert kinds == sorted(kinds)


def test_matching_contract_passes_and_order_does_not_matter(spark):
    files = {
        "c.ts": "import axios from 'axios';\nconst api = axios.create({ baseURL: '/pay' });\nasync function go() { const r = await api.post('/orders', { sum: 1 }, { headers: { authorization: t } }); if (r.status == 201) log(r.data.id); }",
        "s.ts": "import express from 'express'; const app = express(); app.post('/pay/orders', guard, (req, res) => { use(req.body.sum); res.status(201).json({ id: 1 }); });",
        "s.test.ts": "import { app } from './s';\nit('x', () => request(app).post('/pay/orders'));",
    }
    radar = api.contract_radar(frame(spark, files))
    again = api.contract_radar(frame(spark, dict(reversed(files.items()))))
    assert radar.gate.first()["passed"] and radar.issues.collect() == again.issues.collect() == []
    assert [(r["file"], r["line"]) for r in radar.covered_by.collect()] == [("s.test.ts", 2)]
    assert radar.routes.collect() == again.routes.collect() and radar.summary.collect() == again.summary.collect()


def test_no_scripts_are_one_unknown(spark):
    radar = api.contract_radar(frame(spark, {"a.py": "x"}))
    assert [r["reason"] for r in radar.unknowns.collect()] == ["no-script-files"] and not radar.gate.first()["passed"]
    assert api.contract_radar(frame(spark, {"a.py": "x"}), allow_unknown=True).gate.first()["passed"]


def test_the_first_of_equal_paths_stays(spark):
    df = spark.createDataFrame([("p", "./a.ts", "2", 2), ("p", "a.ts", "1", 1), ("p", "/a.ts", "3", 3)], "project_id string, path string, content string, ordinal int")
    assert [r["content"] for r in H.scripts(df).collect()] == ["1"]
    assert [r["content"] for r in H.scripts(df.drop("ordinal")).collect()] == ["2"]


@pytest.mark.parametrize("source", ["", "f(", "a ? f(1) : { b: 2 }", "x = /[(]/.test(y)", "`${`${f(1)}`}`", "@Dec", "class { @A() b() {} }", "<div>don't</div>", "a\u2028b(c)", "f(...x, , )"])
def test_calls_of_odd_sources(source):
    assert C.calls_of(source)[0]["fact"] == "file"
