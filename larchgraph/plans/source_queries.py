"""Extraction, resolution and contract queries over sources that the pages are laid out as.

Each page is a file of one of seven languages, and a client and a server of HTTP; how many branches,
calls and routes a file has follows from the page, so SQL can say what extraction must find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larchgraph import api
from larchgraph.extract import facts as X
from larchgraph.extract import http as H
from larchgraph.functions import paths as P
from larchgraph.functions.tables import stored, table
from larchgraph.operators import files as FI
from larchgraph.operators import graph as G
from larchgraph.operators import policy as PO
from larchgraph.operators import radar as R
from larchgraph.operators import resolve as V
from larchgraph.plans import contract_queries as CQ
from larchgraph.sources import corpus as S

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _fill(text: str, n: str = ""):
    """text with {i}, {j}, {k}, {url} and {path} of the page; {n} is the text `n`, page_id % 4 times."""
    out, values = [], {"i": F.col("page_id"), "j": F.col("page_id") - 35, "k": F.col("page_id") + 7, "url": F.col("url"), "path": F.col("web")}
    for part in text.replace("{n}", "\u0001n\u0001").split("\u0001"):
        if part == "n":
            out.append(F.repeat(_fill(n), (F.col("page_id") % 4).cast("int")))
            continue
        for piece in part.replace("{", "\u0002{").replace("}", "}\u0002").split("\u0002"):
            out.append(values[piece[1:-1]].cast("string") if piece[1:-1] in values and piece.startswith("{") else F.lit(piece))
    return F.concat(*out)


# --- seven languages ---------------------------------------------------------------------------------

_JS = """// {url}
import './f{k}'; // import './no{i}'
function f{i}(a) {
  const s = "if (a) {";
  const r = /[{]if/.test(s);
{n}  return `x${h{i}(a)} if (`;
}
const h{i} = async (b) => { do { b--; } while (b && s); await f{i}(b); p.catch(b); return shared(b); };
class C{i} { constructor() { if (a) { f{i}(1); } } m(x) { return x ? f{i}(x) : other{i}(x); } }
"""
_PY = """def g{i}(x):
    if x and x > 1:
        return [y for y in x if y]
    return k{i}(x)
def k{i}(x):
    return {call}(x)
class K{i}:
    def run(self): return self.stop()
    def stop(self): return g{i}(1)
"""
_TEXTS = {
    "java": ("java/J{i}.java", "// {url}\nclass J{i} { int a(int x) { {n}do { x--; } while (x > 0); return b(x); } int b(int x) { return this.a(x) + K.c(x); } }\n", "if (x > 0) { b(x); } "),
    "go": ("go/g{i}.go", "package m\n// {url}\nfunc (s *S{i}) Run(x int) { {n}help{i}(x) }\nfunc (s *S{i}) help() { for { } }\nfunc help{i}(x int) { switch x { case 1: case 2: } }\n", "if x > 0 { s.help() }; "),
    "c": ("c/c{i}.c", "/* {url} */\nint add{i}(int a) { {n}return a ? 1 : 2; }\nint main{i}() { do { } while (0); return add{i}(1); }\n", "if (a) { a++; } "),
    "cpp": ("cpp/x{i}.cpp", "// {url}\nclass X{i} { public: int go(int a) { try { return run(a); } catch (int e) { return 0; } } int run(int a) { return a; } };\nint free{i}(X{i}* p) { {n}return X{i}::make(1); }\n", "while (p) { p->run(1); } "),
    "csharp": ("cs/s{i}.cs", "// {url}\nclass S{i} { int A(int x) { foreach (var y in z) { {n}} return this.B(x); } int B(int x) { switch (x) { case 1: return 1; default: return 2; } } }\n", "if (x > 1) { B(x); } "),
}


def sources(spark, d):
    """source_files of seven languages by page_id % 7; every eleventh one is broken."""
    pages = table(spark, d, "pages").select("page_id", "url", P.http_path(F.col("url")).alias("web"))
    i = F.col("page_id")
    js = F.concat(F.when(i % 13 == 0, "#!/usr/bin/env node\n").otherwise(""), _fill(_JS, "  if (a) { h{i}(a); }\n"), F.when(i % 2 == 0, "function shared(q) { return [q].map(z => z ? 1 : 2); }\n").otherwise(""), F.when(i % 3 == 0, _fill("export { f{i}, h{i} as g };\n")).otherwise(""))
    py = F.concat(_fill("# {url}\n"), F.when(i >= 35, _fill("from .m{j} import g{j}\n" + _PY.replace("{call}", "g{j}"))).otherwise(_fill(_PY.replace("{call}", "len"))))
    path, content = F.when(i % 7 == 0, _fill("src/f{i}.js")).when(i % 7 == 1, F.concat(F.lit("py/pkg"), i % 5, _fill("/m{i}.py"))), F.when(i % 7 == 0, js).when(i % 7 == 1, py)
    for k, (p, text, n) in enumerate(_TEXTS.values(), 2):
        path, content = path.when(i % 7 == k, _fill(p)), content.when(i % 7 == k, _fill(text, n))
    files = pages.select(F.lit("p").alias("project_id"), path.alias("path"), F.concat(content, F.when(i % 11 == 0, "\n( {").otherwise("")).alias("content"))
    packages = pages.filter("page_id % 7 = 1").select(F.lit("p").alias("project_id"), F.concat(F.lit("py/pkg"), i % 5, F.lit("/__init__.py")).alias("path"), F.lit("").alias("content")).distinct()
    return files.unionByName(packages)


_S = "s AS (SELECT page_id AS i, page_id % 4 AS n, page_id % 7 AS l, CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END AS sb, CASE WHEN page_id >= 35 THEN 1 ELSE 0 END AS im FROM pages WHERE page_id % 11 <> 0)"
_P = {0: "'src/f' || i || '.js'", 1: "'py/pkg' || (i % 5) || '/m' || i || '.py'", 2: "'java/J' || i || '.java'", 3: "'go/g' || i || '.go'", 4: "'c/c' || i || '.c'", 5: "'cpp/x' || i || '.cpp'", 6: "'cs/s' || i || '.cs'"}
_DEFS = [
    (0, "'f' || i", "3 + sb", "1 + n"), (0, "'h' || i", "8 + sb + n", "3"), (0, "'C' || i || '.m'", "9 + sb + n", "2"), (0, "CASE WHEN i % 2 = 0 THEN 'shared' END", "10 + sb + n", "1"),
    (1, "'g' || i", "2 + im", "5"), (1, "'k' || i", "6 + im", "1"), (1, "'K' || i || '.run'", "9 + im", "1"), (1, "'K' || i || '.stop'", "10 + im", "1"),
    (2, "'J' || i || '.a'", "2", "2 + n"), (2, "'J' || i || '.b'", "2", "1"), (3, "'S' || i || '.Run'", "3", "1 + n"), (3, "'S' || i || '.help'", "4", "2"), (3, "'help' || i", "5", "3"),
    (4, "'add' || i", "2", "2 + n"), (4, "'main' || i", "3", "2"), (5, "'X' || i || '.go'", "2", "2"), (5, "'X' || i || '.run'", "2", "1"), (5, "'free' || i", "3", "1 + n"),
    (6, "'S' || i || '.A'", "2", "2 + n"), (6, "'S' || i || '.B'", "2", "3"),
]
_FUNCTIONS = f"{_S}, fn AS (" + " UNION ALL ".join(f"SELECT {_P[k]} AS file, {name} AS display, {line} AS line, {c} AS complexity FROM s WHERE l = {k}" for k, name, line, c in _DEFS) + ")"
_CALLS_OF = [
    (0, "'f' || i", "'h' || i", "n + 1", "call", None), (0, "'h' || i", "'f' || i", "1", "async", None), (0, "'h' || i", "CASE WHEN i % 2 = 0 THEN 'shared' END", "1", "call", None), (0, "'C' || i || '.m'", "'f' || i", "1", "call", None),
    (1, "'g' || i", "'k' || i", "1", "call", "same-file"), (1, "'K' || i || '.run'", "'K' || i || '.stop'", "1", "call", "exact"), (1, "'K' || i || '.stop'", "'g' || i", "1", "call", "same-file"),
    (2, "'J' || i || '.a'", "'J' || i || '.b'", "n + 1", "call", "exact"), (2, "'J' || i || '.b'", "'J' || i || '.a'", "1", "call", "exact"),
    (3, "'S' || i || '.Run'", "CASE WHEN n > 0 THEN 'S' || i || '.help' END", "n", "call", "exact"), (3, "'S' || i || '.Run'", "'help' || i", "1", "call", "same-file"),
    (4, "'main' || i", "'add' || i", "1", "call", "same-file"), (5, "'X' || i || '.go'", "'X' || i || '.run'", "1", "call", "exact"), (6, "'S' || i || '.A'", "'S' || i || '.B'", "n + 1", "call", "exact"),
]
_EDGES = f"{_S}, ed AS (" + " UNION ALL ".join(
    f"SELECT {_P[k]} || '#' || {a} AS src, {_P[k]} || '#' || {b} AS dst, CAST({n} AS BIGINT) AS cnt, '{kind}' AS kind, {'NULL' if r is None else repr(r)} AS resolution FROM s WHERE l = {k}" for k, a, b, n, kind, r in _CALLS_OF
) + f" UNION ALL SELECT a.p || '#k' || a.i, b.p || '#g' || b.i, 1, 'call', 'import' FROM (SELECT i, {_P[1]} AS p FROM s WHERE l = 1) a JOIN (SELECT i, {_P[1]} AS p FROM s WHERE l = 1) b ON b.i = a.i - 35)"


def _facts(spark, d):
    return stored(X.extract(sources(spark, d)))


@query(f"WITH {_FUNCTIONS} SELECT file || '#' || display AS id, CAST(line AS INT) AS line, CAST(complexity AS INT) AS complexity FROM fn WHERE display IS NOT NULL")
def source_functions(spark, d):
    return V.functions(_facts(spark, d)).select("id", "line", "complexity")


@query(f"WITH {_EDGES} SELECT * FROM ed WHERE dst IS NOT NULL")
def source_calls(spark, d):
    return V.edges(V.calls(_facts(spark, d))).select("src", "dst", "cnt", "kind", "resolution")


@query(f"WITH {_EDGES} SELECT coalesce(resolution, 'by-name') AS resolution, count(*) AS n FROM ed WHERE dst IS NOT NULL GROUP BY 1")
def resolution_histogram(spark, d):
    return G.resolutions(V.edges(V.calls(_facts(spark, d)))).drop("project_id")


@query(f"""WITH a AS (SELECT page_id AS i, page_id % 4 AS n, page_id % 7 AS l, page_id % 11 = 0 AS bad FROM pages), f AS ({" UNION ALL ".join(f"SELECT i, n, l, bad, {p} AS path FROM a WHERE l = {k}" for k, p in _P.items())})
SELECT path, ['js', 'python', 'java', 'go', 'c', 'cpp', 'csharp'][l + 1] AS lang, CASE WHEN l = 0 AND i % 3 = 0 AND NOT bad THEN 2 ELSE 0 END AS exports, l = 0 AND i % 13 = 0 AS shebang, bad AS parse_error,
 CAST(CASE WHEN bad THEN 1 ELSE 0 END + CASE l WHEN 0 THEN 10 + n + CASE WHEN i % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END WHEN 1 THEN 11 + CASE WHEN i >= 35 THEN 1 ELSE 0 END WHEN 2 THEN 3 WHEN 3 THEN 6 WHEN 4 THEN 4 WHEN 5 THEN 4 ELSE 3 END AS INT) AS loc FROM f
UNION ALL SELECT DISTINCT 'py/pkg' || (page_id % 5) || '/__init__.py', 'python', 0, false, false, 0 FROM pages WHERE page_id % 7 = 1""")
def source_file_facts(spark, d):
    return _facts(spark, d).filter("fact = 'file'").select("path", "lang", "exports", "shebang", "parse_error", "loc")


@query(f"WITH {_S} SELECT {_P[0]} AS path, './f' || (i + 7) AS spec FROM s WHERE l = 0")
def import_specs(spark, d):
    return api._file_facts(_facts(spark, d))[1].select("path", "spec")


@query(f"""WITH {_S}, j AS (SELECT i, {_P[0]} AS path FROM s WHERE l = 0), f AS (SELECT page_id AS i, 'src/f' || page_id || '.js' AS path FROM pages WHERE page_id % 7 = 0)
SELECT f.path, CASE WHEN f.i % 11 = 0 THEN 'parse-error' WHEN f.i % 13 = 0 THEN 'entry' WHEN p.i IS NULL THEN 'possibly-unused' ELSE 'ok' END AS verdict, CAST(CASE WHEN p.i IS NULL THEN 0 ELSE 1 END AS BIGINT) AS imported_by,
 CAST(CASE WHEN f.i % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM f t WHERE t.i = f.i + 7) THEN 1 ELSE 0 END AS BIGINT) AS n_unresolved FROM f LEFT JOIN j p ON p.i = f.i - 7""")
def source_import_health(spark, d):
    return api.import_health(sources(spark, d)).select("path", "verdict", "imported_by", "n_unresolved")


@query(f"WITH {_S} SELECT {_P[1]} AS path, p || 'pkg' || (i % 5) || '.m' || i AS module FROM (SELECT page_id AS i, page_id % 7 AS l FROM pages) s, (SELECT unnest(['', 'py.']) AS p) WHERE l = 1 UNION ALL SELECT DISTINCT 'py/pkg' || (page_id % 5) || '/__init__.py', p || 'pkg' || (page_id % 5) FROM pages, (SELECT unnest(['', 'py.']) AS p) WHERE page_id % 7 = 1")
def python_modules(spark, d):
    return V.python_modules(_facts(spark, d)).select("path", "module")


# --- contracts -------------------------------------------------------------------------------------------

_CLIENTS = [
    "fetch('{url}');",
    "const go = (x) => fetch(`/t{i}/${x}/end?q=1`, { method: 'POST', headers: { Authorization: k }, body: JSON.stringify({ b: 1, a: { c: 2 } }) });",
    "import axios from 'axios';\naxios.delete('/x{i}/');",
    "// fetch('/no')\nfetch(where);",
    "const api = axios.create({ baseURL: '/base' });\napi.put('/y{i}', { z: 1 }, opts);",
    "async function f() {\n const r = await fetch('{path}');\n if (r.status === 404) stop();\n const d = await r.json();\n return d.name + d.items;\n}",
]
_SERVERS = [
    [("srv/s{i}.ts", "import express from 'express';\nconst app = express();\napp.get('{path}', requireAuth, (req, res) => res.status(200).json({ name: 1 }));\napp.all('/any{i}/*', h);")],
    [("srv/s{i}.ts", "import { Router } from 'express';\nconst router = Router();\nrouter.post('/t/:id/end', (req, res) => { save(req.body.a, req.body.b); res.sendStatus(201); });\nexport default router;"),
     ("srv/m{i}.ts", "import express from 'express';\nimport r from './s{i}';\nconst app = express();\napp.use('/v{i}', r);\napp.use('/lost', nothing);")],
    [("srv/s{i}.ts", "export default async function p(fastify) {\n fastify.put('/y{i}', async (q, reply) => reply.code(204).send({ ok: 1 }));\n}"),
     ("srv/m{i}.ts", "import fastify from 'fastify';\nimport p from './s{i}';\nconst app = fastify();\napp.register(p, { prefix: '/base' });")],
    [("srv/s{i}.ts", "@Controller('/x{i}')\n@UseGuards(G)\nclass C{i} { @Delete() @HttpCode(204) drop(@Body() b: any) { return { id: b.key }; } }")],
    [("src/app/(g)/n{i}/[id]/route.ts", "export async function GET() { return 1; }\nexport const PATCH = 1;")],
]


def web_sources(spark, d):
    """Clients by page_id % 6, servers by page_id % 5, and tests of every fourth page; script files."""
    pages = table(spark, d, "pages").select("page_id", "url", P.http_path(F.col("url")).alias("web"))
    files = []
    for k, text in enumerate(_CLIENTS):
        files.append((f"page_id % 6 = {k}", "web/c{i}.ts", text))
    for k, parts in enumerate(_SERVERS):
        files += [(f"page_id % 5 = {k}", p, text) for p, text in parts]
    files.append(("page_id % 4 = 0", "web/c{i}.test.ts", "await request(app).get('{path}');\nfetch('/t{i}');"))
    files.append(("page_id % 17 = 0", "web/bad{i}.ts", "function ("))
    made = F.array(*[F.when(F.expr(when), F.struct(_fill(p).alias("path"), _fill(text).alias("content"))) for when, p, text in files])
    return pages.select(F.lit("p").alias("project_id"), F.inline(F.filter(made, lambda x: x.isNotNull())))


_W = f"{CQ._PATHS}, w AS (SELECT page_id AS i, path AS p FROM paths)"
_WEB = f"""{_W}, cl AS (
 SELECT i, 'GET' AS method, p AS path, 1 AS line, 'fetch' AS framework, 'exact' AS confidence, '' AS req, '' AS res, '' AS st, 'absent' AS auth FROM w WHERE i % 6 = 0
 UNION ALL SELECT i, 'POST', '/t' || i || '/:dynamic/end', 1, 'fetch', 'pattern', 'a,b', '', '', 'present' FROM w WHERE i % 6 = 1 UNION ALL SELECT i, 'DELETE', '/x' || i, 2, 'axios', 'exact', '', '', '', 'absent' FROM w WHERE i % 6 = 2
 UNION ALL SELECT i, 'PUT', '/base/y' || i, 2, 'axios', 'exact', 'z', '', '', 'unknown' FROM w WHERE i % 6 = 4 UNION ALL SELECT i, 'GET', p, 2, 'fetch', 'exact', '', 'items,name', '404', 'absent' FROM w WHERE i % 6 = 5),
rt AS (SELECT i, 'GET' AS method, p AS path, 'srv/s' || i || '.ts' AS file, 3 AS line, 'express' AS framework, 'exact' AS confidence, '' AS req, 'name' AS res, '200' AS st, 'required' AS auth FROM w WHERE i % 5 = 0
 UNION ALL SELECT i, 'ANY', '/any' || i || '/*', 'srv/s' || i || '.ts', 4, 'express', 'exact', '', '', '', 'absent' FROM w WHERE i % 5 = 0 UNION ALL SELECT i, 'POST', '/v' || i || '/t/:id/end', 'srv/s' || i || '.ts', 3, 'express', 'exact', 'a,b', '', '201', 'absent' FROM w WHERE i % 5 = 1
 UNION ALL SELECT i, 'PUT', '/base/y' || i, 'srv/s' || i || '.ts', 2, 'fastify', 'exact', '', 'ok', '204', 'absent' FROM w WHERE i % 5 = 2 UNION ALL SELECT i, 'DELETE', '/x' || i, 'srv/s' || i || '.ts', 3, 'nest', 'exact', 'key', 'id', '204', 'required' FROM w WHERE i % 5 = 3
 UNION ALL SELECT i, m, '/n' || i || '/:id', 'src/app/(g)/n' || i || '/[id]/route.ts', CASE m WHEN 'GET' THEN 1 ELSE 2 END, 'next', 'pattern', '', '', '', 'absent' FROM w, (SELECT unnest(['GET', 'PATCH']) AS m) WHERE i % 5 = 4),
ob AS (SELECT i, p AS path, 1 AS line FROM w WHERE i % 4 = 0 UNION ALL SELECT i, '/t' || i, 2 FROM w WHERE i % 4 = 0),
uk AS (SELECT 'client' AS side, 'web/c' || i || '.ts' AS file, 2 AS line, 'fetch(where)' AS expression, 'dynamic-fetch-url' AS reason FROM w WHERE i % 6 = 3 UNION ALL SELECT 'server', 'srv/m' || i || '.ts', 5, 'app.use(''/lost'', nothing)', 'unresolved-mount' FROM w WHERE i % 5 = 1
 UNION ALL SELECT 'server', 'web/bad' || i || '.ts', 1, 'web/bad' || i || '.ts', 'syntax-error' FROM w WHERE i % 17 = 0)"""
_SEG = "list_filter(string_split({}, '/'), lambda x: x <> '')"
_PAIRS = f"""pr AS (SELECT c.i AS ci, r.i AS ri, r.method AS rm, r.path AS rp, r.method = 'ANY' OR r.method = c.method AS ok, c.req AS creq, c.res AS cres, c.st AS cst, c.auth AS cauth, r.req AS rreq, r.res AS rres, r.st AS rst, r.auth AS rauth FROM (SELECT *, {_SEG.format('path')} AS s FROM cl) c JOIN (SELECT *, {_SEG.format('path')} AS s FROM rt) r
 ON CASE WHEN list_contains(r.s, '*') THEN len(c.s) >= len(r.s) - 1 ELSE len(c.s) = len(r.s) END AND len(list_filter(range(1, len(r.s) + 1), lambda k: NOT (r.s[k] = '*' OR c.s[k] = r.s[k] OR starts_with(c.s[k], ':') OR starts_with(r.s[k], ':')))) = 0)"""
_LACKS = "len(list_filter(string_split({a}, ','), lambda x: x <> '' AND NOT list_contains(string_split({b}, ','), x))) > 0"


def _joined(df, *cols):
    return df.select(*cols, *[F.array_join(F.col(c).cast("array<string>"), ",").alias(a) for c, a in (("request_fields", "req"), ("response_fields", "res"), ("statuses", "st"))], "auth")


def _web(spark, d):
    return H.parsed(web_sources(spark, d))


@query(f"WITH {_WEB} SELECT method, path, 'web/c' || i || '.ts' AS file, line, framework, confidence, req, res, st, auth FROM cl")
def http_clients(spark, d):
    return _joined(H.clients(_web(spark, d)), "method", "path", "file", "line", "framework", "confidence")


@query(f"WITH {_WEB} SELECT method, path, file, line, framework, confidence, req, res, st, auth FROM rt")
def http_routes(spark, d):
    return _joined(H.routes(_web(spark, d)), "method", "path", "file", "line", "framework", "confidence")


@query(f"WITH {_WEB} SELECT 'GET' AS method, path, 'web/c' || i || '.test.ts' AS file, line FROM ob")
def http_observations(spark, d):
    return H.observations(_web(spark, d)).select("method", "path", "file", "line")


@query(f"WITH {_WEB} SELECT * FROM uk")
def http_unknowns(spark, d):
    return H.unknowns(_web(spark, d)).drop("project_id")


@query(f"WITH {_W} SELECT 'srv/m' || i || '.ts#app' AS parent, 'srv/s' || i || '.ts#' || CASE i % 5 WHEN 1 THEN 'router' ELSE 'fastify' END AS child, CASE i % 5 WHEN 1 THEN '/v' || i ELSE '/base' END AS prefix FROM w WHERE i % 5 IN (1, 2)")
def http_mounts(spark, d):
    return H.mounts(_web(spark, d)).drop("project_id")


@query(f"WITH {_W} SELECT 'srv/' || f || i || '.ts' AS path, v AS var, k AS framework FROM w JOIN (VALUES (0, 's', 'app', 'express'), (1, 's', 'router', 'express'), (1, 'm', 'app', 'express'), (2, 's', 'fastify', 'fastify'), (2, 'm', 'app', 'fastify')) t(m, f, v, k) ON i % 5 = m")
def http_receivers(spark, d):
    return H.receivers(_web(spark, d)).drop("project_id")


@query(f"""WITH {_WEB}, {_PAIRS}, ok AS (SELECT * FROM pr WHERE ok), tested AS (SELECT DISTINCT r.i, r.method, r.path FROM (SELECT *, {_SEG.format('path')} AS s FROM rt) r JOIN (SELECT *, {_SEG.format('path')} AS s FROM ob) o
 ON r.method IN ('GET', 'ANY') AND CASE WHEN list_contains(r.s, '*') THEN len(o.s) >= len(r.s) - 1 ELSE len(o.s) = len(r.s) END AND len(list_filter(range(1, len(r.s) + 1), lambda k: NOT (r.s[k] = '*' OR o.s[k] = r.s[k] OR starts_with(r.s[k], ':')))) = 0)
SELECT (SELECT count(*) FROM cl) AS client_calls, (SELECT count(*) FROM rt) AS server_routes, (SELECT count(*) FROM ok) AS matches, (SELECT count(*) FROM cl WHERE i NOT IN (SELECT ci FROM pr)) AS missing_routes,
 (SELECT count(*) FROM cl WHERE i IN (SELECT ci FROM pr) AND i NOT IN (SELECT ci FROM ok)) AS method_mismatches, (SELECT count(*) FROM ok WHERE {_LACKS.format(a='rreq', b='creq')}) AS request_schema_mismatches,
 (SELECT count(*) FROM ok WHERE rres <> '' AND {_LACKS.format(a='cres', b='rres')}) AS response_schema_mismatches, (SELECT count(*) FROM ok WHERE rauth = 'required' AND cauth = 'absent') AS missing_auth,
 (SELECT count(*) FROM ok WHERE rst <> '' AND {_LACKS.format(a='cst', b='rst')}) AS status_mismatches, (SELECT count(*) FROM rt r WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ri = r.i AND rm = r.method AND rp = r.path)) AS no_local_consumers,
 (SELECT count(*) FROM tested) AS routes_with_tests, (SELECT count(*) FROM rt) - (SELECT count(*) FROM tested) AS routes_without_tests, (SELECT count(*) FROM uk) AS unknowns""")
def radar_summary(spark, d):
    return api.contract_radar(web_sources(spark, d)).summary.drop("project_id")


@query(f"WITH {CQ._ENDPOINTS} SELECT rt.id, p.client_id AS observation_id FROM rt JOIN pairs p ON p.route_id = rt.id AND method_ok AND CAST(p.client_id AS BIGINT) % 6 = 0")
def covered_by(spark, d):
    c, r = CQ._endpoints(spark, d)
    seen = c.filter(F.col("id").cast("bigint") % 6 == 0).withColumns({"file": F.lit("t"), "line": F.lit(1)})
    return R.covered_by(r, seen).select("id", "observation_id")


@query(f"WITH {CQ._ENDPOINTS} SELECT severity, kind, count(*) AS n FROM iss GROUP BY ALL")
def issues_by_severity(spark, d):
    c, r = CQ._endpoints(spark, d)
    return R.by_severity(R.status_issues(c, r, R.matches(c, r))).drop("project_id")


# --- files, paths, saved projects -------------------------------------------------------------------------


@query(f"WITH RECURSIVE {CQ._FGRAPH} SELECT count(*) AS files, (SELECT count(*) FROM fe) AS edges, (SELECT count(*) FROM (SELECT scc FROM scc GROUP BY scc HAVING count(*) > 1)) + (SELECT count(*) FROM good WHERE path = target) AS cycles, count(*) FILTER (in_cycle) AS files_in_cycle, count(*) FILTER (reason IS NOT NULL) AS entries, count(*) FILTER (reason IS NULL AND imported_by = 0) AS orphans, (SELECT count(*) FROM lost) AS unresolved_imports FROM fnodes")
def file_graph_summary(spark, d):
    files, specs = CQ._page_files(spark, d)
    found, lost = (stored(x) for x in FI.resolve(specs, files))
    nodes, edges = (stored(x) for x in FI.file_graph(files, found))
    return FI.graph_summary(nodes, edges, found, lost).drop("project_id")


_NAMED = "named AS (SELECT page_id, ['src/', 'Node_Modules/', './a\\b/', '/dist/x/'][page_id % 4 + 1] || 'f' || page_id || ['.ts', '.d.ts', '.spec.jsx', '.PY', '.mts', '.md', '.config.js'][page_id % 7 + 1] AS p, url FROM pages)"


def _named(spark, d):
    i = F.col("page_id")
    of = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % n + 1).cast("int"))
    p = F.concat(of(["src/", "Node_Modules/", "./a\\b/", "/dist/x/"], 4), F.lit("f"), i, of([".ts", ".d.ts", ".spec.jsx", ".PY", ".mts", ".md", ".config.js"], 7))
    return table(spark, d, "pages").select("page_id", p.alias("p"), "url")


@query(f"""WITH {_NAMED}, n AS (SELECT *, regexp_replace(regexp_replace(replace(p, '\\', '/'), '^\\./', ''), '^/', '') AS q FROM named) SELECT page_id, q AS path, regexp_matches(q, '{P.SOURCE_NAME}') AND NOT regexp_matches(q, '{P.DECLARATION}') AS is_source, regexp_matches(q, '{P.SCRIPT_NAME}') AS is_script,
 len(list_intersect(string_split(lower(q), '/'), [{", ".join(f"'{x}'" for x in P.IGNORED_DIRS)}])) > 0 AS is_ignored, regexp_matches(q, '{P.TEST_NAME}') AS is_test, q || '#f' AS fid, 'f#g' AS name, CASE WHEN length(url) <= 30 THEN url ELSE substr(url, 1, 27) || '…' END AS short FROM n""")
def path_functions(spark, d):
    q = P.normal_path(F.col("p"))
    name = P.function_name(F.concat("p", F.lit("#f#g")))
    return _named(spark, d).select(
        "page_id", q.alias("path"), P.is_source(q).alias("is_source"), q.rlike(P.SCRIPT_NAME).alias("is_script"), P.is_ignored(q).alias("is_ignored"), P.is_test(q).alias("is_test"),
        P.function_id(F.concat(F.lit(" "), "p", F.lit("#f"))).alias("fid"), name.alias("name"), P.short_text(F.col("url"), 30).alias("short"),
    )


@query(f"WITH {_NAMED} SELECT DISTINCT path FROM (SELECT regexp_replace(regexp_replace(replace(p, '\\', '/'), '^\\./', ''), '^/', '') AS path FROM named) WHERE NOT regexp_matches(path, '{P.SCRIPT_NAME}')")
def unsupported_files(spark, d):
    return PO.unsupported(_named(spark, d).select(P.normal_path(F.col("p")).alias("path")))


def _saved(spark, d):
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 200).alias("k")).agg(F.min("event_id").cast("string").alias("id"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")).drop("k")


_SAVED = "saved AS (SELECT CAST(min(event_id) AS VARCHAR) AS id, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id % 200)"


@query(f"WITH {_SAVED} SELECT * FROM saved")
def saved_list(spark, d):
    return S.listed(_saved(spark, d))


@query(f"WITH {_SAVED} SELECT * FROM saved WHERE id = '4'")
def saved_lookup(spark, d):
    return S.lookup(_saved(spark, d), "4")


@query(f"WITH {_SAVED} SELECT * FROM saved WHERE id NOT IN ('0', '4')")
def saved_delete(spark, d):
    return S.deleted(_saved(spark, d), ["0", "4"])
