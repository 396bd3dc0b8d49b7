"""Paths, files, policies, contracts, joins and sources on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from larchgraph.functions import paths as P
from larchgraph.operators import files as FI
from larchgraph.operators import joins as J
from larchgraph.operators import policy as PO
from larchgraph.operators import radar as R
from larchgraph.sources import corpus as S


def values(spark, f, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    return [r["v"] for r in df.select("i", f(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]


def test_relative_join(spark):
    rows = [("src/a/b.ts", "./c"), ("src/a/b.ts", "../c/./d"), ("b.ts", "../../x"), ("src/b.ts", "/y//z"), ("a/b/c.ts", "..")]
    assert values(spark, P.join_relative, *rows) == ["src/a/c", "src/c/d", "x", "src/y/z", "a"]


def test_http_path(spark):
    rows = [(x, "") for x in ("", "/", " a//b/ ", "https://h.com/x/?q#f", "https://h.com", "HTTP://h/a\\b", "/p?x", "p#y", None)]
    assert values(spark, lambda a, b: P.http_path(a), *rows) == ["/", "/", "/a/b", "/x", "/", "/a/b", "/p", "/p", None]
    rows = [(x, "") for x in ("\t/a\n", "http://h/a/./b/../c/", "https://u:p@h:80/x", "http://", "http://a b/x", "https://h:port/", "http://[::1]:8/y", "/a/../b")]
    assert values(spark, lambda a, b: P.http_path(a), *rows) == ["/a", "/a/c", "/x", None, None, None, "/y", "/a/../b"]


def test_names_and_labels(spark):
    assert values(spark, lambda a, b: P.function_name(a), ("a.ts#b#c", ""), ("plain", "")) == ["b#c", "plain"]
    assert values(spark, lambda a, b: P.function_id(a), (" ./a\\b.ts#f ", ""), ("f", "")) == ["a/b.ts#f", "f"]
    assert values(spark, lambda a, b: P.short_text(a, 5), ("a  \n b", ""), ("abcdefg", "")) == ["a b", "ab\u2026"]
    assert values(spark, lambda a, b: P.clean_label(a, "none", 4), ("\x01a\nbcdef ", ""), (" \t", ""), (None, "")) == ["a bc", "none", "none"]
    assert values(spark, lambda a, b: P.local_path(a, "/home/x"), ("/home/x/a.ts", ""), ("C:\\b.ts", ""), ("./c.ts", "")) == ["a.ts", "b.ts", "c.ts"]
    assert values(spark, lambda a, b: P.module_path(a), ("/a/b/", ""), ("./c", "")) == ["a/b", "c"]


def test_paths_match(spark):
    rows = [("/api/users/7", "/api/users/:id"), ("/api/:dynamic", "/api/me"), ("/a", "/a/*"), ("/a/b/c", "/a/*"), ("/a/b", "/a/:x/c"), ("/b", "/a/*"), ("/", "/"), ("/x", "/")]
    assert values(spark, lambda a, b: P.paths_match(P.segments(a), P.segments(b)), *rows) == [True, True, True, True, False, False, True, False]


def test_entry_reasons(spark):
    rows = [(x, "") for x in ("src/index.ts", "a/b.test.tsx", "vite.config.ts", "x/bin/run.js", "lib/tool.ts", "server.mjs")]
    assert values(spark, lambda a, b: P.entry_reason(a, F.lit(False)), *rows) == ["entry-name", "test", "config", "bin", None, "entry-name"]


def file_rows(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "project_id string, path string, exports int, shebang boolean, parse_error boolean")


def specs_of(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "project_id string, path string, spec string")


def test_import_health(spark):
    files = file_rows(spark, [("index.ts", 0, False, False), ("used.ts", 1, False, False), ("orphan.ts", 1, False, False), ("bad.ts", 0, False, True), ("run.ts", 0, True, False)])
    imports, lost = FI.resolve(specs_of(spark, [("index.ts", "./used"), ("index.ts", "./gone"), ("index.ts", "react"), ("index.ts", "./x.css"), ("bad.ts", "./orphan")]), files)
    got = {r["path"]: r for r in FI.health(files, imports, lost).collect()}
    assert {k: v["verdict"] for k, v in got.items()} == {"index.ts": "entry", "used.ts": "ok", "orphan.ts": "possibly-unused", "bad.ts": "parse-error", "run.ts": "entry"}
    assert got["orphan.ts"]["confidence"] == 80 and got["used.ts"]["imported_by"] == 1
    assert [r["spec"] for r in lost.collect()] == ["./gone"]
    order = [r["path"] for r in FI.health_order(FI.health(files, imports, lost)).collect()]
    assert order == ["orphan.ts", "bad.ts", "used.ts", "index.ts", "run.ts"]


def test_file_graph(spark):
    files = file_rows(spark, [("main.ts", 0, False, False), ("x/a.ts", 1, False, False), ("y/a.ts", 1, False, False), ("self.ts", 0, False, False)])
    imports, _ = FI.resolve(specs_of(spark, [("x/a.ts", "../y/a"), ("y/a.ts", "../x/a"), ("main.ts", "./x/a"), ("self.ts", "./self")]), files)
    nodes, edges = FI.file_graph(files, imports)
    got = {r["path"]: (r["in_cycle"], r["kind"], r["label"], r["imported_by"]) for r in nodes.collect()}
    assert got == {"main.ts": (False, "entry", "main.ts", 0), "x/a.ts": (True, "normal", "x/a.ts", 2), "y/a.ts": (True, "normal", "y/a.ts", 1), "self.ts": (True, "orphan", "self.ts", 0)}
    assert FI.file_cycles(nodes, edges, imports).collect()[0]["cycles"] == 2


def facts(spark, before, after):
    rows = [(side, k, v) for side, every in (("before", before), ("after", after)) for x, v in every for k in ((x, "script") if x == "file" else (x,))]
    return spark.createDataFrame(rows, "snapshot_id string, kind string, key string")


BASE = [("file", "a.js"), ("file", "b.js"), ("function", "a.js#main"), ("function", "b.js#helper")]


@pytest.mark.parametrize(
    ("after", "policy", "status", "failed"),
    [
        (BASE, {"preserve_functions": ("b.js#helper",)}, "pass", []),
        ([*BASE, ("unresolved", "a.js -> ./x")], {}, "fail", ["unresolved-import-budget"]),
        (BASE[:3], {}, "fail", ["removed-functions-declared"]),
        (BASE[:3], {"allow_functions": (" b.js#helper ",)}, "pass", []),
        ([*BASE, ("cycle-file", "a.js"), ("cycle-function", "a.js#main")], {}, "fail", ["file-cycle-budget", "function-cycle-budget"]),
        ([*BASE, ("hotspot", "a.js#main")], {"max_new_hotspots": 1}, "pass", []),
        ([*BASE, ("parse-error", "b.js")], {}, "unknown", []),
        ([("file", "a.js"), ("parse-error", "a.js")], {}, "fail", ["removed-files-declared"]),
    ],
)
def test_policy(spark, after, policy, status, failed):
    checked = PO.checks(facts(spark, BASE, after), PO.Policy(**policy))
    assert PO.overall(checked).first()["status"] == status
    assert sorted(r["id"] for r in checked.filter("status = 'fail'").collect()) == failed
    assert checked.count() == 9
    gate = PO.change_gate(checked, allow_unknown=True).first()
    assert gate["exit_code"] == (1 if failed else 0)


def test_policy_limits_and_digest():
    with pytest.raises(ValueError):
        PO.Policy(max_new_hotspots=-1)
    assert json.loads(PO.Policy(allow_files=("b", " a", "a")).text)["allow_files"] == ["a", "b"]


def test_fingerprint_ignores_row_order(spark):
    rows = [("before", "a", "1"), ("before", "b", "2"), ("after", "a", "1")]
    make = lambda rs: PO.fingerprint(spark.createDataFrame(rs, "snapshot_id string, path string, content string").repartition(3), PO.Policy()).first()[0]
    assert make(rows) == make(rows[::-1]) and make(rows) != make([*rows[:2], ("after", "a", "x")])
    assert len(make(rows)) == 71


def test_evidence_sample(spark):
    df = spark.range(1).select(PO.sample(F.sequence(F.lit(1), F.lit(60)).cast("array<string>")).alias("v"))
    v = df.first()["v"]
    assert len(v) == 51 and v[-1] == "... 10 more"


POINT = "project_id string, id string, method string, path string, request_fields array<string>, response_fields array<string>, statuses array<int>, auth string"


def points(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], POINT)


def test_contract_radar(spark):
    clients = points(spark, [("c1", "GET", "/api/users/:dynamic", [], ["name", "age"], [200], "absent"), ("c2", "POST", "/api/users/7", ["a"], [], [], "unknown"), ("c3", "GET", "/none", [], [], [], "absent")])
    routes = points(spark, [("r1", "GET", "/api/users/:id", ["q"], ["name"], [201], "required"), ("r2", "ANY", "/files/*", [], [], [], "unknown")])
    m = R.matches(clients, routes)
    got = {(r["id"], r["kind"]) for r in R.status_issues(clients, routes, m).collect()}
    assert got == {("c2", "method-mismatch"), ("c3", "missing-route"), ("r2", "no-local-consumer")}
    kinds = {(r["kind"], r["detail"]) for r in R.drift(clients, routes, m).collect()}
    assert kinds == {("request-schema-mismatch", "q"), ("response-schema-mismatch", "age"), ("missing-auth", ""), ("status-mismatch", "200")}
    assert {r["id"]: r["n_tests"] for r in R.coverage(routes, clients).collect()} == {"r1": 1, "r2": 0}
    gate = R.radar_gate(R.status_issues(clients, routes, m), spark.createDataFrame([(1,)], "unknowns bigint"), True).first()
    assert (gate["passed"], gate["errors"]) == (False, 2)


def test_mounts(spark):
    mounts = spark.createDataFrame([("p", "app", "api", "/api"), ("p", "api", "users", "/users"), ("p", "users", "api", "/loop"), ("p", "app", "users", "/")], "project_id string, parent string, child string, prefix string")
    got = {(r["receiver"], r["prefix"]) for r in R.mount_prefixes(mounts).collect()}
    # a climb that comes back to where it was ends there, as at a root
    assert got == {("app", "/"), ("api", "/api"), ("api", "/loop"), ("api", "/users/loop"), ("users", "/api/users"), ("users", "/"), ("users", "/loop/users")}
    drafts = spark.createDataFrame([("p", "users", "/:id"), ("p", "other", "/x")], "project_id string, receiver string, path string")
    assert {r["path"] for r in R.mounted(drafts, R.mount_prefixes(mounts)).collect()} == {"/api/users/:id", "/:id", "/loop/users/:id", "/x"}


def test_mounts_without_a_root_or_an_end(spark):
    """A cycle that nothing else mounts has prefixes too, and a chain of a hundred keeps them all."""
    chain = [("p", f"r{i}", f"r{i + 1}", f"/{i}") for i in range(100)]
    mounts = spark.createDataFrame([("q", "a", "b", "/b"), ("q", "b", "a", "/a"), *chain], "project_id string, parent string, child string, prefix string")
    got = {(r["receiver"], r["prefix"]) for r in R.mount_prefixes(mounts).collect()}
    assert {x for x in got if x[0] in "ab"} == {("a", "/b/a"), ("b", "/a/b")}
    assert ("r100", "".join(f"/{i}" for i in range(100))) in got and len(got) == 103


def test_unique_ids(spark):
    rows = spark.createDataFrame([("f", "a", 1, 1), ("f", "a", 5, 2), ("f", "a", 5, 3), ("f", "b", 6, 4)], "file string, base string, line int, pos int")
    assert [r["uid"] for r in J.unique_ids(rows, ["file"], "base", "line", ["pos"]).orderBy("pos").collect()] == ["a", "a@5", "a@5-2", "b"]


def test_first_match(spark):
    probes, known = spark.createDataFrame([(1, "a/b"), (2, "c")], "k int, base string"), spark.createDataFrame([("a/b.js",), ("a/b/index.ts",), ("c/index.js",)], "path string")
    got = {r["k"]: r["path"] for r in J.first_match(probes, known, ["k"], "base", P.SUFFIXES).collect()}
    assert got == {1: "a/b.js", 2: "c/index.js"}


def test_tree_scan_and_limits(spark, tmp_path):
    for name, text in {"a.ts": "1", "b.d.ts": "2", "sub/z.py": "é", "node_modules/x.js": "3", "big.js": "x" * 800_001, "note.md": "4"}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(text)
    files = S.read_tree(spark, str(tmp_path))
    assert sorted((r["path"], r["content"]) for r in files.collect()) == [("a.ts", "1"), ("sub/z.py", "é")]
    assert S.check_limits(files).count() == 2
    many = spark.range(1501).select(F.lit("p").alias("project_id"), F.col("id").cast("string").alias("path"), F.lit("x").alias("content"))
    with pytest.raises(S.LimitError, match="tooManyFiles"):
        S.check_limits(many)


def test_payload(spark):
    rows = [(0, " src\\a.ts ", "x"), (1, "b.ts", None), (2, "src/a.ts", "y"), (3, "c.ts", "é" * 800_000), (4, "", "z")]
    got = {r["ordinal"]: (r["path"], r["code"]) for r in S.validate(spark.createDataFrame(rows, "ordinal int, path string, content string")).collect()}
    assert got == {0: ("src/a.ts", None), 1: ("b.ts", "invalidFiles"), 2: ("src/a.ts", "duplicateFilePath"), 3: ("c.ts", "sourceFileTooLarge"), 4: ("", "invalidFiles")}


def test_saved_projects(spark):
    saved = spark.createDataFrame([("1", "s", "2020", "2020", "old"), ("2", "t", "2021", "2021", "t")], "id string, signature string, created_at string, updated_at string, name string")
    new = spark.createDataFrame([("3", "s", "2022", "2022", "new")], saved.schema)
    out = [(r["id"], r["created_at"], r["name"]) for r in S.listed(S.upsert(saved, new)).collect()]
    assert out == [("1", "2020", "new"), ("2", "2021", "t")]
    assert S.deleted(S.upsert(saved, new), ["1"]).count() == 1
