"""Whole analyses of small projects."""

import pytest

from larchgraph import __main__ as cli
from larchgraph import api
from larchgraph.operators import files as FI
from larchgraph.operators import policy as PO
from larchgraph.operators.policy import Policy
from larchgraph.sources import corpus

BEFORE = {"src/main.ts": "import { helper } from './helper';\nexport function main() { return helper(); }", "src/helper.ts": "export function helper() { return 1; }"}


def sources(spark, before, after):
    rows = [("before", p, c) for p, c in before.items()] + [("after", p, c) for p, c in after.items()]
    return spark.createDataFrame(rows, "project_id string, path string, content string")


@pytest.mark.parametrize(
    ("change", "status", "failed"),
    [
        ({"src/helper.ts": "export function helper() { return 2; }"}, "pass", set()),
        ({"src/main.ts": "import './gone';\n" + BEFORE["src/main.ts"]}, "fail", {"unresolved-import-budget"}),
        ({"src/helper.ts": "export function helper( {"}, "unknown", set()),
    ],
)
def test_verify_change(spark, change, status, failed):
    checks, overall, gate, _ = api.verify_change(sources(spark, BEFORE, BEFORE | change), Policy(preserve_functions=("src/helper.ts#helper",) if status == "pass" else ()))
    assert overall.first()["status"] == status
    assert {r["id"] for r in checks.collect() if r["status"] == "fail"} == failed
    assert gate.first()["passed"] == (status == "pass")


def test_snapshots_that_are_not_in_order(spark):
    """Two equal paths and an empty one are errors; text files alone leave the analysis open."""
    for bad in ({"./src/main.ts": "x"}, {" ": "x"}):
        with pytest.raises(ValueError):
            api.verify_change(sources(spark, BEFORE, BEFORE | bad), Policy())
    checks, overall, _, _ = api.verify_change(sources(spark, {"a.md": "1"}, {"a.md": "2"}), Policy())
    assert overall.first()["status"] == "unknown"
    lines = [r["text"] for r in PO.limitations(sources(spark, {"b.md": "1"}, {"a.md": "2", "c.ts": ""})).collect()]
    assert len(lines) == 3 and lines[2].endswith("a.md, b.md")


def test_policy_files():
    data = {"name": " n ", "allow": {"removedFiles": ["./a.ts", "a.ts"], "removedFunctions": [" ./a.ts#f "]}, "preserve": {"files": ["b\\c.ts"]}, "limits": {"maxNewHotspots": 2}, "more": 1}
    p = Policy.from_json(data)
    assert (p.name, p.allow_files, p.allow_functions, p.preserve_files, p.max_new_hotspots) == ("n", ("a.ts",), ("a.ts#f",), ("b/c.ts",), 2)
    assert Policy.from_json({}).name == "unnamed-change"
    for wrong in ([], {"allow": 1}, {"limits": {"maxNewHotspots": -1}}, {"limits": {"maxNewHotspots": True}}, {"preserve": {"files": "a"}}):
        with pytest.raises(ValueError):
            Policy.from_json(wrong)


def test_analysis_and_simulation(spark):
    files = {"a.ts": "export function a() { b(); c(); }\nexport function b() { a(); }\nfunction c() { }", "a.test.ts": "import './a';\nfunction t() { a(); }", "x.ts": "import './none';"}
    df = spark.createDataFrame([("p", p, c) for p, c in files.items()], "project_id string, path string, content string")
    a = api.analyze(df, reuse=True)
    assert {r["id"]: r["level"] for r in api.analyze(df, reuse=True).nodes.collect()} == {"a.ts#a": "hot", "a.ts#b": "hot", "a.ts#c": "ok", "a.test.ts#t": "ok"}
    assert [r["id"] for r in api.hotspots(a, 1).collect()] == ["a.ts#a"]
    assert {(r["role"], r["other"]) for r in api.get_function(a, "p", "a.ts#b").collect()} == {("self", "a.ts#b"), ("caller", "a.ts#a"), ("callee", "a.ts#a")}
    assert [r["other"] for r in api.get_function(a, "p", "nothing").collect()] == sorted(["a.ts#a", "a.ts#b", "a.ts#c", "a.test.ts#t"])
    reached, walked = api.trace(a, spark.createDataFrame([("p", "a.test.ts#t")], "project_id string, id string"), 2)
    assert reached.count() == 4 and {(r["src"], r["dst"]) for r in walked.collect()} == {("a.test.ts#t", "a.ts#a"), ("a.ts#a", "a.ts#b"), ("a.ts#a", "a.ts#c")}
    changes = spark.createDataFrame([("one", "p", "delete-function", "a.ts#a"), ("none", "p", "delete-function", "a.ts#zz")], "change_id string, project_id string, kind string, target string")
    s = api.simulate(a, changes)
    assert {r["change_id"]: r["found"] for r in s.outcomes.collect()} == {"one": True, "none": False}
    assert [(r["id"], r["callees"], r["fan_out_after"]) for r in s.broken.collect()] == [("a.test.ts#t", ["a"], 0), ("a.ts#b", ["a"], 0)]
    assert {r["id"] for r in s.orphaned.collect()} == {"a.ts#b", "a.ts#c"}
    d = s.delta.first()
    assert (d["functions_before"], d["functions_after"], d["in_cycle_before"], d["in_cycle_after"], d["flagged_after"]) == (4, 3, 2, 0, 0)
    text = [r["text"] for r in s.summary.filter("change_id = 'one'").orderBy("line").collect()]
    assert text == ["removed functions: 1", "broken callers: 2: t, b", "without callers now: 2: b, c", "test files concerned: 1", "functions in cycles: 2 to 0", "flagged functions: 2 to 0", "calls of t: 1 to 0", "calls of b: 1 to 0"]
    nodes, edges, summary = api.file_graph(df)
    got = summary.first().asDict()
    assert (got["files"], got["edges"], got["cycles"], got["entries"], got["orphans"], got["unresolved_imports"]) == (3, 1, 0, 1, 1, 1)
    assert [r["path"] for r in FI.graph_order(nodes).collect()] == ["a.ts", "a.test.ts", "x.ts"]


def test_trees(spark, tmp_path):
    """Only kept files are opened; order, limits and the choice of a source."""
    for p, c in {"b.ts": "2", "a.py": "1", "node_modules/x.ts": "no", "sub/c.go": "3", "d.d.ts": "no", "e.md": "no"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(c)
    rows = corpus.read_tree(spark, str(tmp_path)).collect()
    assert [(r["path"], r["content"]) for r in rows] == [("a.py", "1"), ("b.ts", "2"), ("sub/c.go", "3")]
    corpus_files, corpus.MAX_FILES = corpus.MAX_FILES, 2
    try:
        with pytest.raises(corpus.LimitError):
            corpus.read_tree(spark, str(tmp_path))
        assert [r["path"] for r in corpus.read_tree(spark, str(tmp_path), on_limit="truncate").collect()] == ["a.py", "b.ts"]
    finally:
        corpus.MAX_FILES = corpus_files
    assert corpus.source_files(spark, path=str(tmp_path)).count() == 3
    (tmp_path / "empty").mkdir()
    for wrong in ({}, {"path": str(tmp_path / "empty")}):
        with pytest.raises(ValueError):
            corpus.source_files(spark, **wrong)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "c.ts").write_text("fetch('/gone');")
    assert cli.main([str(tmp_path / "a")]) == 1 and "missing-route" in capsys.readouterr().out
    assert cli.main(["--before", str(tmp_path / "a"), "--after", str(tmp_path / "a"), "--json"]) == 0
    assert '"status": "pass"' in capsys.readouterr().out
    (tmp_path / "p.json").write_text("{")
    assert cli.main(["--before", str(tmp_path / "a"), "--after", str(tmp_path / "a"), "--policy", str(tmp_path / "p.json")]) == 2
    assert cli.main([str(tmp_path / "nowhere")]) == 2


def test_arguments():
    assert cli.arguments(["x", "--json"]).json
    for wrong in (["--before", "a"], ["--policy", "p"], ["x", "--before", "a", "--after", "b"], ["--nothing"]):
        with pytest.raises(SystemExit) as e:
            cli.arguments(wrong)
        assert e.value.code == 2
