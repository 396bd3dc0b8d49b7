"""Graph operators on fixed graphs with known results, and on random ones against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from larchgraph.operators import graph as G
from larchgraph.operators import impact as I

CALLS = """login>validate login>getToken login>audit validate>hashPwd validate>checkUser hashPwd>sha256 getToken>createToken
getToken>refresh refresh>expired refresh>getToken refresh>createToken createToken>sign checkUser>db audit>log""".split()
COMPLEX = {"login": 2, "validate": 2, "refresh": 3}


def frames(spark, pairs, files=None, complexity=None):
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([("p", i, str(i), (files or {}).get(i, "f.js"), (complexity or {}).get(i, 1)) for i in ids], "project_id string, id string, name string, file string, complexity int")
    return nodes, spark.createDataFrame([("p", a, b) for a, b in pairs], "project_id string, src string, dst string")


def test_three_file_project(spark):
    nodes, edges = frames(spark, [c.split(">") for c in CALLS], complexity=COMPLEX)
    s = {r["id"]: r for r in G.scored(nodes, edges).collect()}
    want = {"login": (0, 3, "ok", 9), "validate": (1, 2, "ok", 9), "getToken": (2, 2, "hot", 107), "refresh": (1, 3, "hot", 113), "createToken": (2, 1, "ok", 6), "expired": (1, 0, "ok", 4)}
    assert {k: (s[k]["fan_in"], s[k]["fan_out"], s[k]["level"], s[k]["score"]) for k in want} == want
    marked = G.cycle_edges(edges, G.scc(edges)).filter("cycle").collect()
    assert {(r["src"], r["dst"]) for r in marked} == {("getToken", "refresh"), ("refresh", "getToken")}
    assert len(s) == 13 and edges.count() == 14
    layer = {r["id"]: r["layer"] for r in G.layers(nodes, G.cycle_edges(edges, G.scc(edges))).collect()}
    assert layer["login"] == 0 and layer["sign"] == layer["createToken"] + 1


def plain_scc(nodes, edges):
    out = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = out[b] - out[a]
            if new:
                out[a] |= new
                changed = True
    return {n: min(m for m in nodes if m in out[n] and n in out[m]) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_scc_strategies_agree(spark, seed):
    rng = random.Random(seed)
    projects = {f"p{k}": [(rng.randrange(25), rng.randrange(25)) for _ in range(rng.choice((12, 30, 60)))] for k in range(3)}
    df = spark.createDataFrame([(p, a, b) for p, es in projects.items() for a, b in es], "project_id string, src int, dst int").repartition(3)
    want = {(p, n): c for p, es in projects.items() for n, c in plain_scc({x for e in es for x in e}, es).items()}
    for in_task in (1000, 0, 30):
        assert {(r["project_id"], r["id"]): r["scc"] for r in G.scc(df, in_task).collect()} == want


def test_long_chain_needs_no_recursion(spark):
    n = 5000
    df = spark.range(n).select(F.lit("p").alias("project_id"), F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    assert [r["scc"] for r in G.scc(df).select("scc").distinct().collect()] == [0]


def test_trace_order_flags_what_was_seen(spark):
    _, edges = frames(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    start = spark.createDataFrame([("p", "a")], "project_id string, id string")
    rows = sorted(G.trace_order(edges, start, 5).collect(), key=lambda r: r["step"])
    assert [(r["id"], r["depth"], r["revisit"]) for r in rows] == [("a", 0, False), ("b", 1, False), ("d", 2, False), ("c", 1, False), ("d", 2, True)]


@pytest.mark.parametrize("seed", range(2))
def test_layer_strategies_agree(spark, seed):
    rng = random.Random(seed)
    pairs = {(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(70)) if a < b}
    nodes = spark.createDataFrame([("p", i) for i in range(31)], "project_id string, id int")
    marked = spark.createDataFrame([("p", a, b, False) for a, b in pairs] + [("p", 3, 3, True)], "project_id string, src int, dst int, cycle boolean")
    want = dict.fromkeys(range(31), 0)
    for a, b in sorted(pairs):  # sources in order: a graph over a < b
        want[b] = max(want[b], want[a] + 1)
    for in_task in (1000, 0):
        assert {r["id"]: r["layer"] for r in G.layers(nodes, marked, in_task).collect()} == want


def test_metric_delta_equals_scoring_the_rest(spark):
    """Touched nodes alone give the counts of the whole remaining graph."""
    rng = random.Random(3)
    rows = []
    for k in range(3):
        rows += [(f"p{k}", rng.randrange(14), rng.randrange(14)) for _ in range(rng.choice((14, 26)))]
    nodes = spark.createDataFrame([(f"p{k}", i, f"f{i % 3}.js", rng.choice((1, 9, 10, 12))) for k in range(3) for i in range(14)], "project_id string, id int, file string, complexity int")
    edges = spark.createDataFrame(rows, "project_id string, src int, dst int")
    changes = [(f"p{k}/{i}", f"p{k}", "delete-function", str(i)) for k in range(3) for i in range(0, 14, 4)] + [(f"p{k}/f", f"p{k}", "delete-file", "f1.js") for k in range(3)]
    gone = I.removed(spark.createDataFrame(changes, "change_id string, project_id string, kind string, target string"), nodes).cache()
    left, rest = I.shadow(gone, nodes, edges)
    after = {r["project_id"]: (r["n"], r["c"], r["l"]) for r in G.scored(left, rest).groupBy("project_id").agg(F.count("*").alias("n"), F.count_if("in_cycle").alias("c"), F.count_if(F.col("level") != "ok").alias("l")).collect()}
    got = {r["change_id"]: (r["functions_after"], r["in_cycle_after"], r["flagged_after"]) for r in I.metric_delta(gone, nodes, edges).collect()}
    assert got == after and len(got) == len(changes)
    fans = {(r["project_id"], r["id"]): r["fan_in"] for r in G.degrees(left, rest).collect()}
    before = {(r["project_id"], r["id"]): r["fan_in"] for r in G.degrees(nodes, edges).collect()}
    want = {(c, i) for (c, i), n in fans.items() if not n and before[c.split("/")[0], i]}
    assert {(r["change_id"], r["id"]) for r in I.newly_orphaned(gone, nodes, edges).collect()} == want


def test_empty_graph(spark):
    nodes, edges = frames(spark, [("a", "b")])
    assert G.scored(nodes.limit(0), edges.limit(0)).count() == 0
    assert {r["fan_in"] for r in G.scored(nodes, edges.limit(0)).collect()} == {0}


SIM = [("main", "helper"), ("main", "loopA"), ("helper", "util"), ("loopA", "loopB"), ("loopB", "loopA")]
SIM_FILES = {"main": "a.js", "helper": "a.js", "loopA": "b.js", "loopB": "b.js", "util": "b.js"}


def test_simulation(spark):
    nodes, edges = frames(spark, SIM, SIM_FILES)
    changes = spark.createDataFrame(
        [("1", "p", "delete-function", "loopB"), ("2", "p", "delete-file", "./b.js"), ("3", "p", "delete-function", "helper"), ("4", "p", "delete-function", "nobody")],
        "change_id string, project_id string, kind string, target string",
    )
    gone = I.removed(changes, nodes)
    assert {r["change_id"]: (r["found"], r["n_removed"]) for r in I.outcomes(changes, gone).collect()} == {"1": (True, 1), "2": (True, 3), "3": (True, 1), "4": (False, 0)}
    broken = {(r["change_id"], r["id"]) for r in I.broken_callers(gone, nodes, edges).collect()}
    assert broken == {("1", "loopA"), ("2", "main"), ("2", "helper"), ("3", "main")}
    assert {(r["change_id"], r["id"]) for r in I.newly_orphaned(gone, nodes, edges).collect()} == {("3", "util")}
    delta = {r["change_id"]: r for r in I.metric_delta(gone, nodes, edges).collect()}
    assert (delta["1"]["in_cycle_before"], delta["1"]["in_cycle_after"]) == (2, 0) and delta["2"]["functions_after"] == 2
