"""Hash trees, prefix sums and mount prefixes: against plain versions, and that they stay small."""

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larchgraph.operators import files as FI
from larchgraph.operators import graph as G
from larchgraph.operators import hash_tree as HT
from larchgraph.operators import impact as I
from larchgraph.operators import joins as J
from larchgraph.operators import policy as PO
from larchgraph.operators import quantiles as QU
from larchgraph.operators import radar as R
from larchgraph.operators import running as RS
from larchgraph.plans import views as V
from larchgraph.sources import corpus as S


def plain_root(files, depth):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = {}
    for path, content in sorted(files.items()):
        level.setdefault(sha(path)[:depth], []).append(f"{path}\0{sha(content or '')}\0")
    level = {k: sha("".join(v)) for k, v in level.items()}
    for d in range(depth - 1, -1, -1):
        up = {}
        for k in sorted(level):
            up.setdefault(k[:d], []).append(level[k])
        level = {k: sha("".join(v)) for k, v in up.items()}
    return level.get("")


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string").repartition(3)


def test_hash_tree_reads_and_writes_only_what_changes(spark):
    old = {f"src/f{i}.ts": None if i % 50 == 0 else f"text {i}" for i in range(4000)}
    new = dict(old)
    for i in range(4):
        new[f"src/f{i * 7 + 1}.ts"] = "changed"
        new[f"src/new{i}.ts"] = "new"
    del new["src/f3000.ts"], new["src/f3001.ts"]
    depth = HT.depth_for(len(old), 8)
    assert depth == 3
    a, b = HT.tree(frame(spark, old), depth), HT.tree(frame(spark, new), depth)
    assert [r["digest"] for r in a.root().collect()] == [plain_root(old, depth)] and [r["digest"] for r in b.root().collect()] == [plain_root(new, depth)]
    leaves = [r["prefix"] for r in HT.differing(a, b).collect()]
    assert len(leaves) <= 10
    assert HT._within(a.entries, HT.differing(a, b)).count() <= 10 * 8
    got = {(r["path"], r["change"]) for r in HT.diff(a, b).collect()}
    sides = frame(spark, old).withColumn("snapshot_id", F.lit("before")).unionByName(frame(spark, new).withColumn("snapshot_id", F.lit("after")))
    assert got == {(r["path"], r["change"]) for r in PO.snapshot_diff(sides).collect()} and len(got) == 10
    changes = [(p, new.get(p), p not in new) for p, _ in got]
    c = HT.updated(a, spark.createDataFrame(changes, "path string, content string, removed boolean"))
    assert {tuple(r) for r in c.nodes.collect()} == {tuple(r) for r in b.nodes.collect()}
    assert {tuple(r) for r in c.entries.collect()} == {tuple(r) for r in b.entries.collect()}
    assert HT.diff(b, c).count() == 0


def test_repeated_paths_count_in_the_order_of_their_ordinals(spark):
    """As pages of one url do: texts of a path are in page order, not in that of their digests."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    before = [("a", i, f"text {i}") for i in range(12)] + [("b", 12, "b"), ("c", 13, "same"), ("d", 14, "gone"), ("d", 15, "too")]
    after = [("a", i, f"text {11 - i}") for i in range(12)] + [("b", 12, "b"), ("c", 13, "same"), ("c", 16, "same"), ("e", 17, "new"), ("e", 18, "er")]
    side = lambda rows, s: spark.createDataFrame([(s, *r) for r in reversed(rows)], "snapshot_id string, path string, ordinal bigint, content string").repartition(3)
    files = side(before, "before").unionByName(side(after, "after"))

    def plain(rows, digits):
        parts = {}
        for path, _, text in sorted(rows):
            parts.setdefault(sha(path)[:digits], []).append(f"{path}\0{sha(text)}\0")
        return [sha("".join(v)) for _, v in sorted(parts.items())]

    got = {r["snapshot_id"]: r["digest"] for r in PO.files_digest(files).collect()}
    assert got == {s: "sha256:" + sha("".join(plain(rows, PO.RANGE_DIGITS))) for s, rows in (("before", before), ("after", after))}
    a, b = (HT.tree(files.filter(F.col("snapshot_id") == s).drop("snapshot_id"), 1) for s in ("before", "after"))
    assert a.root().first()["digest"] == sha("".join(plain(before, 1))) and b.root().first()["digest"] == sha("".join(plain(after, 1)))
    changed = HT.changed(a, b)
    assert {tuple(r) for r in changed.collect()} == {("a", False), ("c", False), ("d", True), ("e", False)}
    c = HT.updated(a, changed.join(files.filter("snapshot_id = 'after'"), "path", "left").select("path", "ordinal", "content", "removed"))
    assert c.root().first() == b.root().first() and c.entries.count() == len(after)
    sizes = files.filter("snapshot_id = 'before'").select(F.lit("p").alias("project_id"), "path", "ordinal", (F.col("ordinal") + 1).alias("bytes"))
    kept = {r["ordinal"]: (r["total"], r["kept"]) for r in S.running_limit(sizes, 50, order=("path", "ordinal")).collect()}
    assert kept == {i: (t := (i + 1) * (i + 2) // 2, t <= 50) for i in range(16)}


def test_tree_diff_pairs_the_texts_of_repeated_paths(spark):
    """Also where both trees have the same ones: the diff is that of a full join, and reads no other leaf for it."""
    same = [(f"f{i}", i, f"text {i}") for i in range(300)] + [("twice", 300, "x"), ("twice", 301, "y"), ("copied", 302, "z"), ("copied", 303, "z")]
    before, after = [*same, ("gone", 304, "g"), ("more", 305, "m")], [*same, ("more", 305, "m"), ("more", 306, "n"), ("more", 307, "n")]
    side = lambda rows, s: spark.createDataFrame([(s, *r) for r in rows], "snapshot_id string, path string, ordinal bigint, content string").repartition(3)
    files = side(before, "before").unionByName(side(after, "after"))
    a, b = (HT.tree(files.filter(F.col("snapshot_id") == s).drop("snapshot_id"), 2) for s in ("before", "after"))
    rows = lambda df: sorted(tuple(r) for r in df.select("path", "change").collect())
    want = [("gone", "removed"), *[("more", "modified")] * 2, *[("twice", "modified")] * 2]
    assert rows(HT.diff(a, b)) == rows(PO.snapshot_diff(files)) == want and rows(HT.diff(a, a)) == want[-2:]
    assert HT.differing(a, b, several=True).count() == 3 and HT.differing(a, b).count() == 2
    assert {tuple(r) for r in HT.changed(a, b).collect()} == {("gone", True), ("more", False)}
    changes = HT.changed(a, b).join(files.filter("snapshot_id = 'after'"), "path", "left").select("path", "ordinal", "content", "removed")
    c = HT.updated(a, changes)
    assert {tuple(r) for r in c.nodes.collect()} == {tuple(r) for r in b.nodes.collect()}
    assert rows(HT.diff(b, c)) == [*[("more", "modified")] * 4, *[("twice", "modified")] * 2]


def test_hash_trees_of_nothing_and_of_other_depths(spark):
    none, one = HT.tree(frame(spark, {"a": "x"}).limit(0), 1), HT.tree(frame(spark, {"a": "x"}), 1)
    assert none.root().count() == 0
    assert [tuple(r) for r in HT.diff(none, one).collect()] == [("a", "added")] and [tuple(r) for r in HT.diff(one, none).collect()] == [("a", "removed")]
    gone = HT.updated(one, spark.createDataFrame([("a", None, True)], "path string, content string, removed boolean"))
    assert gone.root().count() == 0 and gone.entries.count() == 0
    flat = HT.tree(frame(spark, {"a": "x", "b": None}), 0)
    assert [r["digest"] for r in flat.root().collect()] == [plain_root({"a": "x", "b": None}, 0)]
    with pytest.raises(ValueError, match="cannot be compared"):
        HT.diff(one, flat)


def test_graph_rounds_send_no_side_of_a_join_through_the_driver(spark, monkeypatch):
    plans, write = [], G.stored
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(G, "stored", lambda df: write(told(df)))
    pairs = [(i, i + 1) for i in range(8)] + [(3, 1), (8, 6), (9, 0), (9, 9)]
    edges = spark.createDataFrame([("p", a, b) for a, b in pairs], "project_id string, src bigint, dst bigint")
    nodes = spark.createDataFrame([("p", i, "f", 1) for i in range(10)], "project_id string, id bigint, file string, complexity int")
    comp = write(told(G._scc_spread(edges)))
    assert {r["id"]: r["scc"] for r in comp.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6, 9: 9}
    marked = write(told(G.cycle_edges(edges, comp)))
    layer = write(told(G._layers_spread(nodes, marked.filter("not cycle").select(*G.PAIR))))
    assert {r["id"]: r["layer"] for r in layer.collect()} == {9: 0, 0: 1, 1: 2, 2: 0, 3: 0, 4: 1, 5: 2, 6: 3, 7: 0, 8: 0}
    told(G.layout(G.scored(nodes, edges, comp=comp), layer))
    told(G.baseline_delta(G.scored(nodes, edges, comp=comp), G.scored(nodes, edges, comp=comp)))
    assert len(plans) > 15 and [p for p in plans if "Broadcast" in p] == []


@pytest.mark.parametrize("in_task", [0, 300])
def test_component_rounds_are_few_and_end_in_a_task(spark, monkeypatch, in_task):
    """A project's large component is found first, along and against its edges together, and what is left of
    the project is finished in one task; no side of a join goes through the driver."""
    plans, write, rnd = [], G.stored, random.Random(5)
    monkeypatch.setattr(G, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    large = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(900)]
    large += [(i + d, i + 1 - d) for i in range(400, 460, 2) for d in (0, 1)] + [(i, i + 2) for i in range(400, 416, 2)]
    sets = {"large": large, "small": [(1, 2), (2, 1), (2, 3), (4, 4)]}
    edges = spark.createDataFrame([(p, f"n{a:03}", f"n{b:03}") for p, e in sets.items() for a, b in e], "project_id string, src string, dst string")
    got = {(r["project_id"], r["id"]): r["scc"] for r in G.scc(edges, in_task).collect()}
    assert got == {(p, f"n{x:03}"): f"n{c:03}" for p, e in sets.items() for x, c in G._tarjan(e).items()}
    assert len({c for p, c in got.items() if p[0] == "large"}) > 30
    assert [p for p in plans if "Broadcast" in p] == [] and len(plans) < (25 if in_task else 50)


@pytest.mark.parametrize("in_task", [0, 300])
def test_components_with_long_chains_take_few_rounds(spark, monkeypatch, in_task):
    """As copies of events at one time have: rounds follow the logarithm of a chain's length, not the length."""
    arcs = [(i, i + 1) for i in range(700)] + [(700, 0), (350, 2000), (2000, 2001), (2001, 400)]  # a circle with a by-pass
    arcs += [(3000 + i, 3000 + (i + 1) % 90) for i in range(90)]  # one that stands alone
    arcs += [(10, 4000), *((i, i + 1) for i in range(4000, 4200)), (4200, 5000), (5000, 5001), (5001, 5000)]  # a chain between components
    arcs += [(6000, 6001), (6001, 6002), (6002, 6000), (6000, 6003), (6003, 6000), (5999, 6000)]  # two circles that share a node
    arcs += [(a + 7000, b + 7000) for i in range(20) for a, b in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3))] + [(7060, 7000)]  # diamonds
    edges = spark.createDataFrame([(p, a, b) for p in ("p", "q") for a, b in arcs] + [("r", 1, 2), ("r", 2, 1)], "project_id string, src bigint, dst bigint")
    written, plain = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df: written.append(1) or plain(df))
    got = {(r["project_id"], r["id"]): r["scc"] for r in G.scc(edges, in_task).collect()}
    want = G._tarjan(arcs)
    assert got == {(p, x): c for p in ("p", "q") for x, c in want.items()} | {("r", 1): 1, ("r", 2): 1}
    assert len(written) < 60


def test_event_graphs_send_no_side_through_the_driver(spark, monkeypatch):
    """The hours' first events, calls of projects and facts of a snapshot grow with the input. The edges are written
    once, so that scores do not work them out again at each use."""
    rows = [(i, datetime(2024, 1, 1 + i % 20, i % 24), i % 7, "error", float(i)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    monkeypatch.setattr(V, "table", lambda *_: events)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(V.weekly_calls(spark, ""))
    for nodes, edges in (V.weekly(spark, ""), V.snapshots(spark, "")):
        assert edges.count() > 0 and "Window" not in plan(nodes) + plan(edges)
        assert "Broadcast" not in plan(G.overview(G.scored(nodes, edges), edges))
    facts = spark.createDataFrame([("before", "function", "1"), ("after", "function", "2")], "snapshot_id string, kind string, key string")
    found = PO.evidence(facts, PO.Policy(preserve_functions=("1", "2"), allow_functions=("3",)))
    assert {tuple(r) for r in found.collect()} == {("undeclared-function", "1"), ("lost-function", "1")}
    assert "Broadcast" not in plan(found)


def test_file_joins_send_no_side_through_the_driver(spark):
    files = spark.createDataFrame([("p", f"src/f{i}.ts", 1, False, False) for i in range(4)], "project_id string, path string, exports int, shebang boolean, parse_error boolean")
    specs = spark.createDataFrame([("p", f"src/f{i}.ts", f"./f{i + 1}") for i in range(4)], "project_id string, path string, spec string")
    found, lost = FI.resolve(specs, files)
    assert found.count() == 3 and [tuple(r) for r in lost.collect()] == [("p", "src/f3.ts", "./f4")]
    for df in (found, lost, FI._counts(found, files)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_running_sums_of_a_hot_key(spark):
    """One key has nearly all rows: they are summed in several partitions, and the sums are a window's."""
    rows = spark.range(20_000).selectExpr("if(id % 50 = 0, if(id % 100 = 0, null, 'b'), 'hot') as k", "id * 7919 % 20011 as o", "id % 13 as v").repartition(5)
    got = RS.running_sums(rows, ["k"], ["o"], {"total": "v", "nth": F.lit(1)})
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = rows.withColumns({"total": F.sum("v").over(w), "nth": F.row_number().over(w).cast("bigint")})
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan and not [x for x in plan.split("\n") if "Window [" in x and "windowspecdefinition(k#" in x and "_part#" not in x.split("windowspecdefinition(")[1]]
    assert RS.numbered(rows.limit(0), ["k"], ["o"]).count() == 0


def test_unique_ids_both_ways(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([("f", rng.choice("ab"), rng.randrange(4), i) for i in range(300)], "file string, base string, line int, pos int").repartition(3)
    one, two = (sorted(map(tuple, J.unique_ids(rows, ["file"], "base", "line", ["pos"], bounded=b).collect())) for b in (True, False))
    assert one == two and len({r[-1] for r in one}) == 300


def plain_prefixes(mounts, key, seen=frozenset()):
    join = lambda a, b: b if a == "/" else a if b == "/" else a + b
    into = [m for m in mounts if m[1] == key]
    if key in seen or not into:
        return {"/"}
    return {join(p, x) for parent, _, x in into for p in plain_prefixes(mounts, parent, seen | {key})}


def prefixes(spark, mounts):
    df = spark.createDataFrame([("p", *m) for m in mounts], "project_id string, parent string, child string, prefix string")
    out = {}
    for r in R.mount_prefixes(df).collect():
        assert r["prefix"] not in out.setdefault(r["receiver"], set())
        out[r["receiver"]].add(r["prefix"])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mount_prefixes_with_circles(spark, seed):
    rng = random.Random(seed)
    names = "abcdefg"
    mounts = sorted({(rng.choice(names), rng.choice(names), rng.choice(["/", "/x", "/y"])) for _ in range(11)})
    assert prefixes(spark, mounts) == {k: plain_prefixes(mounts, k) for k in {x for m in mounts for x in m[:2]}}


def test_stacked_diamonds_with_equal_prefixes_finish(spark):
    """25 diamonds have 2 ** 25 ways, but each receiver one prefix."""
    mounts = []
    for i in range(25):
        mounts += [(f"n{i}", f"l{i}", "/"), (f"n{i}", f"r{i}", "/"), (f"l{i}", f"n{i + 1}", "/"), (f"r{i}", f"n{i + 1}", "/")]
    mounts.append(("n25", "end", "/api"))
    got = prefixes(spark, mounts)
    assert got["end"] == {"/api"} and all(v == {"/"} for k, v in got.items() if k != "end") and len(got) == 77


def fits(client, route):
    c, r = [x for x in client.split("/") if x], [x for x in route.split("/") if x]
    if "*" in r:
        r = r[: r.index("*")]
        if len(c) < len(r):
            return False
    elif len(c) != len(r):
        return False
    return all(a == b or a.startswith(":") or b.startswith(":") for a, b in zip(c, r))


def points(spark, paths):
    return spark.createDataFrame([("p", str(i), x) for i, x in enumerate(paths)], "project_id string, id string, path string").repartition(3)


def test_paths_walk_the_trie_to_the_routes_that_they_fit(spark):
    rng = random.Random(8)
    part = lambda kinds: "/" + "/".join(rng.choice(kinds) for _ in range(rng.randrange(0, 5)))
    clients = [part(["a", "b", "c", ":x"]) for _ in range(60)] + ["/", "/a", "/a"]
    routes = [part(["a", "b", ":id", ":other", "*"]) for _ in range(60)] + ["/", "/*", "/:x/*", "/a/*/b"]
    got = {(r["client_id"], r["route_id"]) for r in R.path_pairs(points(spark, clients), points(spark, routes)).collect()}
    assert got == {(str(i), str(j)) for i, c in enumerate(clients) for j, r in enumerate(routes) if fits(c, r)} and len(got) > 100
    assert R.path_pairs(points(spark, clients), points(spark, ["/"]).limit(0)).count() == 0


def test_routes_with_an_open_first_segment_do_not_meet_every_client(spark):
    """10,000 routes that begin with a parameter: a client passes four nodes, not ten thousand routes."""
    routes = points(spark, [f"/:tenant/r{i}/x" for i in range(10_000)])
    clients = points(spark, [f"/acme/r{i * 11}/x" for i in range(500)])
    edges, _ = R.route_trie(routes)
    assert R.trie_walk(clients.select("project_id", "path"), edges).count() == 4 * 500
    assert R.path_pairs(clients, routes).count() == 500


@pytest.mark.parametrize("bins", [1000, 3])
def test_quantiles_by_narrowing(spark, bins):
    rng = random.Random(9)
    inf = float("inf")
    groups = {"a": [rng.gauss(0, 1) for _ in range(999)], "b": [5.0] * 40, "c": [rng.choice([1e-300, 1.0, 1e300, -1e308, 1.7e308]) for _ in range(50)], "d": [inf, -inf, 1.0, 2.0, inf], None: [3.0, 1.0], "e": [7.5]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("f", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r["g"]: tuple(r)[1:] for r in QU.quantiles(df, ["g"], "x", {"low": lambda n: F.lit(0), "median": lambda n: F.floor(n / 2) + 1, "p95": lambda n: F.ceil(n * 0.95)}, bins).collect()}
    at = lambda vs, k: sorted(vs)[k - 1]
    assert got == {k: (min(vs), at(vs, len(vs) // 2 + 1), at(vs, -(-len(vs) * 95 // 100))) for k, vs in groups.items()}


def in_cycles(n, arcs, gone):
    """Nodes that reach themselves without the removed ones."""
    on = {v: [w for u, w in arcs if u == v and w not in gone] for v in range(n) if v not in gone}
    out = set()
    for v in on:
        seen, todo = set(), list(on[v])
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += on[w]
        out |= {v} & seen
    return out


@pytest.mark.parametrize("seed", range(20))
def test_cycles_of_many_deletions_by_bits(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 5, 12, 25])
    arcs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.8, 1.3, 2.5])) + 1)})
    gone = [{rng.randrange(n) for _ in range(rng.randrange(0, 4))} for _ in range(70)]
    alive = [sum(1 << k for k, g in enumerate(gone) if v not in g) for v in range(n)]
    got = I.cycle_bits(n, arcs, alive)
    for k, g in enumerate(gone):
        assert {v for v in range(n) if got[v] >> k & 1} == in_cycles(n, arcs, g)


def test_many_deletions_in_one_component_both_ways(spark):
    """Deltas of bits and of copies are equal; a thousand changes of one component are one group of its arcs."""
    rng = random.Random(3)
    n = 60
    arcs = sorted({(i, (i + 1) % n) for i in range(n)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(40)} | {(n + 1, n + 2), (n + 2, n + 1), (n + 3, 0)})
    edges = spark.createDataFrame([("p", a, b) for a, b in arcs], "project_id string, src bigint, dst bigint")
    nodes = spark.createDataFrame([("p", i, f"f{i % 5}.ts", i % 14) for i in range(n + 5)], "project_id string, id bigint, file string, complexity int")
    gone = spark.createDataFrame([(k, "p", v) for k in range(40) for v in {rng.randrange(n + 5) for _ in range(rng.randrange(1, 4))}], "change_id int, project_id string, id bigint")
    one, two = (sorted(map(tuple, I.metric_delta(gone, nodes, edges, in_task=t).collect())) for t in (200_000, 0))
    assert one == two and len(one) == 40 and len({r[5] for r in one}) > 3
    many = spark.range(1000).selectExpr("cast(id as int) as change_id", "'p' as project_id", f"id % {n} as id")
    rows = {r["change_id"]: r["in_cycle_after"] for r in I.metric_delta(many, nodes, edges).collect()}
    assert len(rows) == 1000 and all(rows[k] == len(in_cycles(n + 5, arcs, {k % n})) for k in range(0, 1000, 37))


def test_thousands_of_starts_are_traced_by_bits(spark):
    rng = random.Random(5)
    arcs = sorted({(rng.randrange(3000), rng.randrange(3000)) for _ in range(4500)})
    on = {}
    for a, b in arcs:
        on.setdefault(a, []).append(b)
    want = set()
    for s in range(2500):
        seen, front = {s: 0}, [s]
        for d in range(1, 4):
            front = [w for v in front for w in on.get(v, ()) if w not in seen and not seen.setdefault(w, 0) and (seen.__setitem__(w, d) or True)]
        want |= {(s, v, d) for v, d in seen.items()}
    edges = spark.createDataFrame([("p", a, b) for a, b in arcs], "project_id string, src bigint, dst bigint")
    starts = spark.range(2500).selectExpr("'p' as project_id", "id")
    got = [tuple(r)[1:] for r in G.trace(edges, starts.unionByName(starts), 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 nodes in a row, with a short cut and a branch: rounds follow the logarithm."""
    n = 10_000
    arcs = [(i, i + 1) for i in range(n - 1)] + [(0, n - 1), (5000, n + 1), (n + 2, n + 3)]
    edges = spark.createDataFrame([("p", a, b, False) for a, b in arcs], "project_id string, src bigint, dst bigint, cycle boolean")
    nodes = spark.range(n + 4).selectExpr("'p' as project_id", "id")
    written, plain = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df: written.append(1) or plain(df))
    got = {r["id"]: r["layer"] for r in G.layers(nodes, edges, in_task=0).collect()}
    assert got == {i: i for i in range(n)} | {n: 0, n + 1: 5001, n + 2: 0, n + 3: 1}
    assert len(written) <= 24


@pytest.mark.parametrize("seed", range(2))
def test_layers_with_chains_both_ways(spark, seed):
    rng = random.Random(seed)
    arcs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(55)})
    edges = spark.createDataFrame([("p", a, b, False) for a, b in arcs], "project_id string, src bigint, dst bigint, cycle boolean")
    nodes = spark.range(60).selectExpr("'p' as project_id", "id")
    one, two = (sorted(map(tuple, G.layers(nodes, edges, in_task=t).collect())) for t in (1000, 0))
    assert one == two


def test_saved_projects_have_the_clocks_time(spark):
    from datetime import UTC, datetime

    began = datetime.now(UTC)
    old = spark.createDataFrame([("1", "s", "2020-01-01T00:00:00.000Z", "2020-01-01T00:00:00.000Z")], "id string, signature string, created_at string, updated_at string")
    new = S.stamped(spark.createDataFrame([("2", "s"), ("3", "t")], "id string, signature string")).select(*old.columns)
    rows = {r["signature"]: r for r in S.upsert(old, new).collect()}
    assert (rows["s"]["id"], rows["s"]["created_at"]) == ("1", "2020-01-01T00:00:00.000Z")
    at = datetime.fromisoformat(rows["s"]["updated_at"])
    assert -2 < (at - began).total_seconds() < 120 and rows["t"]["created_at"] == rows["t"]["updated_at"] == rows["s"]["updated_at"]
