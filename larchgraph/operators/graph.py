"""Graph operators over nodes(project_id, id, file, complexity) and edges(project_id, src, dst).

Many projects, or snapshots as projects, are worked on in one job: project_id is part of every
key. Edges count once for each ordered pair; those with an unknown end are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from larchgraph.functions.tables import dealt, dropped, stored

PAIR = ["project_id", "src", "dst"]
NODE = ["project_id", "id"]
#: Edges up to which a project's components are found in one task.
IN_TASK = 200_000
#: Edges that colours go along between two writes; each task also reports the measures of all hops before it.
HOPS = 3
#: Tasks that a component's nodes are dealt out over when they get its least node.
SHARES = 64


def fold_edges(calls: DataFrame, order: list[str]) -> DataFrame:
    """One row for each pair: how many calls, and the kind of the first."""
    return calls.groupBy(*PAIR).agg(F.count("*").alias("cnt"), F.min_by("kind", F.struct(*order)).alias("kind"))


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.select(*PAIR).distinct()
    for side in ("src", "dst"):
        e = e.join(dealt(nodes.select("project_id", F.col("id").alias(side))), ["project_id", side], "left_semi")
    return e.select(*PAIR)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fan_in and fan_out: distinct neighbours; a self edge counts in both."""
    return _fans(nodes, known_edges(nodes, edges))


def _fans(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """degrees() over edges that are distinct and known."""
    ends = e.select("project_id", F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        e.select("project_id", F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    fans = ends.groupBy(*NODE).agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.join(dealt(fans), NODE, "left").fillna(0, ["fan_in", "fan_out"])


def _tarjan(pairs: list[tuple]) -> dict:
    """Node to the least node of its strongly connected component, without recursion."""
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    label: dict = {}
    stack: list = []
    for start in out:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt not in label:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = [stack.pop()]
                    while group[-1] != node:
                        group.append(stack.pop())
                    least = min(group)
                    label.update(dict.fromkeys(group, least))
    return label


def _scc_in_task(edges: DataFrame) -> DataFrame:
    kinds = dict(edges.dtypes)

    def run(t: pa.Table) -> pa.Table:
        label = _tarjan(sorted(zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True)))
        ids = pa.array(list(label), t.schema.field("src").type)
        project = pa.repeat(t.column("project_id")[0], len(label))
        return pa.table({"project_id": project, "id": ids, "scc": pa.array(list(label.values()), ids.type)})

    return edges.groupBy("project_id").applyInArrow(run, f"project_id {kinds['project_id']}, id {kinds['src']}, scc {kinds['src']}")


def _observed(df: DataFrame, value: Column) -> tuple[DataFrame, Any]:
    """df, written, and an aggregate of its rows that the writing job works out."""
    seen = Observation()
    return stored(df.observe(seen, value.alias("value"))), seen.get["value"]


def _hop(colour: DataFrame, steps: DataFrame) -> DataFrame:
    """Every node takes the least colour that a step brings; steps lead from each node to itself, too."""
    return colour.join(dealt(steps), ["way", "id"]).groupBy("way", F.col("to").alias("id")).agg(F.min("c").alias("c"))


def _colours(edges: DataFrame) -> DataFrame:
    """(id, f, b) of the ends of numbered edges, written: the least number among a node and all that lead to
    it, and among it and all that it leads to. Both spread together, HOPS edges between two writes."""
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    ways = nodes.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), "id")
    ahead = F.struct(F.lit(0).alias("way"), F.col("src").alias("id"), F.col("dst").alias("to"))
    back = F.struct(F.lit(1).alias("way"), F.col("dst").alias("id"), F.col("src").alias("to"))
    steps = stored(edges.select(F.inline(F.array(ahead, back))).unionByName(ways.withColumn("to", F.col("id"))))
    colour, mark, last = steps.filter("id = to").select("way", "id", F.col("id").alias("c")), None, 0
    while mark != last:
        old, last = colour, mark
        for _ in range(HOPS):
            colour = _hop(colour, steps)
        colour, mark = _observed(colour, F.sum(F.col("c").cast("decimal(38,0)")))  # colours only fall
        dropped(old)
    one = lambda way: F.min(F.when(F.col("way") == way, F.col("c")))
    out = stored(colour.groupBy("id").agg(one(0).alias("f"), one(1).alias("b")))
    dropped(colour, steps)
    return out


def _folded(edges: DataFrame) -> tuple[DataFrame, int, list[DataFrame], list[DataFrame]]:
    """Numbered edges with one for each chain of nodes that have one edge in and one out, written; how many; the
    chains, as their nodes (id, first) and their ends (first, head, tail); and the nodes of circles that stand
    alone, with the least of each (id, c). Pointers are doubled, so rounds follow the logarithm of a chain's length."""
    one = lambda way, other, name: edges.groupBy("project_id", F.col(way).alias("id")).agg(F.count("*").alias("n"), F.min(other).alias(name)).filter("n = 1").drop("n")
    inner, found = _observed(one("dst", "src", "head").join(dealt(one("src", "dst", "tail")), NODE), F.count("*"))
    if not found:
        return edges, edges.count(), [], []
    behind = inner.join(dealt(inner.select(F.col("id").alias("head"), F.lit(True).alias("_in"))), "head", "left")
    open_ = F.sum(F.when(~F.col("done"), F.col("least").cast("decimal(38,0)") + 1))  # falls until only circles are open, whose least is known
    now, mark = _observed(behind.select("id", F.when(F.col("_in"), F.col("head")).otherwise(F.col("id")).alias("at"), F.col("id").alias("least"), F.col("_in").isNull().alias("done")), open_)
    last = None
    while mark and mark != last:
        far = now.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("least").alias("_least"), F.col("done").alias("_done"))
        on = now.filter("not done").join(dealt(far), "at").select("id", F.col("_at").alias("at"), F.least("least", "_least").alias("least"), F.col("_done").alias("done"))
        old, last = now, mark
        now, mark = _observed(on.unionByName(now.filter("done")), open_)
        dropped(old)
    nodes = now.filter("done").select("id", F.col("at").alias("first"))
    ends = inner.drop("head").join(dealt(inner.select(F.col("id").alias("tail"))), "tail", "left_anti").join(dealt(nodes), "id")
    ends = stored(ends.select("project_id", "first", "tail").join(dealt(inner.select(F.col("id").alias("first"), "head")), "first"))
    left = edges
    for side in ("src", "dst"):
        left = left.join(dealt(inner.select(F.col("id").alias(side))), side, "left_anti")
    left = left.select(*PAIR).unionByName(ends.filter("head <> tail").select("project_id", F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct()
    left, n = _observed(left, F.count("*"))
    dropped(inner)
    return left, n, [nodes, ends], [now.filter("not done").select("id", F.col("least").alias("c"))]


def _unfolded(known: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """known (id, c), and with it the nodes of chains whose two ends are in one component, written."""
    for end in ("head", "tail"):
        ends = ends.join(dealt(known.select(F.col("id").alias(end), F.col("c").alias(f"_{end}"))), end, "left")
    loops = stored(ends.withColumn("c", F.coalesce("_head", "head")).filter("c = coalesce(_tail, tail)").select("first", "c", F.col("_head").isNull().alias("lone")))
    lone = loops.filter("lone").select(F.col("c").alias("id"), "c").distinct()  # only circles hold such a head in a component
    out = stored(known.unionByName(nodes.join(dealt(loops), "first").select("id", "c")).unionByName(lone))
    dropped(loops)
    return out


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges both of whose ends have an edge in and one out, written, and how many."""
    inner = edges.select("src").join(dealt(edges.select(F.col("dst").alias("src"))), "src", "left_semi").distinct()
    rest = edges
    for side in ("src", "dst"):
        rest = rest.join(dealt(inner.withColumnRenamed("src", side)), side, "left_semi")
    return _observed(rest.select(*PAIR), F.count("*"))


def _scc_spread(edges: DataFrame, in_task: int = 0) -> DataFrame:
    """Nodes are numbered once, those of many edges in and out first, so that a large component's own node
    has its least number. Chains are folded to edges, so that colours do not walk along them. A component is found
    when the least number before its nodes is the least behind them; edges between nodes that differ in these
    are in no cycle. What is left of a project is finished in one task when it has up to in_task edges."""
    end = lambda c, i, o: F.struct(F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    fans = edges.filter("src <> dst").select("project_id", F.inline(F.array(end("dst", 1, 0), end("src", 0, 1)))).groupBy(*NODE).agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    # others are in no cycle of two or more; the six bits above a running number order them, with no sort
    few = F.shiftleft(63 - F.floor(F.log2(F.col("i") * F.col("o"))), 57)
    names = stored(fans.filter("i > 0 and o > 0").select(*NODE, (few + F.monotonically_increasing_id()).alias("n")))
    left = edges.filter("src <> dst")
    for side in ("src", "dst"):
        left = left.join(dealt(names.select("project_id", F.col("id").alias(side), F.col("n").alias(f"_{side}"))), ["project_id", side])
    left, now = _observed(left.select("project_id", F.col("_src").alias("src"), F.col("_dst").alias("dst")), F.count("*"))
    done, folds = [], []
    while now:
        whole = rest = left
        if in_task:
            large = _large(left, in_task)
            done.append(_scc_in_task(left.filter(~F.col("project_id").isin(large))).select("id", F.col("scc").alias("c")))
            if not large:
                break
            rest = left.filter(F.col("project_id").isin(large))
        before = rest.count()
        short, _, fold, circles = _folded(rest)
        folds += [fold] if fold else []
        done += circles
        left, now = _trimmed(short)
        dropped(*([short] if fold else []), *([] if in_task else [whole]))
        if now < 0.75 * before:
            continue
        whole, colour = left, _colours(left)
        done.append(colour.filter("f = b").select("id", F.col("f").alias("c")))
        other = colour.filter("f <> b")
        for side in ("src", "dst"):
            left = left.join(dealt(other.select(F.col("id").alias(side), F.col("f").alias(f"_f{side}"), F.col("b").alias(f"_b{side}"))), side)
        left, now = _observed(left.filter("_fsrc = _fdst and _bsrc = _bdst").select(*PAIR), F.count("*"))
        dropped(whole)
    every = edges.select("project_id", F.col("src").alias("id")).unionByName(edges.select("project_id", F.col("dst").alias("id"))).distinct()
    if not done:
        return every.withColumn("scc", F.col("id"))
    known = reduce(DataFrame.unionByName, done)
    for fold in reversed(folds):
        known = _unfolded(stored(known), *fold)
    marks = stored(names.join(dealt(known.withColumnRenamed("id", "n")), "n"))
    # a component's nodes are dealt out over SHARES tasks, each with the component's least node
    share = marks.groupBy("c").agg(F.min("id").alias("scc"), F.count("*").alias("_size")).filter("_size > 1")
    share = share.select("c", "scc", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    found = marks.withColumn("_share", F.pmod(F.xxhash64("n"), F.lit(SHARES)).cast("int")).join(dealt(share), ["c", "_share"]).select(*NODE, "scc")
    return every.join(dealt(found), NODE, "left").select(*NODE, F.coalesce("scc", "id").alias("scc"))


def _large(edges: DataFrame, in_task: int) -> list:
    """Projects of more than in_task edges: at most one for each so many edges."""
    return [r["project_id"] for r in edges.groupBy("project_id").count().filter(F.col("count") > in_task).select("project_id").collect()]


def scc(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(project_id, id, scc) of the nodes with an edge; scc is the component's least node.

    Projects of up to in_task edges are each found in one task; larger ones by distributed
    colouring, in rounds that follow the longest shortest path, until so few edges are left."""
    e = edges.select(*PAIR).distinct()
    if not in_task:
        return _scc_spread(stored(e))
    large = _large(e, in_task)
    if not large:
        return _scc_in_task(e)
    e = stored(e)
    inside = F.col("project_id").isin(large)
    return _scc_in_task(e.filter(~inside)).unionByName(_scc_spread(e.filter(inside), in_task))


def cycle_edges(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Edges with `cycle`: a self edge, or both ends in one component."""
    e = edges.select(*PAIR).distinct()
    for side, name in (("src", "_cs"), ("dst", "_cd")):
        e = e.join(dealt(comp.select("project_id", F.col("id").alias(side), F.col("scc").alias(name))), ["project_id", side])
    return e.select(*PAIR, (F.col("_cs") == F.col("_cd")).alias("cycle"))


def in_cycles(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(project_id, id) of nodes in a component of two or more, or with a self edge."""
    big = comp.join(dealt(comp.groupBy("project_id", "scc").count().filter("count > 1")), ["project_id", "scc"], "left_semi").select(*NODE)
    own = edges.filter("src = dst").select("project_id", F.col("src").alias("id"))
    return big.unionByName(own).distinct()


def cycle_count(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(project_id, cycles): components of two or more, plus self edges."""
    big = comp.groupBy("project_id", "scc").count().filter("count > 1").select("project_id")
    own = edges.filter("src = dst").select(*PAIR).distinct().select("project_id")
    return big.unionByName(own).groupBy("project_id").agg(F.count("*").alias("cycles"))


def issues(in_cycle: Column, complexity: Column, fan_out: Column, fan_in: Column) -> Column:
    one = lambda cond, code, value: F.when(cond, F.struct(F.lit(code).alias("code"), value.cast("int").alias("value")))
    found = F.array(
        one(in_cycle, "cycle", F.lit(None)), one(complexity >= 10, "complexity", complexity), one(fan_out >= 5, "fanOut", fan_out), one(fan_in >= 5, "fanIn", fan_in)
    )
    return F.filter(found, lambda x: x.isNotNull())


def scored(nodes: DataFrame, edges: DataFrame, in_task: int = IN_TASK, comp: DataFrame | None = None) -> DataFrame:
    """nodes with fan_in, fan_out, in_cycle, issues, level and score. comp: the known edges' components, if
    the caller has them."""
    e = stored(known_edges(nodes, edges))
    cyc = in_cycles(e, stored(scc(e, in_task)) if comp is None else comp).withColumn("in_cycle", F.lit(True))
    df = _fans(nodes, e).join(dealt(cyc), NODE, "left").fillna(False, ["in_cycle"])
    df = df.withColumn("issues", issues(F.col("in_cycle"), F.col("complexity"), F.col("fan_out"), F.col("fan_in")))
    level = F.when(F.col("in_cycle") | (F.col("complexity") >= 12), "hot").when(F.size("issues") > 0, "warn").otherwise("ok")
    score = F.col("in_cycle").cast("int") * 100 + F.col("complexity") * 3 + F.col("fan_in") + F.col("fan_out")
    return df.withColumn("level", level).withColumn("score", score.cast("bigint"))


def hotspots(scored_nodes: DataFrame, n: int = 20) -> DataFrame:
    """The n highest scores among nodes that are not ok; at most 200."""
    return scored_nodes.filter("level <> 'ok'").orderBy(F.desc("score"), "project_id", "id").limit(min(n, 200))


def overview(scored_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    per = scored_nodes.groupBy("project_id").agg(
        F.count("*").alias("functions"), F.count_if(F.col("level") == "hot").alias("hot"), F.count_if(F.col("level") == "warn").alias("warn"), F.count_if("in_cycle").alias("in_cycle")
    )
    return per.join(dealt(edges.select(*PAIR).distinct().groupBy("project_id").agg(F.count("*").alias("calls"))), "project_id", "left").fillna(0, ["calls"])


def neighbours(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project_id, id, role, other): callers and callees of the wanted nodes."""
    e = edges.select(*PAIR).distinct()
    callees = e.withColumnsRenamed({"src": "id", "dst": "other"}).withColumn("role", F.lit("callee"))
    callers = e.withColumnsRenamed({"dst": "id", "src": "other"}).withColumn("role", F.lit("caller"))
    return callees.unionByName(callers).join(wanted.select(*NODE).distinct(), NODE, "left_semi").select(*NODE, "role", "other")


def trace(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(project_id, start, id, depth): nodes within `depth` calls of each start, by breadth.

    Starts are searched 64 together: a node has one row for each 64 starts, whose bits say which of
    them have reached it; a depth's bits are joined by `or` and lose those that came before. Every depth's new
    bits are written once, and told apart at the end only."""
    e = stored(edges.select(*PAIR).distinct())
    place = F.monotonically_increasing_id()
    known = stored(starts.select(*NODE).distinct().withColumn("_n", place))
    known = known.select(*NODE, F.shiftright("_n", 6).alias("_set"), F.col("_n").bitwiseAND(63).cast("int").alias("_bit"))
    one = known.select(*NODE, "_set", F.expr("shiftleft(1L, _bit)").alias("bits"))
    key = ["project_id", "_set", "id"]
    frontier = stored(one.groupBy(*key).agg(F.bit_or("bits").alias("bits")))
    parts = [frontier.withColumn("depth", F.lit(0))]
    for d in range(1, depth + 1):
        step = frontier.withColumnRenamed("id", "src").join(e, ["project_id", "src"]).groupBy("project_id", "_set", F.col("dst").alias("id")).agg(F.bit_or("bits").alias("bits"))
        seen = reduce(DataFrame.unionByName, [p.select(*key, F.col("bits").alias("_seen")) for p in parts]).groupBy(*key).agg(F.bit_or("_seen").alias("_seen"))
        new = step.join(seen, key, "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("bigint")))))
        frontier = stored(new.filter("bits <> 0").select(*key, "bits"))
        if not frontier.limit(1).count():
            break
        parts.append(frontier.withColumn("depth", F.lit(d)))
    dropped(e)
    bits = F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(bits, b) & 1) = 1)")
    every = reduce(DataFrame.unionByName, parts).select(*key, "depth", F.explode(bits).alias("_bit"))
    return every.join(known.withColumnRenamed("id", "start"), ["project_id", "_set", "_bit"]).select("project_id", "start", "id", "depth")


def trace_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """(project_id, start, src, dst): the edges that a trace of this depth has walked."""
    near = reached.filter(F.col("depth") < depth).select("project_id", "start", F.col("id").alias("src"))
    return near.join(edges.select(*PAIR).distinct(), ["project_id", "src"]).select("project_id", "start", "src", "dst")


def trace_order(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(project_id, start, step, id, depth, revisit): preorder of a bounded walk, in each start's own
    subgraph; `revisit` says that the node was met before, anywhere."""
    reach = trace(edges, starts, depth)
    near = reach.join(edges.select(*PAIR).distinct().withColumnRenamed("src", "id"), NODE).filter(F.col("depth") < depth)
    near = reach.join(near.select("project_id", "start", "id", "dst"), ["project_id", "start", "id"], "left")
    kinds = dict(near.dtypes)

    def run(t: pa.Table) -> pa.Table:
        start, out = t.column("start")[0].as_py(), {}
        for a, b in zip(t.column("id").to_pylist(), t.column("dst").to_pylist(), strict=True):
            out.setdefault(a, set())
            if b is not None:
                out[a].add(b)
        rows, met, work = [], set(), [(start, 0)]
        while work:
            node, d = work.pop()
            rows.append((node, d, node in met))
            if node not in met:
                met.add(node)
                if d < depth:
                    work += [(x, d + 1) for x in sorted(out.get(node, ()), reverse=True)]
        n = len(rows)
        kind = t.schema.field("id").type
        return pa.table({
            "project_id": pa.repeat(t.column("project_id")[0], n), "start": pa.array([start] * n, kind), "step": pa.array(range(n), pa.int32()),
            "id": pa.array([r[0] for r in rows], kind), "depth": pa.array([r[1] for r in rows], pa.int32()), "revisit": pa.array([r[2] for r in rows]),
        })

    return near.groupBy("project_id", "start").applyInArrow(run, f"project_id {kinds['project_id']}, start {kinds['id']}, step int, id {kinds['id']}, depth int, revisit boolean")


def _layers_in_task(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Layers of whole projects, each in one task: nodes leave when all that lead to them have."""
    kinds = dict(nodes.dtypes)
    rows = nodes.select("project_id", F.col("id").alias("src"), F.lit(None).cast(kinds["id"]).alias("dst")).unionByName(edges.select(*PAIR))

    def run(t: pa.Table) -> pa.Table:
        out: dict = {}
        waits: dict = {}
        for a, b in zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True):
            out.setdefault(a, [])
            waits.setdefault(a, 0)
            if b is not None:
                out.setdefault(b, [])
                out[a].append(b)
                waits[b] = waits.get(b, 0) + 1
        layer = dict.fromkeys(out, 0)
        ready = [x for x, n in waits.items() if not n]
        while ready:
            x = ready.pop()
            for y in out[x]:
                layer[y] = max(layer[y], layer[x] + 1)
                waits[y] -= 1
                if not waits[y]:
                    ready.append(y)
        ids = pa.array(list(layer), t.schema.field("src").type)
        return pa.table({"project_id": pa.repeat(t.column("project_id")[0], len(ids)), "id": ids, "layer": pa.array(list(layer.values()), pa.int32())})

    return rows.groupBy("project_id").applyInArrow(run, f"project_id {kinds['project_id']}, id {kinds['id']}, layer int")


def _chains(edges: DataFrame) -> DataFrame:
    """(project_id, id, head, steps): nodes with one edge in and one out, and how far behind the last node
    that is not one of them each stands. Pointers are doubled, so rounds follow the logarithm of a
    chain's length; written."""
    ins = edges.groupBy("project_id", F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("head")).filter("n = 1")
    outs = edges.groupBy("project_id", F.col("src").alias("id")).count().filter("count = 1").select(*NODE)
    now = stored(ins.join(dealt(outs), NODE, "left_semi").select(*NODE, "head", F.lit(1).alias("steps"), F.lit(False).alias("done")))
    while now.filter("not done").limit(1).count():
        on = now.select("project_id", F.col("id").alias("head"), F.col("head").alias("_on"), F.col("steps").alias("_more"))
        new = now.join(dealt(on), ["project_id", "head"], "left")
        new = stored(new.select(*NODE, F.coalesce("_on", "head").alias("head"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), F.col("_on").isNull().alias("done")))
        dropped(now)
        now = new
    return now


def _layers_spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rounds over the nodes whose layer has risen: each sends its own and the edge's length along its
    edges. Chains are contracted to one edge of their length first, and their nodes placed at the end."""
    inner = _chains(edges)
    long = edges.join(dealt(inner.select("project_id", F.col("id").alias("dst"))), ["project_id", "dst"], "left_anti")
    long = long.join(dealt(inner.select("project_id", F.col("id").alias("src"), "head", "steps")), ["project_id", "src"], "left")
    long = long.groupBy("project_id", F.coalesce("head", "src").alias("id"), "dst").agg(F.max(F.coalesce("steps", F.lit(0)) + 1).alias("long"))
    long = stored(long)
    layer = stored(nodes.select(*NODE).join(dealt(inner.select(*NODE)), NODE, "left_anti").select(*NODE, F.lit(0).alias("layer")))
    risen = layer
    while True:
        sent = risen.join(dealt(long), NODE).groupBy("project_id", F.col("dst").alias("id")).agg(F.max(F.col("layer") + F.col("long")).alias("up"))
        now = stored(layer.join(dealt(sent), NODE, "left").select(*NODE, F.greatest("layer", F.coalesce("up", F.lit(0))).alias("layer"), (F.coalesce("up", F.lit(0)) > F.col("layer")).alias("risen")))
        dropped(layer)
        layer, risen = now.drop("risen"), now.filter("risen").drop("risen")
        layer.__dict__["stored_at"] = now.__dict__["stored_at"]
        if not risen.limit(1).count():
            break
    heads = layer.select("project_id", F.col("id").alias("head"), F.col("layer").alias("_above"))
    chained = inner.join(dealt(heads), ["project_id", "head"]).select(*NODE, (F.col("_above") + F.col("steps")).cast("int").alias("layer"))
    return layer.unionByName(chained)


def layers(nodes: DataFrame, marked: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(project_id, id, layer): the longest path to each node over edges that are in no cycle.

    Projects of up to in_task edges and nodes are each solved in one task; larger ones in rounds, as
    many as the longest path has edges once chains count as one."""
    n = nodes.select(*NODE).distinct()
    e = stored(marked.filter("not cycle").select(*PAIR))
    size = n.select("project_id").unionByName(e.select("project_id")).groupBy("project_id").count()
    large = size.filter(F.col("count") > in_task).select("project_id")
    if not large.limit(1).count():
        return _layers_in_task(n, e)
    large = stored(large)
    part = lambda df, how: df.join(large, "project_id", how)
    return _layers_in_task(part(n, "left_anti"), part(e, "left_anti")).unionByName(_layers_spread(part(n, "left_semi"), part(e, "left_semi")))


def layout(scored_nodes: DataFrame, layer: DataFrame) -> DataFrame:
    """Layered positions: columns by layer; within one, by score, then id."""
    w = Window.partitionBy("project_id", "layer").orderBy(F.desc("score"), "id")
    df = scored_nodes.join(dealt(layer), NODE).withColumn("row", F.row_number().over(w) - 1)
    return df.withColumns({"x": F.lit(130) + F.col("layer") * 230, "y": F.lit(78) + F.col("row") * 86})


def search(scored_nodes: DataFrame, text: str = "", hidden: list[str] = (), only_issues: bool = False) -> DataFrame:
    df = scored_nodes.filter(F.lower(F.concat_ws(" ", "name", "file")).contains(text.strip().lower())) if text.strip() else scored_nodes
    df = df.filter(~F.col("file").isin(*hidden)) if hidden else df
    return df.filter("level <> 'ok'") if only_issues else df


def induced(edges: DataFrame, visible: DataFrame) -> DataFrame:
    return known_edges(visible, edges)


def baseline_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """now's nodes against a saved baseline (id, complexity, score, level)."""
    b = before.select(*NODE, *[F.col(c).alias(f"old_{c}") for c in ("complexity", "score", "level")])
    df = now.join(dealt(b), NODE, "left")
    return df.select(
        *NODE, F.col("old_level").isNull().alias("is_new"), (F.col("complexity") - F.col("old_complexity")).cast("bigint").alias("d_complexity"),
        (F.col("score") - F.col("old_score")).cast("bigint").alias("d_score"), "old_level", "level",
    )


def dimmed(nodes: DataFrame, focus_file: str | None = None, traced: DataFrame | None = None) -> DataFrame:
    """nodes with `dimmed`: outside the focused file, or outside a trace(project_id, id), where given."""
    df = nodes.withColumn("dimmed", F.col("file") != focus_file if focus_file else F.lit(False))
    if traced is None:
        return df
    inside = traced.select(*NODE).distinct().withColumn("_in", F.lit(True))
    return df.join(inside, NODE, "left").withColumn("dimmed", F.col("dimmed") | F.col("_in").isNull()).drop("_in")


def dimmed_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """edges with `dimmed`: an end of theirs is, by dimmed(nodes)."""
    bright = shown.filter("not dimmed").select(*NODE)
    e = edges
    for side in ("src", "dst"):
        e = e.join(bright.withColumnRenamed("id", side).withColumn(f"_{side}", F.lit(True)), ["project_id", side], "left")
    return e.withColumn("dimmed", F.col("_src").isNull() | F.col("_dst").isNull()).drop("_src", "_dst")


def file_colours(nodes: DataFrame, palette: int = 8) -> DataFrame:
    """(project_id, file, colour): a project's files in order, each with a place in the palette."""
    files = nodes.select("project_id", "file").distinct()
    return files.withColumn("colour", ((F.row_number().over(Window.partitionBy("project_id").orderBy("file")) - 1) % palette).cast("int"))


def panel(scored_nodes: DataFrame) -> DataFrame:
    """(project_id, hot, warn, any_cycle) for the side panel."""
    return scored_nodes.groupBy("project_id").agg(F.count_if(F.col("level") == "hot").alias("hot"), F.count_if(F.col("level") == "warn").alias("warn"), F.bool_or("in_cycle").alias("any_cycle"))


def resolutions(edges: DataFrame) -> DataFrame:
    """(project_id, resolution, n): how edges were resolved; those without a word are `by-name`."""
    return edges.groupBy("project_id", F.coalesce("resolution", F.lit("by-name")).alias("resolution")).agg(F.count("*").alias("n"))
