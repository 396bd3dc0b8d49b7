"""What a deletion breaks. Changes are rows (change_id, project_id, kind, target): many are
simulated in one job. Only what a change touches is worked out again: neighbours of what goes, and
the cycles that it was part of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larchgraph.functions import paths as P
from larchgraph.functions.tables import dealt, stored
from larchgraph.operators import graph as G

#: Changes whose bits are searched together.
CHANGES = 1024


def removed(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(change_id, project_id, id): the function itself, or all functions of the file."""
    n = nodes.select("project_id", "id", F.col("file"))
    one = changes.filter("kind = 'delete-function'").join(n.withColumn("target", F.col("id").cast("string")), ["project_id", "target"])
    whole = changes.filter("kind = 'delete-file'").withColumn("file", P.normal_path(F.col("target"))).join(n, ["project_id", "file"])
    return one.select("change_id", "project_id", "id").unionByName(whole.select("change_id", "project_id", "id")).distinct()


def outcomes(changes: DataFrame, gone: DataFrame) -> DataFrame:
    """(change_id, found, n_removed); a file without functions is not found."""
    n = gone.groupBy("change_id").agg(F.count("*").alias("n_removed"))
    df = changes.select("change_id").join(n, "change_id", "left").fillna(0, ["n_removed"])
    return df.select("change_id", (F.col("n_removed") > 0).alias("found"), "n_removed")


def _touching(gone: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges into what is removed, from what stays."""
    into = edges.select(*G.PAIR).distinct().join(dealt(gone.withColumnRenamed("id", "dst")), ["project_id", "dst"])
    return into.join(dealt(gone.withColumnRenamed("id", "src")), ["change_id", "project_id", "src"], "left_anti")


def broken_callers(gone: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(change_id, project_id, id, lost, callees, fan_out_before, fan_out_after, file): callees are the
    names of what a caller loses, in order."""
    names = F.array_sort(F.collect_set(P.function_name(F.col("dst").cast("string")))).alias("callees")
    hit = _touching(gone, edges).groupBy("change_id", "project_id", F.col("src").alias("id")).agg(F.count("*").alias("lost"), names)
    fans = G.degrees(nodes, edges).select("project_id", "id", "file", F.col("fan_out").alias("fan_out_before"))
    return hit.join(fans, ["project_id", "id"]).withColumn("fan_out_after", F.col("fan_out_before") - F.col("lost"))


def by_loss(broken: DataFrame) -> DataFrame:
    """Broken callers, those that lose most first."""
    return broken.orderBy("change_id", F.desc("lost"), "id")


def shadow(gone: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each change's remaining graph, with change_id as the project."""
    projects = gone.select("change_id", "project_id").distinct()
    left = nodes.join(projects, "project_id").join(gone, ["change_id", "project_id", "id"], "left_anti")
    e = edges.select(*G.PAIR).distinct().join(projects, "project_id")
    for side in ("src", "dst"):
        e = e.join(dealt(gone.withColumnRenamed("id", side)), ["change_id", "project_id", side], "left_anti")
    rename = lambda df: df.drop("project_id").withColumnRenamed("change_id", "project_id")
    return rename(left), rename(e).select(*G.PAIR)


def _lost_callers(gone: DataFrame, edges: DataFrame) -> DataFrame:
    """(change_id, project_id, id, lost_in): callers that nodes which stay lose."""
    out = edges.select(*G.PAIR).distinct().join(dealt(gone.withColumnRenamed("id", "src")), ["project_id", "src"])
    out = out.join(dealt(gone.withColumnRenamed("id", "dst")), ["change_id", "project_id", "dst"], "left_anti")
    return out.groupBy("change_id", "project_id", F.col("dst").alias("id")).agg(F.count("*").alias("lost_in"))


def newly_orphaned(gone: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(change_id, id): called before, by nobody that is left, and not removed itself."""
    e = G.known_edges(nodes, edges)
    before = e.groupBy("project_id", F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    return _lost_callers(gone, e).join(before, ["project_id", "id"]).filter("fan_in = lost_in").select("change_id", "id")


def affected_tests(broken: DataFrame) -> DataFrame:
    """(change_id, file): test files that hold a broken caller."""
    return broken.filter(P.is_test(F.col("file"))).select("change_id", "file").distinct()


def _spread(start: dict[int, int], allowed: list[int], to: list[list[int]]) -> dict[int, int]:
    """Bits carried along the arcs from `start`, at each node those that are allowed there."""
    reach, todo = dict(start), list(start)
    while todo:
        u = todo.pop()
        bits = reach[u]
        for w in to[u]:
            new = bits & allowed[w] & ~reach.get(w, 0)
            if new:
                reach[w] = reach.get(w, 0) | new
                todo.append(w)
    return reach


def cycle_bits(n: int, arcs: list[tuple[int, int]], alive: list[int]) -> list[int]:
    """For each of n nodes the bits with which it is in a cycle; an arc has the bits that both its ends
    have. All bits are searched together: what has no arc in or out is trimmed, a pivot's forward and backward
    reach give its component, and what only one of them, or neither, reaches is searched on by itself."""
    out: list[list[int]] = [[] for _ in range(n)]
    into: list[list[int]] = [[] for _ in range(n)]
    looped = [0] * n
    for u, w in arcs:
        if u == w:
            looped[u] = alive[u]
        else:
            out[u].append(w)
            into[w].append(u)
    found = list(looped)
    work = [dict(enumerate(alive))]
    while work:
        part = {v: bits for v, bits in work.pop().items() if bits}
        todo = set(part)
        while todo:  # trim
            v = todo.pop()
            bits = part.get(v, 0)
            if not bits:
                continue
            ahead = behind = 0
            for w in out[v]:
                ahead |= part.get(w, 0)
            for w in into[v]:
                behind |= part.get(w, 0)
            if bits & ~(ahead & behind):
                part[v] = bits & ahead & behind
                todo.update(w for w in (*out[v], *into[v]) if part.get(w))
        part = {v: bits for v, bits in part.items() if bits}
        if not part:
            continue
        allowed = [0] * n
        for v, bits in part.items():
            allowed[v] = bits
        # each bit has the pivot of the node with most bits that has it
        pivots, left = {}, 0
        for bits in part.values():
            left |= bits
        for v in sorted(part, key=lambda v: -part[v].bit_count()):
            if mine := part[v] & left:
                pivots[v] = mine
                left &= ~mine
        forward, backward = _spread(pivots, allowed, out), _spread(pivots, allowed, into)
        rest: tuple[dict, dict, dict] = {}, {}, {}
        for v, bits in part.items():
            f, b = forward.get(v, 0), backward.get(v, 0)
            found[v] |= f & b  # after trimming a pivot has an arc in and out; alone it is no cycle
            for k, some in enumerate((f & ~b, b & ~f, bits & ~f & ~b)):
                if some:
                    rest[k][v] = some
        for v, mine in pivots.items():  # a pivot that is its whole component is in no cycle
            company = 0
            for w in out[v]:
                company |= forward.get(w, 0) & backward.get(w, 0)
            alone = mine & ~company
            if alone:
                found[v] &= ~(alone & ~looped[v])
        work += [r for r in rest if r]
    return found


def _left_in_task(t: pa.Table) -> pa.Table:
    """(change_id, id): nodes of one component that a change takes out of every cycle. Rows are the
    component's arcs (src, dst), and (change_id, src) of what a change removes."""
    is_arc = np.array([x is None for x in t.column("change_id").to_pylist()])
    src, dst, change = (t.column(c).to_pylist() for c in ("src", "dst", "change_id"))
    ids = sorted({x for i in np.flatnonzero(is_arc) for x in (src[i], dst[i])})
    number = {x: i for i, x in enumerate(ids)}
    arcs = [(number[src[i]], number[dst[i]]) for i in np.flatnonzero(is_arc)]
    gone: dict = {}
    for i in np.flatnonzero(~is_arc):
        gone.setdefault(change[i], set()).add(number[src[i]])
    told, nodes = [], []
    changes = sorted(gone)
    for lo in range(0, len(changes), CHANGES):
        some = changes[lo : lo + CHANGES]
        full = (1 << len(some)) - 1
        alive = [full] * len(ids)
        for k, c in enumerate(some):
            for v in gone[c]:
                alive[v] &= ~(1 << k)
        still = cycle_bits(len(ids), arcs, alive)
        for v, bits in enumerate(still):
            lost = alive[v] & ~bits
            while lost:
                k = (lost & -lost).bit_length() - 1
                told.append(some[k])
                nodes.append(ids[v])
                lost &= lost - 1
    schema = t.schema
    return pa.table({"change_id": pa.array(told, schema.field("change_id").type), "id": pa.array(nodes, schema.field("src").type)})


def _cycles_left(gone: DataFrame, before: DataFrame, edges: DataFrame, comp: DataFrame, in_task: int) -> DataFrame:
    """(change_id, project_id, id, still): the nodes that a change takes out of every cycle, still being
    false. A component of up to in_task arcs is searched once, in one task, for all the changes that touch it,
    with a bit for each; of a larger one each change's part is a graph of its own on Spark."""
    big = comp.join(dealt(before.filter("in_cycle").select(*G.NODE)), G.NODE, "left_semi")
    touched = stored(gone.join(dealt(big), G.NODE).select("change_id", "project_id", "scc", "id"))
    e = edges
    for side in ("src", "dst"):
        e = e.join(dealt(big.select("project_id", F.col("id").alias(side), F.col("scc").alias(f"_{side}"))), ["project_id", side])
    e = e.filter("_src = _dst").select(*G.PAIR, F.col("_src").alias("scc"))
    e = stored(e.join(touched.select("project_id", "scc").distinct(), ["project_id", "scc"], "left_semi"))
    large = e.groupBy("project_id", "scc").count().filter(F.col("count") > in_task).select("project_id", "scc")
    kinds = {f.name: f.dataType.simpleString() for f in e.schema} | {"change_id": gone.schema["change_id"].dataType.simpleString()}
    small = lambda df: df.join(large, ["project_id", "scc"], "left_anti")
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows = small(e).select("project_id", "scc", none("change_id"), "src", "dst")
    rows = rows.unionByName(small(touched).select("project_id", "scc", "change_id", F.col("id").alias("src"), none("dst")))
    project = f"project_id {kinds['project_id']}, change_id {kinds['change_id']}, id {kinds['src']}"

    def one(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        out = _left_in_task(t)
        return out.add_column(0, "project_id", pa.array([key[0].as_py()] * len(out), t.schema.field("project_id").type))

    lost = rows.groupBy("project_id", "scc").applyInArrow(one, project).select("change_id", "project_id", "id", F.lit(False).alias("still"))
    if not large.limit(1).count():
        return lost
    changes = touched.join(large, ["project_id", "scc"]).select("change_id", "project_id", "scc").distinct()
    members = changes.join(dealt(big), ["project_id", "scc"]).join(dealt(gone), ["change_id", "project_id", "id"], "left_anti")
    e = e.join(changes, ["project_id", "scc"])
    for side in ("src", "dst"):
        e = e.join(dealt(gone.withColumnRenamed("id", side)), ["change_id", "project_id", side], "left_anti")
    e = stored(e.select(F.struct("change_id", "project_id", "scc").alias("k"), "src", "dst").select(F.to_json("k").alias("project_id"), "src", "dst"))
    cyc = G.in_cycles(e, G.scc(e)).withColumnRenamed("project_id", "_k")
    members = members.withColumn("_k", F.to_json(F.struct("change_id", "project_id", "scc")))
    out = members.join(dealt(cyc), ["_k", "id"], "left_anti").select("change_id", "project_id", "id", F.lit(False).alias("still"))
    return lost.unionByName(out)


def metric_delta(gone: DataFrame, nodes: DataFrame, edges: DataFrame, in_task: int = G.IN_TASK) -> DataFrame:
    """(change_id, functions, in_cycle and flagged, each before and after): a project's counts, and
    for each change the difference that its touched nodes make."""
    gone, e = stored(gone), stored(G.known_edges(nodes, edges))
    comp = stored(G.scc(e))
    before = stored(G.scored(nodes, e, comp=comp).select(*G.NODE, "complexity", "fan_in", "fan_out", "in_cycle", "level"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    whole = before.groupBy("project_id").agg(F.count("*").alias("functions_before"), F.count_if("in_cycle").alias("in_cycle_before"), F.count_if(F.col("level") != "ok").alias("flagged_before"))
    lost_out = _touching(gone, e).groupBy("change_id", "project_id", F.col("src").alias("id")).agg(F.count("*").alias("lost_out"))
    cycles = _cycles_left(gone, before, e, comp, in_task)
    touched = gone.withColumn("gone", F.lit(True))
    for part in (_lost_callers(gone, e), lost_out, cycles):
        touched = touched.join(dealt(part), ["change_id", "project_id", "id"], "full_outer")
    t = touched.join(dealt(before), G.NODE).fillna(0, ["lost_in", "lost_out"]).withColumn("stays", F.col("gone").isNull())
    after = F.coalesce("still", "in_cycle")
    flagged = after | (F.col("complexity") >= 10) | (F.col("fan_out") - F.col("lost_out") >= 5) | (F.col("fan_in") - F.col("lost_in") >= 5)
    change = t.groupBy("change_id", "project_id").agg(
        F.sum(flag(~F.col("stays"))).alias("_f"), F.sum(flag(F.col("in_cycle")) - flag(F.col("stays") & after)).alias("_c"), F.sum(flag(F.col("level") != "ok") - flag(F.col("stays") & flagged)).alias("_l")
    )
    out = change.join(whole, "project_id")
    counts = [(F.col(f"{n}_before") - F.col(c)).alias(f"{n}_after") for n, c in (("functions", "_f"), ("in_cycle", "_c"), ("flagged", "_l"))]
    return out.select("change_id", "functions_before", "in_cycle_before", "flagged_before", *counts)


def _few(df: DataFrame, n: int, order: list) -> DataFrame:
    """(change_id, names, n): the names of the first n rows of each change, and how many rows there are."""
    w = Window.partitionBy("change_id").orderBy(*order)
    first = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    listed = first.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("_r", P.function_name(F.col("id").cast("string")).alias("name")))).alias("l"))
    return df.groupBy("change_id").agg(F.count("*").alias("n")).join(listed, "change_id").select("change_id", "n", F.transform("l", lambda x: x["name"]).alias("names"))


def summary_lines(found: DataFrame, broken: DataFrame, orphaned: DataFrame, tests: DataFrame, delta: DataFrame) -> DataFrame:
    """(change_id, line, text): a short report of each change of outcomes(); lists show their first five,
    and the calls that the three callers with the largest losses keep are told."""
    some = lambda names, n: F.concat(F.array_join(names, ", "), F.when(n > 5, "\u2026").otherwise(""))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    b = _few(broken, 5, [F.desc("lost"), "id"]).select("change_id", F.col("n").alias("bn"), some(F.col("names"), F.col("n")).alias("b"))
    o = _few(orphaned, 5, ["id"]).select("change_id", F.col("n").alias("on"), some(F.col("names"), F.col("n")).alias("o"))
    t = tests.groupBy("change_id").agg(F.count("*").alias("tn"))
    df = found.join(b, "change_id", "left").join(o, "change_id", "left").join(t, "change_id", "left").join(delta, "change_id", "left")
    lines = F.array(
        F.when(~F.col("found"), text("target not found")).otherwise(text("removed functions: ", F.col("n_removed"))),
        F.when(F.col("found"), F.when(F.col("bn").isNull(), text("no caller breaks")).otherwise(text("broken callers: ", F.col("bn"), ": ", F.col("b")))),
        F.when(F.col("on").isNotNull(), text("without callers now: ", F.col("on"), ": ", F.col("o"))),
        F.when(F.col("tn").isNotNull(), text("test files concerned: ", F.col("tn"))),
        F.when(F.col("found"), text("functions in cycles: ", F.col("in_cycle_before"), " to ", F.col("in_cycle_after"))),
        F.when(F.col("found"), text("flagged functions: ", F.col("flagged_before"), " to ", F.col("flagged_after"))),
    )
    calls = text("calls of ", P.function_name(F.col("id").cast("string")), ": ", F.col("fan_out_before"), " to ", F.col("fan_out_after"))
    ranked = broken.withColumn("_r", F.row_number().over(Window.partitionBy("change_id").orderBy(F.desc("lost"), "id")))
    top = ranked.filter("_r <= 3 and fan_out_before <> fan_out_after").groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("_r", calls.alias("said")))).alias("_fans"))
    df = df.join(top, "change_id", "left")
    lines = F.concat(lines, F.coalesce(F.transform("_fans", lambda x: x["said"]), F.array().cast("array<string>")))
    return df.select("change_id", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line", "text"))
