"""What names stand for over files: imports, exports, re-exports, stars and aliases, by pointer jumping.

A name is a node: local (`L`, path, name), exported (`E`, path, name) or a whole module (`M`, path).
Each link makes a node point to another one, so names form chains of any length; pointers are doubled until
they stand at a chain's end, in rounds that follow the logarithm of its length, and names that go in
a circle end nowhere. `export *` is first closed over files, shortest way first, also by doubling.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchgraph.functions import paths as P
from larchgraph.functions.tables import dropped, stored

#: Between the parts of a node; no path or name has it.
_SEP = "\u0001"
#: Links of a project that one task follows; more are followed by rounds on Spark, with the same result.
IN_TASK = 200_000


def node(kind: str, path: Column | str, name: Column | str) -> Column:
    return F.concat_ws(_SEP, F.lit(kind), path, name)


def targets(df: DataFrame, files: DataFrame) -> DataFrame:
    """df(project_id, path, spec, ...) with target: the file that a relative specifier stands for."""
    specs = df.select("project_id", "path", "spec").distinct().filter(P.is_relative(F.col("spec")))
    tried = specs.withColumn("_base", P.join_relative(F.col("path"), F.col("spec")))
    tried = tried.select("project_id", "path", "spec", F.posexplode(F.concat(*[F.array(F.concat("_base", F.lit(s))) for s in P.SUFFIXES])).alias("_n", "target"))
    there = files.select("project_id", F.col("path").alias("target")).distinct()
    found = tried.join(there, ["project_id", "target"]).groupBy("project_id", "path", "spec").agg(F.min_by("target", "_n").alias("target"))
    return df.join(found, ["project_id", "path", "spec"])


def closure(edges: DataFrame) -> DataFrame:
    """(project_id, a, b, way): b can be reached from a; way is the least of the shortest ways, as the
    numbers of its edges. edges: project_id, a, b, n. Circles end; written."""
    best = lambda df: df.filter("a <> b").groupBy("project_id", "a", "b").agg(F.min(F.struct(F.size("way").alias("steps"), "way"))["way"].alias("way"))
    now = stored(best(edges.select("project_id", "a", "b", F.array(F.col("n").cast("int")).alias("way"))))
    size = now.count()
    while size:
        on = now.select("project_id", F.col("a").alias("b"), F.col("b").alias("c"), F.col("way").alias("rest"))
        longer = now.join(on, ["project_id", "b"]).select("project_id", "a", F.col("c").alias("b"), F.concat("way", "rest").alias("way"))
        new = stored(best(now.unionByName(longer)))
        dropped(now)
        now, old, size = new, size, new.count()
        if size == old:
            break
    return now


def jumped(pointers: DataFrame) -> DataFrame:
    """(project_id, node, end): where each node's chain ends. pointers: project_id, node, next, one for
    each node. Nodes that lead into a circle are left out; written."""
    now = stored(pointers.select("project_id", "node", "next", F.lit(False).alias("done")))
    left = now.count()
    while left:
        on = now.select("project_id", F.col("node").alias("next"), F.col("next").alias("_on"))
        moved = now.join(on, ["project_id", "next"], "left")
        new = stored(moved.select("project_id", "node", F.coalesce("_on", "next").alias("next"), F.col("_on").isNull().alias("done")))
        dropped(now)
        now, old, left = new, left, new.filter("not done").count()
        if left == old and left:
            # a chain that is longer has nodes that this round would have brought to its end
            break
    out = stored(now.filter("done").select("project_id", "node", F.col("next").alias("end")))
    dropped(now)
    return out


def _followed(rows: pd.DataFrame) -> pd.DataFrame:
    """The ends of one project's pointers, and of the exported names that are asked for over its stars."""
    stars: dict[str, list[str]] = {}
    for a, b in rows[rows.what == "star"].sort_values("n")[["node", "next"]].itertuples(index=False):
        stars.setdefault(a, []).append(b)
    pointer = dict(rows[rows.what == "pointer"][["node", "next"]].itertuples(index=False))
    wanted = {n for n in [*pointer.values(), *rows[rows.what == "asked"].node] if n not in pointer}
    for name in wanted:  # the nearest file that exports the name; of equally near ones the first by stars
        kind, path, symbol = [*name.split(_SEP), "", ""][:3]
        seen, front = {path}, [path] if kind == "E" and symbol != "default" else []
        while front:
            front = [b for a in front for b in stars.get(a, ()) if b not in seen and not seen.add(b)]
            hit = next((n for b in front if (n := _SEP.join(("E", b, symbol))) in pointer), None)
            if hit:
                pointer[name] = hit
                break
    end: dict[str, str | None] = {}
    for start in pointer:
        path, at = [], start
        while at in pointer and at not in end:
            path.append(at)
            end[at] = None  # of a circle, unless an end is found
            at = pointer[at]
        last = end[at] if at in end else at
        for n in path:
            end[n] = last
    found = [(n, e) for n, e in end.items() if e is not None]
    return pd.DataFrame({"project_id": rows.project_id.iloc[0], "node": [n for n, _ in found], "end": [e for _, e in found]}, dtype=object)


def ends(links: DataFrame, files: DataFrame, asked: DataFrame | None = None, in_task: int = IN_TASK) -> DataFrame:
    """(project_id, node, end) of names that lead elsewhere; written. links: project_id, path, kind, pos,
    name, spec, symbol (see extract.links); asked(project_id, node): exported names to look up besides."""
    symbol = F.when(F.col("symbol") == "*", node("M", "target", F.lit(""))).otherwise(node("E", "target", "symbol"))
    far = targets(links.filter("kind in ('import', 'reexport')"), files)
    far = far.select("project_id", "path", "pos", F.when(F.col("kind") == "import", node("L", "path", "name")).otherwise(node("E", "path", "name")).alias("node"), symbol.alias("next"))
    near = links.filter("kind in ('export', 'alias', 'instance')")
    near = near.select("project_id", "path", "pos", F.when(F.col("kind") == "export", node("E", "path", "name")).otherwise(node("L", "path", "name")).alias("node"), node("L", "path", "symbol").alias("next"))
    own = stored(far.unionByName(near).groupBy("project_id", "path", "node").agg(F.min_by("next", F.struct("pos", "next")).alias("next")))
    stars = targets(links.filter("kind = 'star'"), files).select("project_id", F.col("path").alias("a"), F.col("target").alias("b"), F.col("pos").alias("n"))
    pointers = own.select("project_id", "node", "next")
    most = own.groupBy("project_id").count().agg(F.max("count")).first()[0]
    if not most:
        return links.sparkSession.createDataFrame([], "project_id string, node string, end string")
    if most <= in_task:
        row = lambda df, what, n: df.select("project_id", F.lit(what).alias("what"), F.col(n[0]).alias("node"), (F.col(n[1]) if n[1] else F.lit(None).cast("string")).alias("next"), (F.col(n[2]) if n[2] else F.lit(0)).cast("int").alias("n"))
        rows = row(pointers, "pointer", ("node", "next", None)).unionByName(row(stars, "star", ("a", "b", "n")))
        rows = rows.unionByName(row(asked.distinct(), "asked", ("node", None, None))) if asked is not None else rows
        out = stored(rows.groupBy("project_id").applyInPandas(_followed, "project_id string, node string, end string"))
        dropped(own)
        return out
    reach = None
    if stars.limit(1).count():
        reach = closure(stars)
        parts = F.split("node", _SEP)
        wanted = own.select("project_id", F.col("next").alias("node"))
        wanted = (wanted.unionByName(asked.select("project_id", "node")) if asked is not None else wanted).distinct().withColumn("_p", parts)
        wanted = wanted.filter("_p[0] = 'E' and _p[2] <> 'default'").join(own.select("project_id", "node"), ["project_id", "node"], "left_anti")
        wanted = wanted.select("project_id", "node", F.col("_p")[1].alias("a"), F.col("_p")[2].alias("_name")).join(reach, ["project_id", "a"])
        wanted = wanted.withColumn("next", node("E", "b", "_name")).join(own.select("project_id", F.col("node").alias("next")), ["project_id", "next"], "left_semi")
        pointers = pointers.unionByName(wanted.groupBy("project_id", "node").agg(F.min_by("next", F.struct(F.size("way"), "way", "next")).alias("next")))
    out = jumped(pointers)
    dropped(own, *([reach] if reach is not None else []))
    return out


def at_end(df: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """df with kind, at and of: where the node in `column` leads, or the node itself."""
    known = found.select("project_id", F.col("node").alias(column), "end")
    parts = F.split(F.coalesce("end", column), _SEP)
    df = df.join(known, ["project_id", column], "left")
    return df.withColumns({"kind": F.get(parts, F.lit(0)), "at": F.get(parts, F.lit(1)), "of": F.get(parts, F.lit(2))}).drop("end")
