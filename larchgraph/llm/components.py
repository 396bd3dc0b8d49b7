"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchgraph.llm.common import dropped, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _in_task(pairs: DataFrame) -> DataFrame:
    """The same of few pairs, by a union of sets; the least node stands for a set."""
    kind = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        node = pa.null()
        for batch in batches:
            node = batch.schema.field("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                one, two = root(u), root(v)
                above[max(one, two)] = min(one, two)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above), node), pa.array([root(x) for x in list(above)], node)], ["node", "component"])

    return pairs.repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b", in_task: int = 0) -> DataFrame:
    """(node, component) of every node that has an edge; component is its least node.

    Each round hangs a node's larger neighbours, then its smaller ones, on the least of them; the
    edges never become more, and the rounds grow with the logarithm of the longest path. Least
    neighbours are aggregated before the shuffle; a hot node's edges are the side of a join that
    may be split. Edges with a null end are ignored. Up to in_task edges, given or left by a round, are
    finished in one task."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    pairs = stored(pairs.filter("_a is not null and _b is not null and u <> v").select("u", "v").distinct())
    mark = _mark(pairs)
    while mark[0] > in_task:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs, old = stored(small.filter("u <> v").distinct()), pairs
        dropped(large, old)
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            return _in_task(pairs)
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
