"""Exact quantiles of all groups at once, in bounded memory, by narrowing histograms.

A quantile asked for is a range of values and a rank inside it. Each round counts the range's values in
BINS parts, with the least and the greatest value of each, and keeps the part in which the rank falls,
until that part holds one value. No buffer grows with a group: a round makes at most BINS + 2 rows for
each group and rank, and a range shrinks by the factor BINS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larchgraph.functions.tables import dropped, stored

BINS = 1000


def quantiles(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], bins: int = BINS) -> DataFrame:
    """by and a column for each of ranks: the value at that rank, from 1, of the group's n values in
    order; a rank is a function of n. Nulls and NaN do not count; groups without values have no row; infinities
    are the outermost values. A rank below 1 or beyond n gives the first or the last value."""
    v = F.col("_v")
    key = [F.col(b).alias(f"_k{i}") for i, b in enumerate(by)]
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*key, F.col(value).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("what"), F.greatest(F.lit(1), F.least(F.col("n"), rank(F.col("n")))).cast("bigint").alias("rank")) for name, rank in ranks.items()]))
    state = stored(whole.select(*keys, asked.alias("_a"), "lo", "hi").select(*keys, "_a.what", "_a.rank", "lo", "hi"))
    done = [state.filter("lo = hi").select(*keys, "what", F.col("lo").alias("found"))]
    front = state.filter("lo < hi")
    spent = [state]
    while front.limit(1).count():
        same = [F.col(f"s{k}").eqNullSafe(F.col(k)) for k in keys]
        narrow = front.select(*[F.col(k).alias(f"s{k}") for k in keys], "what", "rank", "lo", "hi")
        within = rows.join(narrow, [*same, v.between(F.col("lo"), F.col("hi"))])
        # halves, so that no difference overflows; infinities have parts of their own
        finite = lambda c: F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), c)) / 2
        width = finite(F.col("hi")) - finite(F.col("lo"))
        share = F.when(width > 0, (finite(v) - finite(F.col("lo"))) / width).otherwise(0.0)
        bin_ = F.when(v == float("inf"), bins + 1).when(v == float("-inf"), -1).otherwise(F.least(F.lit(bins - 1), F.floor(share * bins))).cast("int")
        counts = within.groupBy(*keys, "what", bin_.alias("bin")).agg(F.first("rank").alias("rank"), F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = Window.partitionBy(*keys, "what").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        at = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("rank > before and rank <= before + n")
        new = stored(at.select(*keys, "what", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi"))
        spent.append(new)
        done.append(new.filter("lo = hi").select(*keys, "what", F.col("lo").alias("found")))
        front = new.filter("lo < hi")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = stored(out.groupBy(*keys).agg(*[F.max(F.when(F.col("what") == name, F.col("found"))).alias(name) for name in ranks]))
    dropped(*spent)
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *ranks)
