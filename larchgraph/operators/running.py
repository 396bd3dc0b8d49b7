"""Running sums and numbering without a hot key: two-level prefix sums over range partitions.

Rows are range-partitioned by key and order, so a key of very many rows lies in several partitions. Each
adds up its own part of a key; the parts of a key, one for each partition, give each other their
offsets; a row's running sum is its offset and the sum inside its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larchgraph.functions.tables import stored


def running_sums(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column | str]) -> DataFrame:
    """df with a column for each of values: its sum over the rows of the same `by` up to this one in
    `order`. Rows that are equal in by and order count in some order of theirs."""
    part = "_part"
    ranged = df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id())
    ranged = stored(ranged.withColumns({name: F.coalesce(F.expr(v) if isinstance(v, str) else v, F.lit(0)).cast("bigint") for name, v in values.items()}))
    totals = ranged.groupBy(*by, part).agg(*[F.sum(n).alias(f"_t_{n}") for n in values])
    # a row for each key and partition that has some of it
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    key = [F.col(b).alias(f"_k_{b}") for b in by]
    offsets = totals.select(*key, F.col(part).alias("_k_part"), *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values])
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumns({n: F.sum(n).over(inside) for n in values})
    match = F.col(part) == F.col("_k_part")
    for b in by:
        match &= F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    out = own.join(offsets, match).withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in values})
    return out.drop(part, "_k_part", *[f"_k_{b}" for b in by], *[f"_o_{n}" for n in values])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """df with the number of each row among those of the same `by`, from 1 in `order`."""
    return running_sums(df, by, order, {name: F.lit(1)})
