"""Operator 7: mixing sources to target weights by a time-varying curriculum (built-in functions).

Each source has a target, the words that the mix takes from it, and a schedule: its share of the
mix changes linearly over training, by `tilt` from start to end, and integrates to the target. A
source's documents, in a fixed shuffled order and repeated where the target exceeds the source,
lie on its cumulative demand; inverting the integrated schedule at a copy's middle gives the
moment of training at which it is due, and the whole mix is range-sorted by that position. The
words that a copy gives are the demand between the moments at which it begins and ends.

Nulls: a null text has size 0; a null source is a source of its own, ordered last. Documents of
size 0 are taken 0 times. Repeated rows are mixed as rows of their own. An empty table mixes to
an empty one. Sources without words have target 0. Extra columns pass through, whatever their
names; only size, source_size, target, taken and start are replaced, and copy and position in a
curriculum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larchgraph.llm.common import SPACE, fresh, partitions, stored

WEIGHTS = (5, 2, 1)
#: By place in the weights' cycle; positive ones come early.
TILTS = (0.5, 0.0, -0.5)
SHARE, MOST = 1.5, 2.0
#: The fewest buckets of a source's shuffled order; prefix sums cross them through a small table.
#: There are as many as two for each shuffle partition; results do not depend on their number.
BUCKETS = 256


def size_of(text: Column) -> Column:
    """Words of a text: starts of runs that are not white space."""
    spaced = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE)))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def targets(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: source, source_size, target.

    Water-filling: with all sources ordered by cap / weight, the capped ones come first; the
    level is found where what the caps leave, spread by weight, stays below the next cap. It is
    a function of the sources alone: one row each, after an aggregate with map-side sums."""
    per = df.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    ranked = per.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_turn", F.col("_cap") / F.col("_w"))
    upto = everything.orderBy("_turn", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("_total", F.sum("source_size").over(whole) * F.lit(share))
    ranked = ranked.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("_weights", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("_level", F.col("_left") / F.col("_weights"))
    # the first source, by turn, whose cap is above its level sets the level of all after it
    level = F.min(F.when(F.col("_turn") >= F.col("_level"), F.struct("_turn", "_rank", "_level"))).over(whole)["_level"]
    ranked = ranked.withColumn("_common", level)
    target = F.when(F.col("_common").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_common") * F.col("_w")))
    return ranked.select("source", "source_size", target.alias("target"), (F.col("_rank") % len(weights)).alias("_schedule"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, buckets: int = 0) -> DataFrame:
    """df with size, source_size, target, taken, start (words of the source before this row) and
    _schedule; columns of the caller with these names are replaced."""
    df = df.drop("size", "source_size", "target", "taken", "start", "_schedule").withColumn("size", size_of(F.col(text)))
    return _taken(df, targets(df, weights, share, most), key, text, buckets or max(BUCKETS, 2 * partitions(df.sparkSession)))


def _taken(df: DataFrame, goal: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    order, tie, bucket, upto, s, b, before = fresh(df, "order", "tie", "bucket", "upto", "of_source", "of_bucket", "before")
    df = df.withColumn(order, F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))).withColumn(tie, F.xxhash64(F.col(text)))
    df = df.withColumn(bucket, F.floor(F.conv(F.substring(order, 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int"))
    sums = df.groupBy("source", bucket).agg(F.sum("size").alias("n"))
    sofar = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias(s), F.col(bucket).alias(b), F.coalesce(F.sum("n").over(sofar), F.lit(0)).alias(before))
    starts = sums.join(goal, F.col(s).eqNullSafe(F.col("source"))).drop("source")
    own = Window.partitionBy("source", bucket).orderBy(order, tie, key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn(upto, F.sum("size").over(own))
    df = df.join(starts, F.col("source").eqNullSafe(F.col(s)) & (F.col(bucket) == F.col(b)))
    df = df.withColumn("start", F.col(before) + F.col(upto) - F.col("size"))
    # whole passes over the source, then a pass that ends at the target, inside one document
    full = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.round(F.col("target") - full * F.col("source_size")).cast("long")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    df = df.withColumn("taken", (full * F.col("size") + extra).cast("long"))
    return df.drop(order, tie, bucket, upto, s, b, before)


def _due(at: Column, target: Column, tilt: Column) -> Column:
    """The moment t in [0, 1] where target * (t + tilt * t * (1 - t)) = at."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), at / F.greatest(target, F.lit(1.0))))
    curved = ((1 + tilt) - F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) * (1 + tilt) - 4 * tilt * x))) / (2 * tilt)
    return F.when(F.abs(tilt) < 1e-9, x).otherwise(curved)


def _demand(t: Column, target: Column, tilt: Column) -> Column:
    """The words of a source that are due up to t, in whole words; _due inverts it."""
    return F.round(target * (t + tilt * t * (1 - t))).cast("long")


def _tilt(tilts: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in tilts]), (F.col("_schedule") % len(tilts) + 1).cast("int"))


def curriculum(mixed: DataFrame, tilts: tuple[float, ...] = TILTS, key: str = "doc_id") -> DataFrame:
    """The training order of what mix() took: a row for each copy, with copy and position.

    Copies are whole: the last pass takes a document whose larger part lies before the target.
    Ends range-sorted by position, ties by document and copy."""
    copies = F.when(F.col("size") > 0, F.floor((F.col("taken") + F.floor(F.col("size") / 2)) / F.col("size"))).otherwise(0).cast("int")
    df = mixed.drop("copy", "position").filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    middle = F.col("copy") * F.col("source_size") + F.col("start") + F.col("size") / 2
    df = df.withColumn("position", _due(middle, F.col("target"), _tilt(tilts)))
    return df.orderBy("position", key, "copy")


def exact_curriculum(mixed: DataFrame, tilts: tuple[float, ...] = TILTS, key: str = "doc_id") -> DataFrame:
    """Like curriculum(), to a word: the last copy of a source ends at the target, and `words` tells
    what each copy gives. Documents of which nothing is due stay, last, with null copy and words."""
    passes = F.ceil((F.round("target").cast("long") - F.col("start")) / F.greatest(F.col("source_size"), F.lit(1))).cast("int")
    due = F.when((F.col("size") > 0) & (passes > 0), F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1))
    df = mixed.drop("taken", "position", "words").withColumn("copy", F.explode_outer(due))
    begin = F.col("copy") * F.col("source_size") + F.col("start")
    moment = lambda at: _due(at, F.col("target"), _tilt(tilts))
    upto = lambda at: _demand(moment(at), F.col("target"), _tilt(tilts))
    df = df.withColumn("words", upto(begin + F.col("size")) - upto(begin))
    df = df.withColumn("position", F.when(F.col("copy").isNotNull(), moment(begin + F.col("words") / 2)))
    return df.orderBy(F.col("position").asc_nulls_last(), key, "copy")


def dealt(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each row of mixed, in training order: taken is the sum of its copies in the exact
    curriculum, which is written as it is sorted, and position the first of theirs."""
    row = [key, "source", "start", "size", "source_size", "target"]
    order = stored(exact_curriculum(mixed.select(*row, "_schedule"), key=key))
    # rows with words differ in source or start
    due = order.filter("copy is not null").groupBy(*row).agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    rest = order.filter("copy is null").select(*row, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("double").alias("position"))
    return due.unionByName(rest).orderBy(F.col("position").asc_nulls_last(), key)
