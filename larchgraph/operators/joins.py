"""Guarded and ordered joins that resolution needs, over plain relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larchgraph.operators import running as R


def unique_match(probes: DataFrame, candidates: DataFrame, key: list[str], name: str, target: str) -> DataFrame:
    """key, target, resolution: the one candidate of a name in the probe's own scope (`same-file`),
    else the only one anywhere (`exact`); with several or none, no row.

    probes: key, scope and name; candidates: scope, name and target. Candidates are counted for
    each name before the join, so a frequent name costs one row, not one for each pair."""
    c = candidates.select("scope", name, target).distinct()
    once = lambda by: c.groupBy(*by).agg(F.min(target).alias("_t"), F.count("*").alias("_n"))
    near = once(["scope", name]).withColumnsRenamed({"_t": "_t1", "_n": "_n1"})
    far = once([name]).withColumnsRenamed({"_t": "_t2", "_n": "_n2"})
    df = probes.select(*key, "scope", name).join(near, ["scope", name], "left").join(far, name, "left")
    df = df.withColumn(target, F.when(F.col("_n1") == 1, F.col("_t1")).when(F.col("_n2") == 1, F.col("_t2")))
    df = df.withColumn("resolution", F.when(F.col("_n1") == 1, "same-file").otherwise("exact"))
    return df.filter(F.col(target).isNotNull()).select(*key, target, "resolution")


def prefixes(path, sep: str):
    """Every prefix of a separated path that ends at a separator or its end, shortest first."""
    parts = F.split(path, sep if len(sep) > 1 else f"[{sep}]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def longest_prefix(probes: DataFrame, bindings: DataFrame, key: list[str], path: str, local: str, value: str, sep: str = ".") -> DataFrame:
    """key, local, value: the binding whose name is the longest prefix of the probe's path. Prefixes
    are exploded, so the join is on equality; bindings of equal name keep the least value."""
    b = bindings.groupBy(local).agg(F.min(value).alias(value))
    tried = probes.select(*key, F.posexplode(prefixes(F.col(path), sep)).alias("_n", local))
    return tried.join(b, local).groupBy(*key).agg(F.max_by(F.struct(local, value), "_n").alias("_b")).select(*key, f"_b.{local}", f"_b.{value}")


def prefix_split(probes: DataFrame, targets: DataFrame, key: list[str], path: str, target: str, sep: str = ".") -> DataFrame:
    """key, target: targets (module, owner) met by some split of the probe's dotted path in two."""
    parts = F.split(F.col(path), f"[{sep}]")
    cut = probes.select(*key, parts.alias("_p")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_p"))))
    cut = cut.select(*key, F.array_join(F.slice("_p", 1, F.col("_n")), sep).alias("module"), F.array_join(F.slice("_p", F.col("_n") + 1, F.size("_p")), sep).alias("owner"))
    return cut.join(targets.select("module", "owner", target).distinct(), ["module", "owner"]).select(*key, target).distinct()


def first_match(probes: DataFrame, known: DataFrame, key: list[str], base: str, suffixes: tuple[str, ...], path: str = "path") -> DataFrame:
    """key, path: the known path that is base plus the earliest of the suffixes."""
    tried = probes.select(*key, base, F.posexplode(F.array(*[F.lit(s) for s in suffixes])).alias("_n", "_s"))
    tried = tried.select(*key, "_n", F.concat(base, "_s").alias(path))
    return tried.join(known.select(path).distinct(), path).groupBy(*key).agg(F.min_by(path, "_n").alias(path))


def unique_ids(rows: DataFrame, scope: list[str], base: str, line: str, order: list[str], bounded: bool = False) -> DataFrame:
    """rows with `uid`: base, then base@line for a later one, then base@line-2 and so on. A base is
    numbered by running sums over ranges, so that no task sorts all of it; bounded says that a scope is
    small, a file's definitions say, and is sorted as it is."""

    def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
        if bounded:
            return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return R.numbered(df, by, order, name)

    df = numbered(rows, [*scope, base], "_nth").withColumn("_later", F.col("_nth") > 1)
    df = numbered(df, [*scope, base, line, "_later"], "_again")
    at = F.concat(F.col(base), F.lit("@"), F.col(line))
    uid = F.when(~F.col("_later"), F.col(base)).when(F.col("_again") == 1, at).otherwise(F.concat(at, F.lit("-"), F.col("_again")))
    return df.withColumn("uid", uid).drop("_nth", "_again", "_later")
