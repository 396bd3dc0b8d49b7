"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larchgraph.functions.tables import dropped, stored, table

__all__ = ["LOWER", "SPACE", "UPPER", "ascii_lower", "dropped", "fresh", "partitions", "stored", "table", "words"]

#: White space of the contracts: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The runs of characters that are not white space, as an array; null gives an empty one."""
    spaced = F.translate(F.coalesce(c, F.lit("")), SPACE, " " * len(SPACE))
    return F.array_remove(F.split(spaced, " "), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has, so that no column of df is lost."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
