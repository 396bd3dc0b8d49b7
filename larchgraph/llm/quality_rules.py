"""Operator 10: quality rules, a threshold table compiled into one Spark projection.

Every measure is an integer built from the whole text with built-in functions. A rule compares
`scale * measure` with `bound * per` in integers, so equal inputs give equal verdicts everywhere.

Null and empty texts have no words: all measures are 0 and the base rules reject them. Rows are
judged one by one, so repeated rows repeat their result; columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchgraph.llm.common import SPACE, ascii_lower, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus' four languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on at this are from or an have not "
    "le la les de des du et un une que qui en au aux il elle pour par sur dans ne pas est "
    "der die das und ein eine ist von zu den dem mit auf sich nicht als auch es im am "
    "el los las y del se por con para su al lo como más o pero sus este esta son"
).split()


class Rule(NamedTuple):
    """Holds where scale * measure <= bound * per (at most) or >= (not at_most)."""

    name: str
    measure: str
    scale: int
    at_most: bool
    bound: int
    per: str


#: The threshold table.
RULES = (
    Rule("short_words", "word_chars", 10, False, 15, "n_words"),
    Rule("long_words", "word_chars", 10, True, 150, "n_words"),
    Rule("symbols", "n_symbols", 100, True, 10, "n_words"),
    Rule("stop_words", "n_stop_words", 100, False, 3, "n_words"),
    Rule("dup_lines", "n_dup_lines", 100, True, 30, "n_lines"),
    Rule("bullets", "n_bullet_lines", 100, True, 90, "n_lines"),
    Rule("ellipses", "n_ellipsis_lines", 100, True, 30, "n_lines"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for the row. A lambda that reads an expression from
    outside computes it again for every element, also where the optimiser puts it there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(w: Column) -> Column:
    """The hash of each 3-word window; none for fewer than 4 words, where none can repeat."""
    some = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 4, some).otherwise(F.array().cast("array<bigint>"))


def _repeat_starts(pairs: Column) -> Column:
    """Starts of the windows found twice or more, in order, from (hash, start) pairs sorted by
    hash, where a window stands beside its equals."""
    same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """Words inside those windows: 3 from each start, or as many as the next start leaves."""
    gaps = F.transform(starts, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - x, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words(w: Column) -> Column:
    def of(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = _let(pairs, lambda s: _let(_repeat_starts(s), _covered))
        # most texts repeat no window: the cheap test on plain hashes spares them the sort of pairs
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(found)

    return _let(_let(w, _windows), of)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of MEASURES added (an own column of such a name gives way)."""
    df = df.drop(*[c for c in df.columns if c in MEASURES or c.startswith("_qr_")])
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_qr_w", words(body)).withColumn(
        "_qr_l", F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    )
    w, lines, n = F.col("_qr_w"), F.col("_qr_l"), F.size("_qr_w")
    long = lambda c: c.cast("long")
    return df.withColumns(
        {
            "n_words": long(n),
            "word_chars": long(F.length(F.translate(body, SPACE, ""))),
            "n_symbols": long(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))),
            "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
            "n_repeat_words": _repeat_words(w),
            "n_stop_words": long(F.size(F.filter(w, lambda x: ascii_lower(x).isin(*STOP_WORDS)))),
            "n_lines": long(F.size(lines)),
            "n_bullet_lines": long(F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•")))),
            "n_ellipsis_lines": long(F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))),
        }
    ).drop("_qr_w", "_qr_l")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the measures."""
    holds = F.lit(True)
    for r in rules:
        left, right = F.col(r.measure) * r.scale, F.col(r.per) * r.bound
        holds = holds & ((left <= right) if r.at_most else (left >= right))
    return holds


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the measures, base_failed and kept."""
    df = df.drop("base_failed", "kept")
    return measure(df, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table as a SQL condition, for the oracle."""
    return " AND ".join(f"{r.scale} * {r.measure} {'<=' if r.at_most else '>='} {r.bound} * {r.per}" for r in rules)
