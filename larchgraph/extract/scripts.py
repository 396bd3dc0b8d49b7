"""Calls in the inline scripts of web pages, by built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: String literals go first, so that nothing inside them counts.
_STRING = r"""("([^"\\]|\\.)*"|'([^'\\]|\\.)*')"""
_CALL = r"([A-Za-z_$][\w$]*)\s*\(([^()]*)\)"


def script_calls(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a row for each call: callee and argument text."""
    body = F.explode(F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1))
    df = pages.withColumn("_script", body)
    df = df.withColumn("_call", F.explode(F.regexp_extract_all(F.regexp_replace("_script", _STRING, "''"), F.lit(_CALL), 0)))
    return df.select(*pages.columns, F.regexp_extract("_call", _CALL, 1).alias("callee"), F.regexp_extract("_call", _CALL, 2).alias("argument"))
