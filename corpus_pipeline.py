"""A corpus pipeline: quality classifier, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns
of documents; each is written and read again before the next. `run` applies them to documents.
SQL cannot express the stages (a fitted model, token merges), so ORACLE_SQL is None and the tests
hold `run` against plain versions of each stage.

A null text counts as empty everywhere; line dedup turns it into an empty one. A null doc_id is a
document like others that near-dedup never removes; a null source is a source of its own. Rows equal
in doc_id and text count once from near-dedup on. Mixing drops texts without words. An empty table
gives no pieces; without labels of both kinds all documents are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchgraph.llm import line_dedup, mixing, near_dedup, packing, pairwise_quality
from larchgraph.llm.common import stored, table
from larchgraph.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicate stages take shingles of five words; duplicates have a similarity of 0.8 or more.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
LINE_DOCS, LINE_CHARS = 10, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good."""
    model = pairwise_quality.learn(docs, table(spark, sf_dir, "labels"))
    return pairwise_quality.scored(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows the text."""
    out = line_dedup.cleaned(docs, LINE_DOCS, LINE_CHARS)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, once."""
    found = stored(near_dedup.near_duplicates(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT).select("doc_id", "kept"))
    gone = found.filter("not kept").select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    again = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not again.limit(1).count():
        return left.select(*COLUMNS)
    twice = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(twice.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.curriculum(mixing.mix(docs)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, in the training order in which the mix was written. A document that the
    mix takes twice is packed twice."""
    return packing.pack_in_order(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
