"""Boundary sets against sorted lists, and cut texts against a plain version."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larchgraph.llm import fill_in_middle as fim
from tests.llm.test_operators import ODD, docs

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MORE = ["<P> inside", "a<S", "P>b", "  lead and trail \n", "x" * 70_000 + " y " + "é " * 40_000, "a b " * 60_000, "word", "word", "\t\t", "日本 語　x"]


def plain(doc_id, text, unit="token", rate=50, spm=80):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("unit,rate,spm", [("token", 50, 80), ("token", 100, 50), ("char", 100, 50)])
def test_fill_in_middle_against_a_plain_version(spark, unit, rate, spm):
    texts = (ODD + MORE) * 3
    ids = [*range(len(texts) - 1), None]
    made = fim.fill_in_middle(docs(spark, texts, ids), unit=unit, rate=rate, spm=spm)
    assert {"size", "shard", "body", "part"} <= set(made.columns)
    back = fim.restored(F.col("output"), F.col("form"))
    for r in made.withColumn("back", back).collect():
        text = texts[-1] if r["doc_id"] is None else texts[r["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], text, unit, rate, spm)
        assert r["back"] == (text or "")
    assert fim.fill_in_middle(docs(spark, [])).count() == 0


def test_clashing_columns_are_replaced_and_others_kept(spark):
    df = docs(spark, ["a b c", None]).withColumn("n", F.lit("old")).withColumn("_hash", F.lit("mine")).withColumn("_cut", F.lit(1)).withColumn("FORM", F.lit(2))
    rows = fim.fill_in_middle(df).collect()
    assert {(r["n"], r["_hash"], r["_cut"]) for r in rows} == {(3, "mine", 1), (0, "mine", 1)}


def test_select_in_every_form_of_container():
    rng = np.random.default_rng(11)
    sets = [
        np.arange(200_000),  # runs over whole containers
        np.flatnonzero(rng.random(200_000) < 0.4),  # bitmaps
        np.flatnonzero(rng.random(300_000) < 0.001),  # arrays
        np.concatenate([np.arange(5, 9000), 65_536 + np.flatnonzero(rng.random(65_536) < 0.5), [400_000], np.arange(500_000, 500_003)]),
        np.zeros(0, np.int64),
        np.array([0]),
        np.array([65_535, 65_536]),
    ]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found = fim.boundaries(owner, np.concatenate(sets), len(sets))
    assert found.counts.tolist() == [len(s) for s in sets]
    assert set(found.kind.tolist()) == {fim.ARRAY, fim.BITMAP, fim.RUNS}
    for o, s in enumerate(sets):
        k = np.unique(rng.integers(0, len(s), 300)) if len(s) else np.zeros(0, np.int64)
        k = np.unique(np.concatenate([k, [0, len(s) - 1]])) if len(s) else k
        assert (found.select(np.full(len(k), o), k) == s[k]).all()


def test_forms_take_their_smallest_size():
    dense = fim.boundaries(np.zeros(40_000, np.int64), np.sort(np.random.default_rng(1).permutation(65_536)[:40_000]), 1)
    assert dense.kind.tolist() == [fim.BITMAP] and dense.words.nbytes == 8192
    assert fim.boundaries(np.zeros(60_000, np.int64), np.arange(60_000), 1).runs.tolist() == [[0, 60_000]]
    assert fim.boundaries(np.zeros(3, np.int64), np.array([1, 5, 9]), 1).arrays.tolist() == [1, 5, 9]
