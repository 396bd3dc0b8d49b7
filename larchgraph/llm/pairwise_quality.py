"""Operator 5: document quality by Bradley-Terry pairwise ranking.

Features are ratios of the whole text, computed by built-in functions. From labelled rows come
preference pairs (a good and a bad document); a document's utility is linear in its features and
the weights minimise the logistic loss of utility differences. The threshold is a score quantile:
the utility below which as many labelled rows lie as are bad scores exactly CUT.

The weights' fit uses at most SAMPLE labelled rows of each label, those with the least hash of
doc_id, and PAIRS pairs of them; the quantile is taken over all labelled rows that are not held
out, and scoring covers every row. Rows held out (crc32 of doc_id, as text, divisible
by FOLDS) are never learned from. Labels without both classes give weight 0: all scores are equal
and predicted 1. Null and empty texts have features 0 and are scored like any other. Repeated
rows repeat their score; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchgraph.llm import quality_rules
from larchgraph.llm.common import UPPER, fresh, stored

SAMPLE, PAIRS, FOLDS, CUT, RIDGE = 2000, 60_000, 5, 0.3, 1e-3
#: Bins of a histogram that narrows a quantile.
BINS = 1000
#: Labelled ids that are broadcast to the texts; more are merged with them, at the cost of a shuffle of all texts.
BROADCAST = 1_000_000
FEATURES = ("symbols", "upper", "shouts", "pipes", "digits", "repeats", "dup_lines", "stops", "word_length", "line_length", "few_words", "length")


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with an array `_features` of doubles, in the order of FEATURES."""
    df = df.drop("_features")
    mine = [c for c in df.columns if c != text and (c in quality_rules.MEASURES or c.startswith("_qr_"))]
    held = dict(zip(mine, fresh(df, *[f"_own_{i}" for i in range(len(mine))]), strict=True))
    df = quality_rules.measure(df.withColumnsRenamed(held), text)
    body = F.coalesce(F.col(text), F.lit(""))
    of = lambda chars: F.length(body) - F.length(F.translate(body, chars, ""))
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    most = lambda c, top: F.least(c.cast("double"), F.lit(float(top)))
    values = {
        "symbols": most(F.col("n_symbols") / n, 3),
        "upper": of(UPPER) / chars,
        "shouts": most(of("!") / n, 3),
        "pipes": most(of("|") / n, 1),
        "digits": of("0123456789") / chars,
        "repeats": F.col("n_repeat_words") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "stops": F.col("n_stop_words") / n,
        "word_length": most(F.col("word_chars") / n / 10, 3),
        "line_length": most(F.log1p(F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))) / 5, 3),
        "few_words": (F.col("n_words") < 10).cast("double"),
        "length": F.log1p(F.col("n_words")) / 10,
    }
    df = df.withColumn("_features", F.array(*[values[k].cast("double") for k in FEATURES]))
    return df.drop(*quality_rules.MEASURES).withColumnsRenamed({b: a for a, b in held.items()})


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """(weights, cut): Newton steps on the pairs' logistic loss, and the quantile of these rows' utility."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), 0.0
    rng = np.random.default_rng(5)
    d = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, _cut(x @ w, y)


def _cut(utility: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the scores at the share of bad rows: as many score below it as are bad."""
    ranked = np.sort(utility)
    k = int((y == 0).sum())
    return float((ranked[k - 1] + ranked[min(k, len(ranked) - 1)]) / 2)


def known_labels(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(_key, _label) of the labelled rows that are not held out."""
    return labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("_key"), F.col(label).alias("_label"))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """At most 2 * sample labelled rows, none held out."""
    known = known_labels(labels, key, label)
    parts = [known.filter(F.col("_label") == v).orderBy(F.xxhash64("_key"), "_key").limit(sample) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    return docs.join(F.broadcast(chosen), docs[key] == chosen["_key"])


def _ranked(values: DataFrame, k: int) -> float:
    """The k-th least (from 1) of the column `u`: histograms narrow on it until one value is left."""
    lo, hi = values.agg(F.min("u"), F.max("u")).first()
    while lo < hi:
        inside = values.filter(F.col("u").between(lo, hi))
        bin_ = F.least(F.floor((F.col("u") - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1))
        bins = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi")).orderBy("bin").collect()
        # ranks are counted from lo on: rows below it are gone from k
        for b in bins:
            if k <= b["n"]:
                break
            k -= b["n"]
        lo, hi = b["lo"], b["hi"]
    return lo


def _utility(weights: np.ndarray, start: Column) -> Column:
    for i, w in enumerate(weights.tolist()):
        start = start + F.col("_features")[i] * F.lit(w)
    return start


def _whole_cut(measured: DataFrame, labels: DataFrame, weights: np.ndarray, key: str, label: str) -> float:
    """_cut over all labelled rows that are not held out."""
    known = known_labels(labels, key, label).hint("merge")
    utilities = measured.select(F.col(key).alias("_key"), _utility(weights, F.lit(0.0)).alias("u"))
    rows = stored(utilities.join(known, "_key").select("u", "_label"))
    n, bad = rows.agg(F.count("*"), F.count_if(F.col("_label") == 0)).first()
    return (_ranked(rows, bad) + _ranked(rows, min(bad + 1, n))) / 2


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """key and _features of the rows with a label to learn from, written."""
    known = stored(known_labels(labels, key, label).select("_key").distinct())
    known = F.broadcast(known) if known.count() <= BROADCAST else known.hint("merge")
    texts = docs.select(key, text)
    return stored(features(texts.join(known, texts[key] == known["_key"], "left_semi"), text).select(key, "_features"))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, measured: bool = False) -> tuple[np.ndarray, float]:
    """(weights, cut). measured: docs have `_features` already, as of features(); else only labelled
    texts are measured here."""
    known = docs.select(key, "_features") if measured else _labelled(docs, labels, key, text, label)
    rows = training_rows(known, labels, key, label, sample).select("_key", "_label", "_features").orderBy("_key", "_label").collect()
    if not rows:
        return np.zeros(len(FEATURES)), 0.0
    weights, cut = fit(np.array([r["_features"] for r in rows]), np.array([r["_label"] for r in rows]))
    return (weights, _whole_cut(known, labels, weights, key, label)) if np.any(weights) else (weights, cut)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", cut: float = CUT, measured: bool = False) -> DataFrame:
    """docs with score and predicted. measured: docs have `_features` already, as of features()."""
    weights, middle = model
    df = docs.drop("score", "predicted")
    df = df if measured else features(df, text)
    utility = _utility(weights, F.lit(-float(middle)))
    lift = float(np.log(cut / (1 - cut))) if np.any(weights) else 0.0
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), utility + lift))))
    df = df.withColumn("score", score)
    return df.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0).cast("int")).drop("_features")
