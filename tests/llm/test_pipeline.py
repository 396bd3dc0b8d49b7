"""The pipeline's stages against plain versions, each on what the one before has kept."""

import random
from collections import Counter, defaultdict

import corpus_pipeline as C
from larchgraph.llm import mixing, pairwise_quality
from larchgraph.llm.common import stored
from tests.llm.test_operators import LOWER, check_packed, components_of, drop_lines, sets_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = stored(C.quality(spark, docs, SF))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    right = [labels[i] == (i in kept) for i in labels]
    assert sum(right) / len(right) > 0.95 and good.columns == docs.columns

    clean = stored(C.lines(spark, good, SF))
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    import hashlib

    want = {i: sha for i, _, _, sha in drop_lines(rows, 10, 1, "none")}
    got = clean.collect()
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    one = stored(C.near(spark, clean, SF))
    texts = {r["doc_id"]: r["text"] for r in got}
    ids = sorted(texts)
    comp = components_of(sets_of([texts[i] for i in ids], 5), ids, 80)
    assert {r["doc_id"] for r in one.collect()} == {i for i in ids if comp[i] == i}

    mixed = stored(C.mix(spark, one, SF))
    taken = {r["doc_id"]: r["taken"] / r["size"] if r["size"] else 0 for r in mixing.mix(one).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: int(x + 0.5) for i, x in taken.items() if int(x + 0.5)})

    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) > 1
    check_copies(C.pack(spark, mixed, SF).collect(), {r["doc_id"]: r["text"] for r in mixed.collect()}, copies)


def check_copies(rows, texts, copies):
    """Every copy of a document is packed whole: equal pieces are dealt to its copies in turn."""
    seen, dealt = Counter(), []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        nth = seen[r["doc_id"], r["start"]]
        seen[r["doc_id"], r["start"]] += 1
        dealt.append(r.asDict() | {"doc_id": (r["doc_id"], nth)})
    assert Counter(k for k, _ in {r["doc_id"]: 0 for r in dealt}) == copies
    check_packed(dealt, {(i, nth): texts[i] for i, n in copies.items() for nth in range(n)})


def plain_run(docs, labels, spark, folder):
    """The pipeline's texts before packing, in plain Python but for the fitted scores and the mix."""
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = pairwise_quality.learn(df, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    good = [(r["doc_id"], r["text"], r["source"]) for r in pairwise_quality.scored(df, model).filter("predicted = 1").collect()]
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    seen = defaultdict(set)
    for i, t, _ in good:
        for x in (t or "").split("\n"):
            seen[key(x)].add((i, t))
    clean = [(i, "\n".join(x for x in (t or "").split("\n") if not key(x) or len(seen[key(x)]) < 10), s) for i, t, s in good]
    ids = sorted({i for i, _, _ in clean if i is not None})
    sets = defaultdict(list)
    for i, t, _ in clean:
        sets[i].append(t)
    comp = components_of(sets_of([sets[i][0] for i in ids], 5), ids, 80)
    return [x for x in dict.fromkeys(clean) if x[0] is None or comp[x[0]] == x[0]]


def test_run_of_odd_tables(spark, tmp_path):
    """Null and empty texts, repeated rows, null ids and sources, shared lines, near copies; a real mix."""
    rng = random.Random(7)
    words = "the of and water stone river house green walks slowly under old bridge near small town".split()
    prose = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    texts = [f"{t}\nShared line" if i % 2 else t for i, t in enumerate(prose)] + [prose[0] + " more", None, "", "!!! $$$ ### ||| !!!"] + ["$$ ## ## !!! ||| %%%"] * 12
    rows = [(i, t, "en", ("a", "b", None)[i % 3], 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, prose[5] + " null", "en", "a", 1)]
    labels = [(i, int(i < 61)) for i in range(len(texts))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    left = plain_run(rows, labels, spark, tmp_path)
    assert 50 < len(left) < len(rows) and all("Shared" not in t for _, t, _ in left)
    df = spark.createDataFrame([(i, t, s) for i, t, s in left], "doc_id bigint, text string, source string")
    taken = {r["doc_id"]: (r["taken"] + r["size"] // 2) // r["size"] if r["size"] else 0 for r in mixing.mix(df).collect()}
    copies = Counter({i: n for i, n in taken.items() if n})
    check_copies(C.run(spark, str(tmp_path)).collect(), {i: t for i, t, _ in left}, copies)


def test_run_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_run_gives_pieces(spark):
    assert C.ORACLE_SQL is None
    assert C.run(spark, SF).count() > 100
