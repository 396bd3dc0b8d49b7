"""Operator 4: near-duplicates by an LSH forest.

1. Every text's set of shingles gives a fingerprint and a MinHash signature. Equal sets are one
   class, stood for by its least document; all further work is on classes.
2. A class's signature is cut into TREES keys of DEPTH values. Each tree is a sorted order of
   keys, range-partitioned, so even a key of very many classes spreads. Neighbours in the order
   have the longest common prefixes; each class is a candidate with the next NEAR ones that share
   at least SHALLOW values. Candidates thus grow with the classes, never with a group's square.
3. Candidates whose whole signatures agree in at least ROUGH of the values join into regions. A
   region holds all classes that may be linked; in it, links are decided on full sets.
4. A region of more than REGION classes is too much for one task. Bands hold its sets of similar
   size, so that links stay in a band or lead to the next one. First all of its classes, in blocks,
   are compared with HUBS hubs of each band around them; near copies of one text mostly join there.
   Then every class that the region's most frequent hub has not joined is compared with all classes
   of the bands around it, block by block. So each pair of a region is decided, or its ends are
   joined already. The first step grows with the region, the second with the region times what is left.
5. If the second step would read texts more than SPREAD times, large regions are refined before it.
   Their shingles are ordered from rare to frequent, and of two linked sets of n and m shingles the
   n - ceil(0.8 n) + 1 first of one and the m - ceil(0.8 m) + 1 first of the other have one in common.
   Classes that chains of such common first shingles join are the new regions, made by a star for each
   shingle, not by pairs; a class of no star has no link. Pages that share a frame fall apart here.
   All pairs are decided either way.
6. Links join into components.

A document's set: distinct `width`-word shingles of the lower-cased (A-Z) text; with fewer words,
the whole sequence as one; null and word-less texts have none and are linked with nothing. Links:
100 * intersection >= percent * union. Rows without an id are returned with no component and kept.
Repeated rows share a component. Columns besides key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larchgraph.llm import bpe
from larchgraph.llm.common import dropped, partitions, stored
from larchgraph.llm.components import components
from larchgraph.llm.token_counts import by_bytes

WIDTH, PERCENT = 4, 80
TREES, DEPTH, SHALLOW, NEAR, ROUGH = 16, 12, 3, 4, 0.55
#: Classes, and shingles, of a region, or of two blocks of a larger one, that one task decides; hubs of a band.
REGION, REGION_SHINGLES, HUBS = 400, 1_000_000, 8
#: How often a text of a large region may be read for its second step before the region is refined.
SPREAD = 8
#: Pairs whose components are found in one task; more are found in rounds.
FEW = 20_000
#: Bytes of text worked on at once; classes, and shingles, of small regions that share a task.
CHUNK, TOGETHER, TOGETHER_SHINGLES = 1_000_000, 2000, 1_000_000

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20)
_LETTER = _rng.integers(1, 1 << 63, 256, np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = _rng.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_A = (_rng.integers(1, 1 << 31, TREES * DEPTH, np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: a polynomial in its bytes, from differences of running sums. Words are
    worked on in runs of up to CHUNK bytes, so that a very long text needs no sums for all its bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, first + CHUNK, "right")))
        part = data[first : int(ends[upto - 1])]
        power = np.full(len(part), _P, np.uint64)
        power[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[part] * np.cumprod(power))])
        power[1:] = _P_INVERSE
        s, e = starts[at:upto] - first, ends[at:upto] - first
        out[at:upto] = _mixed((sums[e] - sums[s]) * np.cumprod(power)[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of each text, end to end; how many each has)."""
    data, offsets = bpe.bytes_of(texts)
    none = np.zeros(len(texts), np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), none
    solid = ~_SPACES[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), none
    word = _word_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    n_words = np.diff(at)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(texts)), counts)
    begin = np.repeat(at[:-1], counts) + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(n_words[doc], width)
    h = size.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    for j in range(width):
        has = size > j
        h[has] += word[begin[has] + j] * _PLACES[j]
    h = _mixed(h)
    edges = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.bincount(doc[fresh], minlength=len(texts)).astype(np.int64)


def signatures(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's fingerprint, and the signature (16-bit values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", CHUNK):
                h, n = shingles(part.column("text"), width)
                f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sig = np.zeros((len(n), TREES * DEPTH), ">u2")
                rows = np.flatnonzero(n)
                if len(rows):
                    starts = (np.cumsum(n) - n)[rows]
                    f1[rows], f2[rows] = np.add.reduceat(h, starts), np.add.reduceat(_mixed(h + _P), starts)
                    low = h.astype(np.uint32)
                    for k in range(TREES * DEPTH):
                        least = np.minimum.reduceat(low * _A[k] + _B[k], starts)
                        sig[rows, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
                data = pa.py_buffer(sig.tobytes())
                signature = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * sig.shape[1] * 2).astype(np.int32)), data])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), signature], ["doc_id", "n_shingles", "f1", "f2", "sig"]
                )

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, f1 bigint, f2 bigint, sig binary")


def _walk(near: int, shallow: int, depth: int, tell_edges: bool):
    """Candidates of a sorted partition; its first and last `near` rows, as edges, for a second walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "key", "a", "b"]
        held: pa.Table | None = None
        opened = 0

        def ends(t: pa.Table) -> pa.RecordBatch:
            tree, key, a = (t.column(c).combine_chunks() for c in ("tree", "key", "a"))
            return pa.RecordBatch.from_arrays([tree, key, a, a], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if tell_edges and opened < near:
                edge = t.slice(0, near - opened)
                opened += len(edge)
                yield ends(edge)
            old = len(held) if held is not None else 0
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            keys = np.frombuffer(b"".join(t.column("key").to_pylist()), ">u2").reshape(len(t), depth)
            tree, rep = t.column("tree").to_numpy(), t.column("a").combine_chunks()
            for step in range(1, min(near, len(t) - 1) + 1):
                same = (keys[step:, :shallow] == keys[:-step, :shallow]).all(1) & (tree[step:] == tree[:-step])
                i = np.flatnonzero(same)
                i = i[i + step >= old]  # pairs inside what was held are told already
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.binary()), rep.take(pa.array(i)), rep.take(pa.array(i + step))], names
                    )
            held = t.slice(max(0, len(t) - near))
        if tell_edges and held is not None:
            yield ends(held)

    return run


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of neighbouring classes in some tree, written."""
    kind = classes.schema["rep"].dataType.simpleString()
    rows = classes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("tree", F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("key"), F.col("rep").alias("a"))
    order = ["tree", "key", "a"]
    ranged = rows.repartitionByRange(partitions(classes.sparkSession), *order).sortWithinPartitions(*order)
    schema = f"tree int, key binary, a {kind}, b {kind}"
    found = stored(ranged.mapInArrow(_walk(NEAR, SHALLOW, DEPTH, True), schema))
    # the ends of partitions: 2 * NEAR rows of each, whatever the input
    ends = found.filter("tree is not null").select("tree", "key", "a").repartition(1).sortWithinPartitions(*order)
    across = ends.mapInArrow(_walk(NEAR, SHALLOW, DEPTH, False), schema)
    pairs = found.filter("tree is null").unionByName(across).filter("a <> b")
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    dropped(found)
    return pairs


def _agreement(x: pd.Series, y: pd.Series) -> pd.Series:
    """The share of a signature's values in which two signatures agree."""
    a, b = (np.frombuffer(b"".join(s), ">u2").reshape(len(s), -1) for s in (x, y))
    return pd.Series((a == b).mean(1))


def exact_links(h: np.ndarray, n: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """The component (least index) of each set under links decided on the full sets; with `side`,
    under links between sets of side 0 and sets of side 1 alone.

    Bitmaps of element parities bound the symmetric difference from below; only pairs within the
    bound that no chain of links joins yet are compared in full."""
    m = len(n)
    starts = np.cumsum(n) - n
    doc = np.repeat(np.arange(m), n)
    bits = np.zeros((m, 2048), np.uint8)
    np.add.at(bits, (doc, (h >> np.uint64(53)).astype(np.int64)), 1)
    maps = np.packbits(bits & 1, axis=1).view(np.uint64)
    label = np.arange(m)
    order = np.argsort(n, kind="stable")
    ours, theirs = (order, order) if side is None else (order[side[order] == 0], order[side[order] == 1])
    size, others = n[theirs], maps[theirs]
    for i, own in enumerate(ours.tolist()):
        # 100 * |smaller| >= percent * |larger| is needed
        upto = int(np.searchsorted(size, 100 * n[own] // percent, "right"))
        since = i + 1 if side is None else int(np.searchsorted(size, -(-percent * n[own] // 100), "left"))
        if upto <= since:
            continue
        apart = np.bitwise_count(others[since:upto] ^ maps[own]).sum(1, dtype=np.int64)
        # |x and y| = (|x| + |y| - apart) / 2: the link's bound in terms of `apart`
        total = size[since:upto] + n[own]
        near = np.flatnonzero(100 * (total - apart) >= percent * (total + apart))
        near = theirs[since + near[np.argsort(apart[near], kind="stable")]]
        for other in near[label[near] != label[own]].tolist():
            ra, rb = label[own], label[other]
            if ra == rb:
                continue
            x, y = h[starts[own] : starts[own] + n[own]], h[starts[other] : starts[other] + n[other]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                label[label == max(ra, rb)] = min(ra, rb)
    return label.astype(np.int64)


def _by_slices(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What shingles() tells of all texts, of up to CHUNK bytes of text, or one text, at once."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
    found = []
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(size, size[at] + CHUNK, "right")) - 1)
        found.append(shingles(texts.slice(at, upto - at).combine_chunks(), width))
        at = upto
    return np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])


def _decide(width: int, percent: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("rep", "ascending")]).combine_chunks()
        part, side, rep = t.column("part").to_numpy(), t.column("side").to_numpy(), t.column("rep").combine_chunks()
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(t.column("text")), 0).to_numpy())])
        a, b = [], []
        at = 0
        while at < len(edges) - 1:  # whole parts, up to CHUNK bytes of text at once
            upto = max(at + 1, int(np.searchsorted(size[edges], size[edges[at]] + CHUNK, "right")) - 1)
            first = int(edges[at])
            h, n = _by_slices(t.column("text").slice(first, int(edges[upto]) - first), width)
            ends = np.cumsum(n)
            for lo, hi in zip((edges[at:upto] - first).tolist(), (edges[at + 1 : upto + 1] - first).tolist(), strict=True):
                own = side[first + lo : first + hi]
                low = exact_links(h[ends[lo] - n[lo] : ends[hi - 1]], n[lo:hi], percent, None if own[0] < 0 else own)
                if own[0] >= 0:  # what a hub has joined is told as its own links
                    hubs = np.flatnonzero(own == 0)[::-1]
                    center = np.arange(hi - lo)
                    center[low[hubs]] = hubs
                    low = center[low]
                rows = np.flatnonzero(low != np.arange(hi - lo))
                a.append(first + lo + low[rows])
                b.append(first + lo + rows)
            at = upto
        return pa.table({"a": rep.take(pa.array(np.concatenate(a))), "b": rep.take(pa.array(np.concatenate(b)))})

    return run


def _blocks() -> Column:
    """Blocks of at most half of what one task decides, of n classes with s shingles."""
    return F.ceil(2 * F.greatest(F.col("n") / REGION, F.col("s") / REGION_SHINGLES)).cast("int")


def _load(members: DataFrame, *by: str) -> DataFrame:
    return members.groupBy(*by).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")


def _around(band: Column) -> Column:
    return F.explode(F.array(band - 1, band, band + 1))


def _sized(members: DataFrame, percent: int) -> DataFrame:
    """members with their region's size, n and s, whether it is large, and the band of their set's."""
    size = _load(members, "region")
    size = size.withColumn("large", (F.col("n") > REGION) | (F.col("s") > REGION_SHINGLES) & (F.col("n") > 2))
    # a band is a little wider than the ratio of linked sizes: rounding cannot lead past the next one
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(max(100 / percent, 1.05) * 1.001)))
    return members.join(size, "region").withColumn("band", band)


def _tokens(width: int):
    """(rep, region, token): every shingle of (rep, region, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", CHUNK):
                h, n = shingles(part.column("text"), width)
                rows = np.repeat(np.arange(len(n)), n)
                for at in range(0, len(h), CHUNK):
                    own = pa.array(rows[at : at + CHUNK])
                    token = pa.array(h[at : at + CHUNK].view(np.int64))
                    yield pa.RecordBatch.from_arrays([part.column("rep").take(own), part.column("region").take(own), token], ["rep", "region", "token"])

    return run


def _refined(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, region, n_shingles) of the classes of large regions that share first shingles with another.

    Shingles of one class alone are never told: they only shorten what is first of the others. A shingle
    of very many classes is counted before the shuffle, and is a key that a join may split."""
    large = members.filter("large").select("rep", "region", "n_shingles")
    kind = members.schema["rep"].dataType.simpleString()
    tokens = texts.hint("merge").join(large.select("rep", "region"), "rep").select("rep", "region", "text")
    tokens = tokens.mapInArrow(_tokens(width), f"rep {kind}, region {kind}, token bigint")
    times = tokens.groupBy("region", "token").agg(F.count("*").alias("times")).filter("times > 1")
    own = Window.partitionBy("rep", "region")
    held = tokens.join(times, ["region", "token"]).withColumn("rank", F.row_number().over(own.orderBy("times", "token")))
    held = held.withColumn("shared", F.count("*").over(own)).join(large, ["rep", "region"])
    need = F.ceil(F.col("n_shingles") * percent / 100)
    first = stored(held.filter(F.col("rank") <= F.col("shared") - need + 1).select("rep", "region", "token"))
    heads = first.groupBy("region", "token").agg(F.min("rep").alias("head"))
    edges = stored(first.join(heads, ["region", "token"]).filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct())
    found = stored(components(edges, in_task=FEW).withColumnsRenamed({"node": "rep", "component": "region"}).join(large.drop("region"), "rep"))
    dropped(first, edges)
    return found


def _first_parts(members: DataFrame) -> DataFrame:
    """(rep, part, side, alone): what is decided together. A small region is one part, of side -1;
    a part of a large one is a block (side 1) with the hubs of the bands around it (side 0)."""
    alone = (F.col("s") > TOGETHER_SHINGLES / 8) | (F.col("n") > TOGETHER / 8)
    small = members.filter("not large").select("rep", F.xxhash64("region").alias("part"), F.lit(-1).alias("side"), alone.alias("alone"), "n_shingles")
    large = members.filter("large").select("rep", "region", "band", "n_shingles")
    load = _load(large, "region", "band").select("region", "band", _blocks().alias("blocks"))
    part = F.xxhash64("region", "band", "block").alias("part")
    dealt = large.join(load, ["region", "band"]).withColumn("block", _block("blocks"))
    hubs = large.groupBy("region", "band").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("rep", F.lit(k)), "rep"))["rep"] for k in range(HUBS)])).alias("hubs"))
    hubs = hubs.select("region", F.explode("hubs").alias("rep"), _around(F.col("band")).alias("band")).join(load, ["region", "band"])
    hubs = hubs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = lambda df, side: df.select("rep", part, F.lit(side).alias("side"), F.lit(True).alias("alone"), F.lit(None).cast("bigint").alias("n_shingles"))
    return small.unionByName(row(dealt, 1)).unionByName(row(hubs, 0))


def _rest(members: DataFrame, links: DataFrame) -> DataFrame:
    """The classes of large regions that are not linked with the region's most frequent hub, by
    links(a, b); written."""
    large = members.filter("large").select("rep", "region", "band", "n_shingles")
    joined = large.join(links.select(F.col("b").alias("rep"), "a").distinct(), "rep")
    top = joined.groupBy("region", "a").count().groupBy("region").agg(F.max_by("a", F.struct("count", "a")).alias("a"))
    near = joined.join(top, ["region", "a"]).select("rep").unionByName(top.select(F.col("a").alias("rep"))).distinct()
    return stored(large.join(near, "rep", "left_anti").select("rep", "region", "band", "n_shingles"))


def _met(members: DataFrame, rest: DataFrame) -> DataFrame:
    """Bands of the rest with the bands of all classes around them, and how many blocks and classes
    they have: as many rows as bands, three times."""
    load = lambda df, side, band: _load(df, "region", "band").select("region", F.col("band").alias(band), _blocks().alias(side), F.col("n").alias(f"n_{side}"))
    theirs = load(members.filter("large"), "theirs", "near")
    return load(rest, "ours", "band").withColumn("near", _around(F.col("band"))).join(theirs, ["region", "near"])


def _spread(members: DataFrame, rest: DataFrame) -> float:
    """How often the second step would read a text of a large region."""
    read = _met(members, rest).agg(F.sum(F.col("n_ours") * F.col("theirs") + F.col("n_theirs") * F.col("ours"))).first()[0]
    return (read or 0) / max(1, members.filter("large").count())


def _second_parts(members: DataFrame, links: DataFrame, rest: DataFrame | None = None) -> DataFrame:
    """Parts of large regions: a block of the rest (side 0), and a block of all classes of the bands
    around (side 1)."""
    large = members.filter("large").select("rep", "region", "band", "n_shingles")
    rest = _rest(members, links) if rest is None else rest
    met = _met(members, rest).drop("n_ours", "n_theirs")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = F.xxhash64("region", "band", "i", "near", "j")
    row = lambda df, side: df.select("rep", part.alias("part"), F.lit(side).alias("side"), F.lit(True).alias("alone"), F.lit(None).cast("bigint").alias("n_shingles"))
    left = rest.join(met, ["region", "band"]).withColumn("i", _block("ours")).withColumn("j", every("theirs"))
    right = large.select("rep", "region", F.col("band").alias("near")).join(met, ["region", "near"]).withColumn("j", _block("theirs")).withColumn("i", every("ours"))
    return row(left, 0).unionByName(row(right, 1))


def _decided(texts: DataFrame, parts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links inside the parts, as many as join what they join; written. texts: rep, text."""
    parts = stored(parts)
    n, s = parts.filter("not alone").agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    together = F.pmod(F.xxhash64("part"), F.lit(max(partitions(texts.sparkSession), -(-n // TOGETHER), -(-s // TOGETHER_SHINGLES))))
    dealt = parts.withColumn("bucket", F.when(F.col("alone"), F.col("part")).otherwise(together)).drop("alone", "n_shingles")
    kind = texts.schema["rep"].dataType.simpleString()
    # parts grow with the input: both sides are sorted and merged at every size, none is broadcast
    links = stored(dealt.join(texts.hint("merge"), "rep").groupBy("bucket").applyInArrow(_decide(width, percent), f"a {kind}, b {kind}"))
    dropped(parts)
    return links


def linked(df: DataFrame, classes: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with another."""
    pairs = candidates(classes)
    sig = lambda side: classes.select(F.col("rep").alias(side), F.col("sig").alias(f"sig_{side}"))
    rough = pairs.join(sig("a"), "a").join(sig("b"), "b").filter(F.pandas_udf(_agreement, "double")("sig_a", "sig_b") >= ROUGH).select("a", "b")
    regions = components(rough, in_task=FEW).withColumnsRenamed({"node": "rep", "component": "region"})
    members = stored(_sized(regions.join(classes.select("rep", "n_shingles"), "rep"), percent))
    dropped(pairs)
    # all texts are shuffled once; those in regions are kept, one of repeated rows, and only they are read again
    texts = df.select(F.col(key).alias("rep"), F.col(text).alias("text")).hint("merge").join(members.select("rep"), "rep")
    texts = stored(texts.groupBy("rep").agg(F.min("text").alias("text")))
    links = [_decided(texts, _first_parts(members), width, percent)]
    if members.filter("large").limit(1).count():
        rest = _rest(members, links[0])
        if _spread(members, rest) > SPREAD:
            finer = _refined(members, texts, width, percent)
            members, old = stored(_sized(finer, percent)), members
            dropped(old, finer, rest)
            links.append(_decided(texts, _first_parts(members), width, percent))
            rest = _rest(members, links[1])
        links.append(_decided(texts, _second_parts(members, links[-1], rest), width, percent))
        dropped(rest)
    found = components(reduce(DataFrame.unionByName, links), in_task=FEW)
    dropped(members, texts, *links)
    return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sigs = stored(signatures(df, key, text, width))
    named = sigs.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(named.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    found = linked(df, classes, key, text, width, percent)
    # signatures are no longer needed: what remains is a few numbers for each row
    sigs, wide = stored(sigs.drop("sig")), sigs
    classes, old = stored(classes.drop("sig")), classes
    dropped(wide, old)
    known = classes.select("n_shingles", "f1", "f2", "rep").join(found, F.col("rep") == F.col("node"), "left")
    known = known.select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("_found"))
    out = sigs.select("doc_id", "n_shingles", "f1", "f2").join(known, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_found"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
