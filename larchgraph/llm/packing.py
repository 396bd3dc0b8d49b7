"""Operator 6: packing by best-fit decreasing with a segment tree over remaining capacity.

Documents are tokenized whole and closed by an end id. A document longer than a window is first
cut into full windows; what is left is packed whole. Documents are dealt into groups of about
`GROUP` whatever the input, by a hash or, where they stand in a training order, by consecutive
places; each group packs its own, longest first: a segment tree over remaining capacities finds
the tightest open window that a rest fits. A group holds only lengths and keys. Rests fill windows
up to a small part of one window for each group.

A null or empty text is its end id alone. Repeated rows are packed as rows of their own. An empty
table gives no pieces. Columns besides the key and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larchgraph.llm import bpe
from larchgraph.llm.common import fresh, stored
from larchgraph.llm.token_counts import by_bytes

WINDOW, END = 2048, 1
#: Documents for each packing group.
GROUP = 20_000
_state: dict[str, bpe.Pieces] = {}
_library: dict = {}
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
PIECE = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _by_library(path: str, chunks: list[str]) -> list[list[int]]:
    """The library's ids. It is large in memory and seldom needed, so it is loaded late and once."""
    if not chunks:
        return []
    if path not in _library:
        from tokenizers import Tokenizer

        _library[path] = Tokenizer.from_file(path)
    return [e.ids for e in _library[path].encode_batch(chunks, add_special_tokens=False)]


def _splitter(path: str):
    import json

    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
    special = [x["content"] for x in spec["added_tokens"]]

    def split(new: list[bytes]) -> tuple[list[bytes], list[int], dict[int, list[int]]]:
        """Pre-tokens of white-space-free chunks; rare scripts and special strings go to the library."""
        tokens: list[bytes] = []
        owner: list[int] = []
        odd: list[int] = []
        for k, chunk in enumerate(new):
            s = chunk.decode()
            if not s.isascii() and (max(s) >= "ƀ" or "İ" in s) or "<|" in s and any(x in s for x in special):
                odd.append(k)
                continue
            found = find(s.lower())
            tokens += [x.encode() for x in found]
            owner += [k] * len(found)
        return tokens, owner, dict(zip(odd, _by_library(path, [new[k].decode() for k in odd]), strict=True))

    return split


def tokenize(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, ids of each text), as the library gives them; white space separates chunks."""
    if path not in _state:
        _state[path] = bpe.Pieces(path, _splitter(path))
    data, offsets = bpe.bytes_of(texts)
    solid = ~_SPACES[data] if len(data) else np.zeros(0, bool)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    if not first.any():
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    kept = np.concatenate([[0], np.cumsum(solid)])
    starts = np.flatnonzero(first)
    rows, flat, counts = _state[path].ids(bpe.pieces_of(data[solid], np.append(kept[starts], kept[-1])))
    n = counts[rows]
    ids = bpe.gather(flat, np.cumsum(counts) - counts, counts, rows)
    sums, place = np.concatenate([[0], np.cumsum(n)]), np.searchsorted(starts, offsets)
    return ids, sums[place[1:]] - sums[place[:-1]]


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, group: Column | None = None) -> DataFrame:
    """The full windows of every document and its rest: doc_id, start, length, ids_crc32, doc_tokens,
    and the document's `_group`, if that is given."""
    kind = df.schema[key].dataType.simpleString()
    group = F.lit(0) if group is None else group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                ids, counts = tokenize(part.column("text"), path)
                ends, ids = np.cumsum(counts), ids.astype("<u4")
                row, start, length, crc, whole = [], [], [], [], []
                for k, (b, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    own = np.append(ids[b - n : b], np.uint32(end)).astype("<u4")
                    for at in range(0, n + 1, window):
                        piece = own[at : at + window]
                        row.append(k), start.append(at), length.append(len(piece)), crc.append(zlib.crc32(piece.tobytes())), whole.append(n + 1)
                own_key, own_group = (part.column(c).take(pa.array(row, pa.int64())) for c in ("key", "group"))
                yield pa.RecordBatch.from_arrays(
                    [own_key, *(pa.array(x, pa.int64()) for x in (start, length, crc, whole)), own_group], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_group"]
                )
        bpe.forget(_state)

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), group.cast("long").alias("group"))
    return rows.mapInArrow(run, PIECE.format(kind) + ", _group bigint")


class Windows:
    """Open windows by remaining capacity, under a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def add(self, left: int, item: tuple[int, int]) -> None:
        self.open[left].append(item)
        at = self.leaves + left
        while at:
            self.tree[at] += 1
            at //= 2

    def tightest(self, length: int) -> tuple[int, tuple[int, int]] | None:
        """Takes out the window with the least remaining capacity of at least `length`."""
        at = self.leaves + length
        while not self.tree[at]:  # up, to the first subtree on the right that has a window
            while at & 1:
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        left = at - self.leaves
        item = self.open[left].pop()
        while at:
            self.tree[at] -= 1
            at //= 2
        return left, item


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, by best-fit decreasing."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows, n = Windows(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        if found := windows.tightest(length):
            left, (own, used) = found
        else:
            left, own, used = window, n, 0
            n += 1
        sequence[k], offset[k] = own, used
        if left > length:
            windows.add(left - length, (own, used + length))
    return sequence, offset


def _packed(dealt: DataFrame, window: int) -> DataFrame:
    """Best fit of the pieces below a window inside each `_group`; full windows are sequences as they
    are. Sequences of a group are numbered from _group * 2 ** 32 on, its full windows after 2 ** 31 others."""
    dealt = stored(dealt)

    def run(rests: pa.Table) -> pa.Table:
        rests = rests.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        own, offset = best_fit(rests.column("length").to_numpy(), window)
        sequence = rests.column("_group").to_numpy() * (1 << 32) + own
        return rests.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kind = dealt.schema["doc_id"].dataType.simpleString()
    rests = dealt.filter(F.col("length") < window).groupBy("_group").applyInArrow(run, PIECE.format(kind) + ", sequence_id bigint, offset bigint")
    nth = F.row_number().over(Window.partitionBy("_group").orderBy("doc_id", "start", "ids_crc32"))
    full = dealt.filter(F.col("length") == window).withColumn("sequence_id", F.col("_group") * (1 << 32) + (1 << 31) - 1 + nth).withColumn("offset", F.lit(0).cast("bigint"))
    return rests.unionByName(full.drop("_group"))


def pack(df: DataFrame, path: str, documents: int, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, group: int = GROUP) -> DataFrame:
    """The pieces of all documents with sequence_id and offset. documents: how many rows df has. A
    group has about `group` documents, each with one piece below a window at most; repeated rows are dealt by
    their place, not by what they hold, so they spread."""
    groups = max(1, -(-documents // group))
    dealt = pieces(df, path, key, text, window, end)
    place = F.monotonically_increasing_id()
    return _packed(dealt.withColumn("_group", F.pmod(F.xxhash64(place), F.lit(groups))), window)


def pack_in_order(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, group: int = GROUP) -> DataFrame:
    """Like pack(), of a table that was written in training order, as files part-00000 and so on:
    about `group` consecutive documents are packed together, and sequence ids rise with the order
    from group to group. df must be read from those files; the driver sums a number for each file."""
    part = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"), F.lit(0))
    own, in_file, begin = fresh(df, "_part", "_place", "_begin")
    df = df.withColumn(own, part).withColumn(in_file, F.floor(F.col("_metadata.row_index") / group))
    sizes = df.groupBy(own).agg((F.max(in_file) + 1).alias("n")).orderBy(own).collect()
    before = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
    starts = df.sparkSession.createDataFrame([(r[own], n) for r, n in zip(sizes, before, strict=False)], f"`{own}` bigint, `{begin}` bigint")
    df = df.join(F.broadcast(starts), own)  # a row for each file
    return _packed(pieces(df, path, key, text, window, end, F.col(begin) + F.col(in_file)), window)
