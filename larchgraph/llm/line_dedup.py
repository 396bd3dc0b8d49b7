"""Operator 9: line dedup over range-partitioned line hashes, answered with keep bitmaps.

Lines go out as (128-bit key hash, document, position), never as text. They are range-partitioned
by (hash, document) and sorted there by position too, so a frequent line spreads over as many
partitions as it needs while one document's copies of a line stay together. A document's name in
that order is its key and its text's hash. One stream over each
partition counts a line's documents and finds its first occurrence; it tells lines as it meets
them and holds at most HELD of one that is still rare. Only a partition's first and last line can
run on into a neighbour; what is open about them, and about a rare line that is longer than HELD,
is settled in a table of counts, two for each partition. The answer is one zlib-compressed bitmap
of kept lines for each document.

A line's key is the line without white space at both ends, A-Z lower-cased. A line is a duplicate
if its key has at least min_chars code points and occurs in at least min_docs documents. keep
says what stays of it: "none", or "first", its first line by document and position.

Null and empty texts are one empty line. A document is a key and a text: rows that are equal in both
count as one document and share a bitmap; rows of one key, null too, with other texts are others. Extra columns pass through `cleaned`, whatever their
names; only n_lines, n_dropped and kept_sha256 are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchgraph.llm.common import SPACE, ascii_lower, fresh, partitions, stored

#: Lines of one key that a stream holds while it does not know whether they are frequent.
HELD = 100_000
#: What a row of the stream is: a line to drop, a line that is open, or a count of an open key.
DROP, OPEN, COUNT = 0, 1, 2
_FOUND = "h1 bigint, h2 bigint, doc {}, body bigint, pos int, n_docs bigint, first boolean, kind int"


def line_keys(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(ascii_lower(x), F.lit(SPACE)))


def _body(text: Column) -> Column:
    """Tells rows with the same document key and other texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _stream(min_docs: int):
    """One pass over a sorted partition: lines to drop as soon as their key has min_docs documents,
    open lines of the keys that may go on in another partition, and those keys' counts with their
    first line here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = True  # the key at hand is the partition's first
        loose = False  # its lines are told as open ones
        key: tuple | None = None
        last_doc, docs = None, 0
        head: pa.Table | None = None
        held: list[pa.Table] = []

        def rows(t: pa.Table, kind: int, n_docs: int = 0, first: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            first = np.zeros(len(t), bool) if first is None else first
            t = t.append_column("n_docs", pa.array(np.full(len(t), n_docs))).append_column("first", pa.array(first))
            yield from t.append_column("kind", pa.array(np.full(len(t), kind, np.int32))).to_batches()

        def told(part: pa.Table, new: bool) -> Iterator[pa.RecordBatch]:
            """More lines of the key at hand; new: its first."""
            nonlocal held, loose
            first = np.zeros(len(part), bool)
            first[:1] = new
            if loose:
                yield from rows(part, OPEN)
            elif docs >= min_docs:
                if held:
                    waiting, held = pa.concat_tables(held), []
                    yield from rows(waiting, DROP, first=np.arange(len(waiting)) == 0)
                yield from rows(part, DROP, first=first)
            else:
                held.append(part)
                if sum(map(len, held)) > HELD:
                    loose = True
                    waiting, held = held, []
                    for t in waiting:
                        yield from rows(t, OPEN)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            h1, h2 = t.column("h1").to_numpy(), t.column("h2").to_numpy()
            doc = batch.column(batch.schema.get_field_index("doc"))
            codes = doc.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            body = t.column("body").to_numpy()
            fresh_key = np.ones(len(t), bool)
            fresh_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            fresh_key[0] = (int(h1[0]), int(h2[0])) != key
            new_doc = fresh_key.copy()
            new_doc[1:] |= (codes[1:] != codes[:-1]) | (body[1:] != body[:-1])
            new_doc[0] |= (doc[0].as_py(), int(body[0])) != last_doc
            starts = np.unique(np.append(0, np.flatnonzero(fresh_key)))
            n = np.add.reduceat(new_doc.astype(np.int64), starts)
            ends = np.append(starts[1:], len(t))
            if not fresh_key[0]:
                docs += int(n[0])
                yield from told(t.slice(0, int(ends[0])), False)
            if fresh_key.any():
                # the key at hand ends, those inside the batch are decided at once, the last one stays open
                if key is not None and (opening or loose):
                    yield from rows(head, COUNT, docs)
                opening = key is None
                inner = np.flatnonzero(fresh_key[starts])
                if opening and len(inner) > 1:
                    a, b = int(starts[inner[0]]), int(ends[inner[0]])
                    yield from rows(t.slice(a, b - a), OPEN)
                    yield from rows(t.slice(a, 1), COUNT, int(n[inner[0]]))
                    inner, opening = inner[1:], False
                often = inner[:-1][n[inner[:-1]] >= min_docs]
                take = np.zeros(len(t), bool)
                for a, b in zip(starts[often].tolist(), ends[often].tolist(), strict=True):
                    take[a:b] = True
                at = np.flatnonzero(take)
                if len(at):
                    yield from rows(t.take(pa.array(at)), DROP, first=fresh_key[at])
                a = int(starts[-1])
                held, loose, docs, head = [], opening, int(n[-1]), t.slice(a, 1)
                yield from told(t.slice(a), True)
            key, last_doc = (int(h1[-1]), int(h2[-1])), (doc[-1].as_py(), int(body[-1]))
        if key is not None:
            for part in held:
                yield from rows(part, OPEN)
            yield from rows(head, COUNT, docs)

    return run


def duplicates(df: DataFrame, min_docs: int, min_chars: int = 1, keep: str = "none", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, body, pos) of every line to drop."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    spark = df.sparkSession
    lines = df.select(F.col(key).alias("doc"), _body(F.col(text)).alias("body"), F.posexplode(line_keys(F.col(text))).alias("pos", "k"))
    lines = lines.filter(F.length("k") >= min_chars)
    lines = lines.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k", F.lit(2)).alias("h2"), "doc", "body", "pos")
    ranged = lines.repartitionByRange(partitions(spark), "h1", "h2", "doc", "body").sortWithinPartitions("h1", "h2", "doc", "body", "pos")
    found = stored(ranged.mapInArrow(_stream(min_docs), _FOUND.format(df.schema[key].dataType.simpleString())))
    drop = found.filter(F.col("kind") == DROP).select("doc", "body", "pos", "first")
    line = F.struct("doc", "body", "pos")
    # two keys for each partition, and one for every HELD lines at most; written, so that its size is
    # known: while it is small it is broadcast, and the lines of a frequent key stay where they are
    counts = found.filter(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.min(line).alias("head"))
    counts = stored(counts.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "head"))
    known = found.filter(F.col("kind") == OPEN).select("h1", "h2", "doc", "body", "pos").join(counts, ["h1", "h2"])
    drop = drop.unionByName(known.select("doc", "body", "pos", line.eqNullSafe(F.col("head")).alias("first")))
    if keep == "first":
        drop = drop.filter(~F.col("first"))
    return drop.select("doc", "body", "pos")


def keep_bitmaps(df: DataFrame, min_docs: int, min_chars: int = 1, keep: str = "none", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, body and bitmap of the documents that lose lines: bit i of the unzipped bitmap, low
    bits first, says that line i stays; lines beyond its end stay."""
    per = duplicates(df, min_docs, min_chars, keep, key, text).groupBy("doc", "body").agg(F.collect_set("pos").alias("pos"))

    @F.pandas_udf("binary")
    def bitmap(pos):
        def one(p):
            bits = np.ones(int(max(p)) // 8 * 8 + 8, np.uint8)  # whole bytes: bits beyond the lines stay set
            bits[np.asarray(p)] = 0
            return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)

        return pos.map(one)

    return per.select("doc", "body", bitmap("pos").alias("bitmap"))


def kept_text(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """The kept lines, how many lines there were, how many went."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    out = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
    return "\n".join(out), len(lines), len(lines) - len(out)


def cleaned(df: DataFrame, min_docs: int, min_chars: int = 1, keep: str = "none", key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its texts' kept lines in `text`, and n_lines, n_dropped and kept_sha256."""
    df = df.drop("n_lines", "n_dropped", "kept_sha256")
    doc, body, bitmap, kept = fresh(df, "doc", "body", "bitmap", "kept")
    maps = keep_bitmaps(df, min_docs, min_chars, keep, key, text).toDF(doc, body, bitmap)
    own = fresh(df, "own_body")[0]
    df = df.withColumn(own, _body(F.col(text)))
    joined = df.join(maps, F.col(key).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(body)), "left")

    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint, kept_sha256 string")
    def apply(texts, bitmaps):
        import pandas as pd

        rows = [kept_text(t or "", b) for t, b in zip(texts, bitmaps, strict=True)]
        out = pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])
        out["kept_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in out["text"]]
        return out

    joined = joined.withColumn(kept, apply(F.col(text), bitmap))
    out = {text: "text", "n_lines": "n_lines", "n_dropped": "n_dropped", "kept_sha256": "kept_sha256"}
    return joined.withColumns({c: F.col(kept)[x] for c, x in out.items()}).drop(kept, own, doc, body, bitmap)
