"""Operator 8: token counts by rank-synchronous array merging (see bpe).

A text is cut where a space or line feed follows a character that is surely no white space; the
vocabulary's split pattern never matches across such a place, so the pieces are independent and
equal pieces are merged once. Each piece is split by the pattern and its pre-tokens merged
together with those of the whole batch. A special string in a text is one token, and the texts
on its two sides are separate, as the library treats them by default.

Null and empty texts have 0 tokens. Repeated rows repeat their result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from larchgraph.llm import bpe

SPECIAL = b"<|endoftext|>"
#: Bytes of text worked on at once.
CHUNK = 1_000_000
_state: dict[str, bpe.Pieces] = {}


def _split(new: list[bytes]) -> tuple[list[bytes], list[int], dict]:
    import public_tokenizers
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    tokens: list[bytes] = []
    owner: list[int] = []
    for k, piece in enumerate(new):
        found = find(piece.decode())
        tokens += [x.encode() for x in found]
        owner += [k] * len(found)
    return tokens, owner, {}


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of the independent pieces of texts that lie end to end."""
    gap = (data == 32) | (data == 10)
    solid = (data > 32) & (data < 127)
    # the second byte of a two-byte character from U+00C0 to U+07FF, none of which is white space
    solid[1:] |= (data[1:] >= 128) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    at = np.flatnonzero(gap[1:] & solid[:-1]) + 1
    return np.unique(np.concatenate([offsets, at]))


def count(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text."""
    if path not in _state:
        _state[path] = bpe.Pieces(path, _split)
    total = np.zeros(len(texts), np.int64)
    texts = texts.fill_null("")
    special = pc.match_substring(texts, SPECIAL.decode()).to_numpy(zero_copy_only=False)
    owner = np.arange(len(texts))
    if special.any():
        parts, owner_list = [], []
        for k, text in enumerate(texts.to_pylist()):
            own = text.split(SPECIAL.decode()) if special[k] else [text]
            total[k] += len(own) - 1
            parts += own
            owner_list += [k] * len(own)
        texts, owner = pa.array(parts, pa.large_string()), np.array(owner_list)
    data, offsets = bpe.bytes_of(texts)
    if len(data):
        at = cuts(data, offsets)
        rows, _, counts = _state[path].ids(bpe.pieces_of(data, at))
        sums = np.concatenate([[0], np.cumsum(counts[rows])])
        place = np.searchsorted(at, offsets)
        total += np.bincount(owner, sums[place[1:]] - sums[place[:-1]], len(total)).astype(np.int64)
    return total


def by_bytes(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in a string column; a longer text stands alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // most
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def token_counts(df: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                n = count(part.column("text"), path)
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key"), size, pa.array(n), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])
        bpe.forget(_state)

    kind = df.schema[key].dataType.simpleString()
    return (
        df.selectExpr(f"`{key}` as key", f"`{text}` as text")
        .mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
        .withColumnRenamed("key", key)
    )
