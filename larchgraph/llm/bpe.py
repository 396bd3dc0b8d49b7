"""Byte-pair merging over ragged numpy arrays, for the public vocabularies (operators 6 and 8).

A batch of pre-tokens is one flat array of symbols with row starts. In each round every row finds
its own lowest-ranked adjacent pair and merges all its occurrences at once; rows without a known
pair leave the batch. A merged symbol only occurs in pairs of higher rank, so rounds give what
merging one pair at a time gives. Repeated pieces of text are merged once and remembered.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

NONE = np.int32(2**31 - 1)
#: Remembered pieces; beyond it memory is cleared, which costs time and changes no result.
REMEMBERED = 400_000


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    """The merges of a tokenizer file as a hash table from pairs of ids to ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._index((left << 20) | right)

    def _index(self, keys: np.ndarray) -> None:
        self.bits = int(4 * len(keys)).bit_length()
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size + 64, -1, np.int64), np.full(size + 64, NONE, np.int32)
        self.probes = 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            step = 0
            while self.keys[at + step] >= 0 and self.keys[at + step] != key:
                step += 1
            if self.keys[at + step] < 0:
                self.keys[at + step], self.ranks[at + step] = key, rank
            self.probes = max(self.probes, step + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 20) | b
        at = self._slot(keys)
        out, seen = np.full(len(keys), NONE, np.int32), self.keys[at]
        hit = seen == keys
        out[hit] = self.ranks[at[hit]]
        open_ = np.flatnonzero(~hit & (seen >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            seen = self.keys[at[open_] + step]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]] + step]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens (their bytes end to end, and lengths of at least 1) to (ids, ids of each)."""
        sym = self.first[data]
        ends = np.cumsum(lengths)
        sym[ends - 1] = self.last[data[ends - 1]]
        rows, size = np.arange(len(lengths)), lengths.astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            starts = np.cumsum(size) - size
            rank = np.full(len(sym), NONE, np.int32)
            rank[:-1] = self.rank(sym[:-1], sym[1:])
            rank[starts + size - 1] = NONE
            least = np.minimum.reduceat(rank, starts)
            alive = least != NONE
            if not alive.all():
                each = np.repeat(alive, size)
                done.append((rows[~alive], size[~alive], sym[~each]))
                rows, size, sym, rank, least = rows[alive], size[alive], sym[each], rank[each], least[alive]
                if not len(rows):
                    break
            hit = rank == np.repeat(least, size)
            # in a run such as aaaa the pairs overlap: every second one counts, from the left
            at = np.flatnonzero(hit)
            fresh = np.ones(len(at), bool)
            fresh[1:] = np.diff(at) != 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            starts = np.cumsum(size) - size
            size = size - np.add.reduceat(gone.astype(np.int64), starts)
            sym = sym[~gone]
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        order = np.concatenate([r for r, _, _ in done])
        counts = np.concatenate([n for _, n, _ in done])
        flat = np.concatenate([s for _, _, s in done])
        back = np.argsort(order)
        return gather(flat, np.cumsum(counts) - counts, counts, back), counts[back]


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The ragged rows `rows` of flat, end to end."""
    n = counts[rows]
    total = int(n.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(starts[rows] - (np.cumsum(n) - n), n)
    return flat[shift + np.arange(total)]


class Pieces:
    """Ids of pieces of text, each worked out once while it is remembered."""

    def __init__(self, path: str, split):
        self.merger, self.split = Merger(path), split
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a binary array of pieces: rows into (flat, counts), and those two."""
        coded = pieces.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        if len(self.at) + len(unique) > REMEMBERED and len(self.at):
            self.clear()
        new = [u for u in unique if u not in self.at]
        if new:
            self._learn(new)
        rows = np.fromiter((self.at[u] for u in unique), np.int64, len(unique))
        return rows[coded.indices.to_numpy(zero_copy_only=False)], self.flat, self.counts

    def _learn(self, new: list[bytes]) -> None:
        tokens, owner, ready = self.split(new)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        flat, counts = self.merger.merge(data, np.fromiter(map(len, tokens), np.int64, len(tokens)))
        owner = np.asarray(owner, np.int64)
        per = np.bincount(owner, counts, len(new)).astype(np.int64) if len(owner) else np.zeros(len(new), np.int64)
        for k, ids in ready.items():  # what the library itself has encoded
            per[k] = len(ids)
        if ready:
            starts, out = np.cumsum(per) - per, np.zeros(int(per.sum()), np.int32)
            mine = np.ones(len(out), bool)
            for k, ids in ready.items():
                out[starts[k] : starts[k] + len(ids)] = ids
                mine[starts[k] : starts[k] + len(ids)] = False
            out[mine] = flat
            flat = out
        base = len(self.counts)
        self.at.update(zip(new, range(base, base + len(new)), strict=True))
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, per])


def forget(state: dict[str, Pieces]) -> None:
    """Clears what pieces remember, at a task's end: Python workers outlive their tasks."""
    for pieces in state.values():
        pieces.clear()
    pa.default_memory_pool().release_unused()


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and len + 1 offsets; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    # a slice of an array shares the whole array's buffers
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over bytes that lie end to end."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
