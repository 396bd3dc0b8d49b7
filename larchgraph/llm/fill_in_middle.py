"""Operator 11: fill-in-the-middle, with cuts from a Roaring-style set of boundaries.

Each text has a set of the offsets at which a unit ends: a token (white space and the word after
it, or white space at the end) or a character. The set is kept as containers of 65,536 offsets,
each in the smallest of three forms: a sorted array, a bitmap, or runs. Cumulative cardinalities
of the containers lead select(k) to the container that holds the k-th boundary, and a local select
finds it there: an array is indexed, runs are searched by their own running lengths, a bitmap by
the running bit counts of its words. A batch of texts is one set of each text's containers, laid
end to end, so both cuts of all texts are selected at once.

A text is cut at the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) units. h1 to h4 are
the first four groups of 8 hex digits of the sha256 of "seed:key". A text stays plain if it is
empty, has a marker in it, or h3 % 100 >= rate; otherwise suffix-prefix-middle if h4 % 100 < spm,
else prefix-suffix-middle.

A null text is an empty one; a null key hashes as an empty one. Repeated rows repeat their result,
extra columns pass through; columns of the caller that are named as results are replaced. Texts
of any length are cut whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchgraph.llm import bpe
from larchgraph.llm.common import fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80
#: Bytes of text worked on at once; a longer text stands alone.
CHUNK = 2_000_000
SPAN = 1 << 16
#: Forms of a container.
ARRAY, BITMAP, RUNS = 0, 1, 2
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Boundaries:
    """Sets of offsets, one for each owner, as containers that lie end to end.

    first: the number of each owner's first container, and one more; key: a container's number of
    65,536 offsets; before: cumulative cardinality before it, and one more; kind: its form; at: where
    its part of `arrays` (offsets), `words` (64 bits each) or `runs` (start, length) begins, and size
    of that part; rank: the bits of a bitmap before each word, the length of runs before each run."""

    first: np.ndarray
    key: np.ndarray
    before: np.ndarray
    kind: np.ndarray
    at: np.ndarray
    size: np.ndarray
    arrays: np.ndarray
    words: np.ndarray
    word_rank: np.ndarray
    runs: np.ndarray
    run_rank: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return self.before[self.first[1:]] - self.before[self.first[:-1]]

    def select(self, owner: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th offset (from 0) of each owner's set; every k is below the owner's count."""
        rank = self.before[self.first[owner]] + k
        c = np.searchsorted(self.before, rank, "right") - 1
        local = rank - self.before[c]
        low = np.zeros(len(rank), np.int64)
        kind, at, size = self.kind[c], self.at[c], self.size[c]
        i = np.flatnonzero(kind == ARRAY)
        low[i] = self.arrays[at[i] + local[i]]
        for j in np.flatnonzero(kind == RUNS).tolist():
            ranks = self.run_rank[at[j] : at[j] + size[j]]
            r = int(np.searchsorted(ranks, local[j], "right")) - 1
            low[j] = int(self.runs[at[j] + r, 0]) + local[j] - ranks[r]
        for j in np.flatnonzero(kind == BITMAP).tolist():
            ranks = self.word_rank[at[j] : at[j] + size[j]]
            w = int(np.searchsorted(ranks, local[j], "right")) - 1
            bits = np.unpackbits(self.words[at[j] + w : at[j] + w + 1].view(np.uint8), bitorder="little")
            low[j] = 64 * w + int(np.flatnonzero(bits)[local[j] - ranks[w]])
        return self.key[c] * SPAN + low


def boundaries(owner: np.ndarray, offset: np.ndarray, owners: int) -> Boundaries:
    """Sets of distinct offsets, sorted by owner and offset. A container takes its smallest form:
    2 bytes for each offset, 4 for each run, 8,192 for a bitmap."""
    n = len(offset)
    high, low = offset // SPAN, offset % SPAN
    new = np.ones(n, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (high[1:] != high[:-1])
    begin = np.flatnonzero(new)
    edge = np.append(begin, n)
    card = np.diff(edge)
    starts_run = new.copy()
    starts_run[1:] |= low[1:] != low[:-1] + 1
    run_at = np.flatnonzero(starts_run)
    n_runs = np.diff(np.searchsorted(run_at, edge))
    cost = np.stack([2 * card, np.full(len(card), SPAN // 8), 4 * n_runs])
    kind = cost.argmin(0)
    container = np.repeat(np.arange(len(card)), card)
    # arrays
    in_array = kind[container] == ARRAY
    arrays = low[in_array].astype(np.uint16)
    # bitmaps: one after another
    maps = np.flatnonzero(kind == BITMAP)
    place = np.full(len(card), -1)
    place[maps] = np.arange(len(maps))
    in_map = kind[container] == BITMAP
    flags = np.zeros(len(maps) * SPAN, np.uint8)
    flags[place[container[in_map]] * SPAN + low[in_map]] = 1
    words = np.packbits(flags, bitorder="little").view(np.uint64)
    ones = np.bitwise_count(words).astype(np.int64).reshape(len(maps), SPAN // 64)
    word_rank = (np.cumsum(ones, 1) - ones).ravel()
    # runs
    length = np.diff(np.append(run_at, n))
    of_runs = kind[container[run_at]] == RUNS if n else np.zeros(0, bool)
    runs = np.stack([low[run_at[of_runs]], length[of_runs]], 1) if n else np.zeros((0, 2), np.int64)
    run_rank = run_at[of_runs] - begin[container[run_at[of_runs]]] if n else np.zeros(0, np.int64)
    size = np.where(kind == ARRAY, card, np.where(kind == BITMAP, SPAN // 64, n_runs))
    at = np.zeros(len(card), np.int64)
    for form in (ARRAY, BITMAP, RUNS):
        own = size * (kind == form)
        at = np.where(kind == form, np.cumsum(own) - own, at)
    first = np.searchsorted(owner[begin], np.arange(owners + 1))
    return Boundaries(first, high[begin], np.append(0, np.cumsum(card)), kind, at, size, arrays, words, word_rank, runs, run_rank)


def ends(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(owner, offset in code points) of the ends of units of UTF-8 texts that lie end to end."""
    lead = (data & 0xC0) != 0x80
    last = np.ones(len(data), bool)
    if unit == "char":
        last[:-1] = lead[1:]
    else:
        space = _SPACES[data]
        last[:-1] = ~space[:-1] & space[1:]
        last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True  # a text's last byte ends a unit in any case
    at = np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, at - 1, "right") - 1
    points = np.append(0, np.cumsum(np.add.reduceat(lead, np.append(0, at[:-1]), dtype=np.int64))) if len(at) else np.zeros(1, np.int64)
    before = np.searchsorted(at, offsets[:-1], "right")
    return owner, points[1:] - points[before[owner]]


def _cuts(unit: str):
    def run(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // CHUNK
        edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(texts)]
        n, cut = np.zeros(len(texts), np.int64), np.zeros((2, len(texts)), np.int64)
        draws = np.stack([h1.to_numpy(), h2.to_numpy()])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            data, offsets = bpe.bytes_of(texts.slice(a, b - a))
            found = boundaries(*ends(data, offsets, unit), b - a)
            n[a:b] = found.counts
            units = np.sort(draws[:, a:b] % (n[a:b] + 1), 0)
            for k in (0, 1):
                rows = np.flatnonzero(units[k])
                cut[k, a + rows] = found.select(rows, units[k, rows] - 1)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(cut[0]), pa.array(cut[1])], ["n", "low", "high"])

    return F.arrow_udf(run, "n bigint, low bigint, high bigint")


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "token", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """df with n (units), form, prefix_chars, middle_chars (null if plain) and output."""
    body, h, cut = fresh(df, "_body", "_hash", "_cut")
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made]
    part = lambda i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
    out = df.withColumn(body, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    out = out.withColumn(h, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256))
    out = out.withColumn(cut, _cuts(unit)(F.col(body), part(0), part(1)))
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    form = F.when((F.col(body) == "") | (part(2) % 100 >= rate) | marked, "plain").when(part(3) % 100 < spm, "spm").otherwise("psm")
    low, high = F.col(f"{cut}.low"), F.col(f"{cut}.high")
    piece = lambda since, upto: F.substring(F.col(body), (since + 1).cast("int"), (upto - since).cast("int"))
    first, middle = piece(F.lit(0), low), piece(low, high)
    last = F.substring(F.col(body), (high + 1).cast("int"), F.lit(2**31 - 1))
    output = (
        F.when(F.col("form") == "plain", F.col(body))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), last, F.lit(PREFIX), first, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(PREFIX), first, F.lit(SUFFIX), last, F.lit(MIDDLE), middle))
    )
    chars = lambda c: F.when(F.col("form") != "plain", c)
    out = out.select(*own, F.col(body), F.col(cut), F.col(f"{cut}.n").alias("n"), form.alias("form"))
    return out.select(*own, "n", "form", chars(low).alias("prefix_chars"), chars(high - low).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A transformed text has each marker once."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    at = lambda i: F.element_at(pieces, i)
    return F.when(form == "plain", output).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(F.concat(at(2), at(4), at(3)))
