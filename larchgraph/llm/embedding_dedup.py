"""Operator 12: near-duplicate embeddings by product quantisation.

1. Equal vectors of a label are one class, stood for by its least id and counted; all further work
   is on classes. Unit vectors x of cosine >= c lie within t = sqrt(2 - 2c) of each other.
2. A sample of at most SAMPLE classes and SAMPLE_FLOATS numbers fits the index: spherical k-means
   gives coarse lists, k-means on the residuals' subspaces gives codewords. Every class is indexed:
   its list is that of the nearest centre, its code the nearest codeword of each subspace, and its
   error the distance between the vector and what list and code give back.
3. Probes are sufficient by geometry, not by count. The plane halfway between two centres lies
   between x and y, so one of two linked vectors is within t / 2 of it: x probes a list if x is that
   near to the plane between the list's centre and its own. Nothing linked is lost.
4. In a list, table lookups give the distances d of a query to the members' codes. A member of error e
   with d - e > t cannot be linked; all others are compared by exact cosine in double precision.
5. Members within half the angle of a list's centre are its core. A vector within half the angle of
   a centre is linked with all of its core, without comparing: a crowd of near copies is counted, not
   paired. A vector beyond one and a half angles is linked with none of the core.
6. A task compares a block of queries with a block of one list's members, and tells sums of links and
   the edges of a spanning forest only. Components follow from the edges.

What stays costly is a crowd whose members are nearer than the threshold, but further from their
centre than half its angle: its blocks are compared in full.

Linked are vectors of equal, not null label and equal length. Vectors that are null, empty or zero or have
null or non-finite components, and rows without an id or label, are linked with nothing and have 0 links.
Rows without an id have no component and are kept. Repeated rows are copies, each of them a vector.
An empty table gives no rows; extra columns are ignored. Lengths other than the sample's commonest
one have a single list without codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchgraph.llm.common import dropped, stored
from larchgraph.llm.components import components

COSINE = 0.93
#: Classes, and numbers, that the index is fitted on at most; lists at most, subspaces, codewords of each.
SAMPLE, SAMPLE_FLOATS, LISTS, SUBSPACES, CODES = 16_384, 2_000_000, 1024, 8, 256
#: Queries and members of a block; queries compared at once.
QUERIES, MEMBERS, STRIP = 8192, 4096, 256
_SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _means(x: np.ndarray, k: int, spherical: bool, rounds: int = 8) -> np.ndarray:
    """k-means from the first k distinct rows; a list that empties keeps its centre."""
    centers = np.unique(x, axis=0)
    centers = centers[np.random.default_rng(12).permutation(len(centers))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centers.T - (0 if spherical else (centers * centers).sum(1) / 2)).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))[:, None]
        if spherical:
            n = np.sqrt((sums * sums).sum(1, keepdims=True))
        full = n[:, 0] > 1e-9
        centers[full] = sums[full] / n[full]
    return centers


class Index:
    """Coarse centres and the codewords of each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float):
        self.dim, self.cosine = sample.shape[1], cosine
        self.far = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
        angle = math.acos(max(-1.0, min(1.0, cosine)))
        self.core, self.shell = math.cos(max(0.0, angle / 2 - _SLACK)), math.cos(min(math.pi, 1.5 * angle + _SLACK))
        self.parts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.words: list[np.ndarray] = []
        if len(sample):
            self.centers = _means(unit(sample), lists, True)
            rest = unit(sample)
            rest -= self.centers[(rest @ self.centers.T).argmax(1)]
            self.words = [_means(rest[:, p], CODES, False) for p in self.parts]
        else:
            self.centers = np.eye(1, self.dim)
        self.bisector = np.sqrt(np.maximum(2 - 2 * self.centers @ self.centers.T, 1e-30))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: the list, whether in its core, and for each list two flags, whether its
        members outside the core are probed, and how its core is: 0 not, 1 compared, 2 linked."""
        near = x @ self.centers.T
        own = near.argmax(1)
        best = near[np.arange(len(x)), own]
        plane = (best[:, None] - near) / self.bisector[own]
        plane[np.arange(len(x)), own] = 0
        return own, best >= self.core, plane <= self.far / 2, np.where(near >= self.core, 2, np.where(near >= self.shell, 1, 0))

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, a byte for each subspace, and errors. Without codewords no code and no bound."""
        rest = x - self.centers[own]
        codes = np.zeros((len(x), len(self.words)), np.uint8)
        for m, (p, w) in enumerate(zip(self.parts, self.words, strict=False)):
            codes[:, m] = (rest[:, p] @ w.T - (w * w).sum(1) / 2).argmax(1)
            rest[:, p] -= w[codes[:, m]]
        return codes, np.sqrt((rest * rest).sum(1)) if self.words else np.full(len(x), 9.0)

    def near(self, x: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Which members of list `at` may be linked with which of the unit vectors x."""
        if not self.words:
            return np.ones((len(x), len(error)), bool)
        rest = (x - self.centers[at]).astype(np.float32)
        total = np.zeros((len(x), len(error)), np.float32)
        for m, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            r, w = rest[:, p], w.astype(np.float32)
            table = (r * r).sum(1)[:, None] - 2 * r @ w.T + (w * w).sum(1)
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0)) <= (self.far + 1e-3 + error)[None, :].astype(np.float32)


class Indexes:
    """The fitted index for vectors of the commonest length; plain ones for other lengths."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float):
        self.fitted, self.lists, self.cosine = Index(sample, lists, cosine), lists, cosine

    def of(self, dim: int) -> Index:
        return self.fitted if dim == self.fitted.dim else Index(np.zeros((0, dim)), 1, self.cosine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _indexed(indexes: Indexes, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for lo in range(0, part.num_rows, STRIP):
                    some = part.slice(lo, STRIP)
                    index, x = indexes.of(dim), unit(_matrix(some.column("v"), dim))
                    own, core, rim, cores = index.place(x)
                    codes, error = index.encode(x, own)
                    flags = rim * 1 + np.where(cores == 1, 2, 0)
                    probes = [(np.flatnonzero(f) * 4 + f[np.flatnonzero(f)]).tolist() for f in flags]
                    sure = [np.flatnonzero(c == 2).tolist() for c in cores]
                    yield pa.RecordBatch.from_arrays(
                        [*(some.column(c) for c in ("label", "rep", "w", "dim", "v")), pa.array(own), pa.array(core), pa.array(probes, pa.list_(pa.int32())),
                         pa.array(sure, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                        names,
                    )

    return run


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is joined with by edges (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compared(indexes: Indexes):
    """Links between the queries and members of one block: sums for each vector, and edges."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("query", "ascending"), ("rep", "ascending")]).combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        rep, w, core, own = col("rep"), col("w"), col("core"), col("own")
        dim, at = int(col("dim")[0]), int(col("at")[0])
        n_members = int((~col("query")).sum())
        index = indexes.of(dim)
        raw = _matrix(t.column("v").chunk(0) if t.column("v").num_chunks else t.column("v").combine_chunks(), dim)
        x = unit(raw)
        member, flag = slice(0, n_members), col("flag")
        codes = np.frombuffer(b"".join(t.column("code").slice(0, n_members).to_pylist()), np.uint8).reshape(n_members, len(index.words))
        error, m_core = col("error")[member], core[member]
        probes = t.column("probed").slice(0, n_members).combine_chunks()
        begin = probes.offsets.to_numpy()
        probed = set((np.repeat(np.arange(n_members), np.diff(begin)) * (4 * LISTS) + probes.flatten().to_numpy()).tolist())
        links = np.zeros(len(rep), np.int64)
        edges: list[np.ndarray] = []
        for lo in range(n_members, len(rep), STRIP):
            rows = np.arange(lo, min(lo + STRIP, len(rep)))
            may = index.near(x[rows], at, codes, error)
            may &= np.where(m_core[None, :], (flag[rows] & 2)[:, None] > 0, (flag[rows] & 1)[:, None] > 0)
            may &= rep[rows][:, None] != rep[member][None, :]
            q, r = np.nonzero(may)
            if len(q) * 4 > may.size:
                sure = (x[rows] @ x[member].T)[q, r] >= indexes.cosine
            else:
                sure = np.concatenate([(x[rows[q[i : i + 20_000]]] * x[r[i : i + 20_000]]).sum(1) >= indexes.cosine for i in range(0, len(q), 20_000)] or [np.zeros(0, bool)])
            q, r = rows[q[sure]], r[sure]
            if not len(q):
                continue
            np.add.at(links, q, w[r])
            # a member that does not probe the query's bin is not told of the link elsewhere
            back = r * (4 * LISTS) + own[q] * 2 + core[q]
            untold = np.array([k not in probed for k in back.tolist()], bool)
            np.add.at(links, r[untold], w[q[untold]])
            nodes, pos = np.unique(np.concatenate([q, r]), return_inverse=True)
            low = spanning(pos[: len(q)], pos[len(q) :], len(nodes))
            tie = np.flatnonzero(low != np.arange(len(nodes)))
            edges.append(np.stack([nodes[low[tie]], nodes[tie]]))
        if edges:
            a, b = np.concatenate(edges, 1)
            low = spanning(a, b, len(rep))
            b = np.flatnonzero(low != np.arange(len(rep)))
            a = low[b]
        else:
            a = b = np.zeros(0, np.int64)
        told = np.flatnonzero(links)
        none = pa.nulls(len(told), t.schema.field("rep").type)
        ids = t.column("rep").combine_chunks()
        return pa.table({
            "rep": pa.concat_arrays([ids.take(pa.array(told)), ids.take(pa.array(b))]),
            "links": pa.concat_arrays([pa.array(links[told]), pa.array(np.zeros(len(b), np.int64))]),
            "other": pa.concat_arrays([none, ids.take(pa.array(a))]),
        })

    return run


def fitted(classes: DataFrame, cosine: float) -> Indexes:
    """The index of a bounded sample: the classes of least hash."""
    load = classes.groupBy("label", "dim").count().agg(F.max(F.struct("count", "dim")).alias("m")).first()["m"]
    if load is None:
        return Indexes(np.zeros((0, 1)), 1, cosine)
    rows = max(1, min(SAMPLE, SAMPLE_FLOATS // load["dim"]))
    sample = classes.filter(F.col("dim") == load["dim"]).select("v", F.xxhash64("rep").alias("h")).orderBy("h", "v").limit(rows).collect()
    lists = max(1, min(LISTS, len(sample) // 8, math.isqrt(load["count"])))
    return Indexes(np.array([r["v"] for r in sample], float), lists, cosine)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.select("id", "label", "v", "usable", F.xxhash64("v").alias("f1"), F.xxhash64(F.lit(1), "v").alias("f2"))
    same = ["label", "f1", "f2", "dim"]
    classes = rows.filter("usable").groupBy("label", "f1", "f2", F.size("v").alias("dim"), "v").agg(F.min("id").alias("rep"), F.count("*").alias("w"))
    classes = stored(classes)
    indexes = fitted(classes, cosine)
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    names = ["label", "rep", "w", "dim", "v", "own", "core", "probes", "sure", "code", "error"]
    schema = f"label {kinds['label']}, rep {kinds['rep']}, w bigint, dim int, v {kinds['v']}, own bigint, core boolean, probes array<int>, sure array<int>, code binary, error double"
    index = stored(classes.select(*names[:5]).mapInArrow(_indexed(indexes, names), schema))
    # cores: linked without comparing
    cores = index.filter("core").groupBy("label", "dim", "own").agg(F.min("rep").alias("hub"), F.sum("w").alias("total"), F.count("*").alias("n"))
    sure = index.select("label", "dim", "rep", "w", F.col("own").alias("home"), F.explode(F.col("sure").cast("array<bigint>")).alias("own")).join(cores, ["label", "dim", "own"])
    sure = sure.select("rep", (F.col("total") - F.when(F.col("home") == F.col("own"), F.col("w")).otherwise(0)).alias("links"), F.when(F.col("hub") != F.col("rep"), F.col("hub")).alias("other"))
    # the rest: blocks of queries against blocks of members
    queries = index.filter(F.size("probes") > 0).select("*", F.explode("probes").alias("p"))
    queries = queries.withColumn("at", F.shiftright("p", 2).cast("bigint")).withColumn("flag", F.col("p").bitwiseAND(3))
    blocks = index.groupBy("label", "dim", F.col("own").alias("at")).agg(F.ceil(F.count("*") / MEMBERS).alias("blocks"))
    asked = queries.groupBy("label", "dim", "at").agg(F.ceil(F.count("*") / QUERIES).alias("askers"))
    met = stored(blocks.join(asked, ["label", "dim", "at"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    probed = F.concat(
        F.flatten(F.transform("probes", lambda p: F.filter(F.array(F.when(p % 2 == 1, F.shiftright(p, 2) * 2), F.when(F.shiftright(p, 1) % 2 == 1, F.shiftright(p, 2) * 2 + 1)), lambda b: b.isNotNull()))),
        F.transform("sure", lambda s: s * 2 + 1),
    )
    side = ["label", "dim", "at", "i", "j", "query", "rep", "w", "v", "own", "core", "code", "error", "flag", "probed"]
    nothing = F.lit(None).cast("array<int>")
    left = queries.join(met, ["label", "dim", "at"]).withColumns({"i": deal("askers"), "query": F.lit(True), "probed": nothing, "code": F.lit(None).cast("binary")}).withColumn("j", every("blocks"))
    right = index.withColumn("at", F.col("own")).join(met, ["label", "dim", "at"])
    right = right.withColumns({"j": deal("blocks"), "query": F.lit(False), "flag": F.lit(0), "probed": probed}).withColumn("i", every("askers"))
    parts = left.select(*side).unionByName(right.select(*side))
    compared = stored(parts.groupBy("label", "dim", "at", "i", "j").applyInArrow(_compared(indexes), f"rep {kinds['rep']}, links bigint, other {kinds['rep']}"))
    found = stored(compared.unionByName(sure))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = classes.select(*same, "rep", "w").join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    known = stored(known.select(*same, (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    dropped(classes, index, met, compared, found)
    out = rows.select("id", "usable", "label", "f1", "f2", F.size("v").alias("dim")).join(known.withColumn("usable", F.lit(True)), ["usable", *same], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
