"""Operator 13: repair of conversations by a rank-convergence parallel Viterbi search.

A conversation's rows, by turn, become the sequence (system)? (user assistant)+ or nothing, at least
cost: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant text,
anywhere) 2, and a truncated row that stays 1 more. Blank and duplicate rows have to be deleted. Of the
cheapest ways the one whose string of initials (D, I, K, R) is least is taken.

The costs of going on from each of four states (nothing told yet, after system, after user, after assistant)
are a vector, worked out from the end backwards. Vectors that differ by a constant lead to the same choices,
so a vector is known by its differences; there are few of them, and a row leads from one to another.

1. Rows are range-sorted and numbered, and cut into blocks of consecutive rows. A block that lies
   within one conversation starts from a speculative vector of zeros, all blocks at once.
2. Fix-up passes: a block whose right neighbour ends in another vector than the block started from
   reruns from that one, until it meets its own earlier vectors: from there on they differ by a
   constant only, and its result stands. This ends when no block starts from a wrong vector.
   Vectors may stay apart for ever (rows of one unusable role, say), so after ROUNDS passes the blocks
   left give their whole maps, from one vector for each state, which are multiplied by doubling.
3. With each block's right vector known, blocks tell in which state they are left for each state in
   which they may be entered; these maps are composed by doubling, most of them being constant.
4. Blocks are traced with their own vector and state. No task holds more than a block of a conversation.

The rows' order is by turn (null first), then role, then text; rows equal in all are counted once and carry
their number. Null roles and texts are one space. Faults of a row, the first that applies: blank (white space
only), duplicate (role and text of an earlier row), truncated (the last character that is no white space is not . ! or ?).
A null conversation id is a conversation. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchgraph.llm.common import SPACE, dropped, partitions, stored

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Rows of a block; fix-up passes before blocks give their whole maps.
BLOCK, ROUNDS = 1024, 4
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a row may be: the role's initial (s, u, a, another), 4 more if truncated; or it has to go.
FORCED = 8
_MANY = 1 << 50
_TOLD = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}

Vector = tuple[int, ...]


def _normal(v: list[int]) -> tuple[Vector, int]:
    least = min(v)
    return tuple(x - least if x < _MANY // 2 else _MANY for x in v), least


def _closed(v: list[int]) -> list[int]:
    """Costs once insertions are allowed too."""
    for _ in range(2):
        v = [min(v[s], INSERT + v[_TOLD[s]]) for s in range(4)]
    return v


END = _normal(_closed([0, _MANY, _MANY, 0]))[0]
ZERO: Vector = (0, 0, 0, 0)
_steps: dict[tuple[int, Vector], tuple[Vector, int]] = {}
_traces: dict[tuple[int, Vector, int], tuple[str, int]] = {}


def _kept(kind: int, s: int) -> int | None:
    """The state after keeping a row in state s, if it may be kept."""
    role = kind % 4
    if role == 0:
        return SYSTEM if s == START else None
    return _TOLD[s] if role < 3 and _TOLD[s] == (USER, ASSISTANT)[role - 1] else None


def step(kind: int, v: Vector) -> tuple[Vector, int]:
    """The vector before a row, and its constant, from the vector after it."""
    if kind == FORCED:
        return v, DELETE
    if (kind, v) not in _steps:
        cut = CUT * (kind >= 4)
        out = []
        for s in range(4):
            keep = _kept(kind, s)
            out.append(min(DELETE + v[s], REROLE + cut + v[_TOLD[s]], _MANY if keep is None else cut + v[keep]))
        _steps[kind, v] = _normal(_closed(out))
    return _steps[kind, v]


def trace(kind: int, v: Vector, s: int) -> tuple[str, int]:
    """The least letters that take a row in state s, v being the vector after it, and the state then."""
    if kind == FORCED:
        return "D", s
    if (kind, v, s) not in _traces:
        before, least = step(kind, v)
        cut = CUT * (kind >= 4)
        letters, at = "", s
        while True:
            cost, keep = before[at] + least, _kept(kind, at)
            if DELETE + v[at] == cost:
                letters += "D"
            elif INSERT + before[_TOLD[at]] + least == cost:
                letters, at = letters + "I", _TOLD[at]
                continue
            elif keep is not None and cut + v[keep] == cost:
                letters, at = letters + "K", keep
            else:
                letters, at = letters + "R", _TOLD[at]
            break
        _traces[kind, v, s] = letters, at
    return _traces[kind, v, s]


def last(s: int) -> str:
    """The letters at a conversation's end."""
    return "I" * (END[s] // INSERT)


# --- rows ---


def _null_safe(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def items(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None = None) -> DataFrame:
    """conv, turn, role, text, copies (equal rows), fault (0 none, 1 blank, 2 duplicate, 3 truncated; of an
    item of several rows the first one's) and kind, in order by part and row; written."""
    space = F.lit(" ")
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"), (F.col(f"`{copies}`") if copies else F.lit(1)).cast("bigint").alias("copies"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
    # the first turn of a role and text; a null turn is the first of all
    early = rows.groupBy("conv", "role", "hash").agg(F.min("turn").alias("least"), (F.count("turn") < F.count("*")).alias("open"))
    early = early.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), F.when(~F.col("open"), F.col("least")).alias("least"))
    rows = rows.join(early, _null_safe("conv", "c") & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", 1).when(~_null_safe("turn", "least"), 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    rows = rows.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))
    # equal rows are one row by now, so ranges by the text's beginning are as even as rows allow
    order = ["conv", "turn", "role"]
    rows = rows.repartitionByRange(partitions(df.sparkSession), *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(F.col("fault").isin(1, 2), FORCED).otherwise(code + F.when(F.col("fault") == 3, 4).otherwise(0))
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return stored(rows.select("*", kind.alias("kind"), F.spark_partition_id().alias("part"), row.alias("row")))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with pos, gapless from 0 in order. The driver sums one number for each partition."""
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
    begin, at = [], 0
    for part, n in sizes:
        begin.append((part, at))
        at += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(begin, "part int, begin bigint"))  # a row for each partition
    return rows.join(offsets, "part").withColumn("pos", F.col("begin") + F.col("row")).drop("part", "begin", "row")


# --- blocks ---


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The blocks of batches that are sorted by pos and hold whole blocks, as lists."""
    held: dict[str, list] = {}
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = [0, *[i for i in range(1, len(block)) if block[i] != block[i - 1]], len(block)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            new = batch.slice(a, b - a).to_pydict()
            if held and held["block"][0] == new["block"][0]:
                held = {k: v + new[k] for k, v in held.items()}
            else:
                if held:
                    yield held
                held = new
    if held:
        yield held


def _segments(conv: list) -> list[tuple[int, int]]:
    """(since, upto) of the conversations in a block."""
    edges = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _back(kinds: list[int], v: Vector) -> Vector:
    for kind in reversed(kinds):
        v = step(kind, v)[0]
    return v


def _by_block(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "block").sortWithinPartitions("block", "pos")


def _table(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(n).type) for i, n in enumerate(names)], schema=schema)


def _speculate(schema: pa.Schema):
    """Of each block: its first and last conversation, whether they are the same one, and the vector
    before its first conversation, started from zeros (spec) and from a conversation's end (end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            parts = _segments(b["conv"])
            kinds = b["kind"][: parts[0][1]]
            row = (b["block"][0], b["conv"][0], b["conv"][-1], len(parts) == 1, list(_back(kinds, ZERO)), list(_back(kinds, END)))
            yield _table([row], schema.names, schema)

    return run


def _fix(schema: pa.Schema):
    """Reruns blocks from `now` beside `before`; where both meet, the block's earlier result stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            old, new = tuple(b["before"][0]), tuple(b["now"][0])
            for kind in reversed(b["kind"]):
                if old == new:
                    break
                old, new = step(kind, old)[0], step(kind, new)[0]
            yield _table([(b["block"][0], list(new), old == new)], schema.names, schema)

    return run


def _maps(schema: pa.Schema):
    """The map of a block: costs from each state before it to each state after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            columns = []
            for t in range(4):
                v, total = _normal(_closed([0 if s == t else _MANY for s in range(4)]))
                for kind in reversed(b["kind"]):
                    v, more = step(kind, v)
                    total += more
                columns.append([x + total if x < _MANY // 2 else _MANY for x in v])
            yield _table([(b["block"][0], [columns[t][s] for s in range(4) for t in range(4)])], schema.names, schema)

    return run


def _leave(kinds: list[int], v: Vector, s: int) -> int:
    after = [v]
    for kind in reversed(kinds):
        after.append(step(kind, after[-1])[0])
    for i, kind in enumerate(kinds):
        s = trace(kind, after[len(kinds) - 1 - i], s)[1]
    return s


def _exits(schema: pa.Schema):
    """Of blocks that a conversation goes on from: the state after it, for each state before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            since, upto = _segments(b["conv"])[-1]
            kinds, right = b["kind"][since:upto], tuple(b["right"][0])
            entered = since == 0 and b["entered"][0]
            found = [_leave(kinds, right, s) for s in (range(4) if entered else [START])]
            yield _table([(b["block"][0], found if entered else found * 4)], schema.names, schema)

    return run


def _edits(schema: pa.Schema):
    """conv, pos, letters and the state before each item, traced block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            out = []
            parts = _segments(b["conv"])
            for since, upto in parts:
                kinds = b["kind"][since:upto]
                goes_on = upto == len(b["conv"]) and b["right"][0] is not None
                after = [tuple(b["right"][0]) if goes_on else END]
                for kind in reversed(kinds):
                    after.append(step(kind, after[-1])[0])
                s = b["entry"][0] if since == 0 and b["entry"][0] is not None else START
                for i, kind in enumerate(kinds):
                    letters, then = trace(kind, after[len(kinds) - 1 - i], s)
                    letters += "D" * (b["copies"][since + i] - 1)
                    if i == len(kinds) - 1 and not goes_on:
                        letters += last(then)
                    out.append((b["conv"][since + i], b["pos"][since + i], letters, s))
                    s = then
            yield _table(out, schema.names, schema)

    return run


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def _run(df: DataFrame, function, ddl: str) -> DataFrame:
    return _by_block(df).mapInArrow(function(_arrow(df, ddl)), ddl)


def _product(a: str, b: str) -> Column:
    """The least sums of two maps, row by row."""
    at = lambda m, i, j: F.get(F.col(m), i * 4 + j)
    cell = lambda i, j: F.least(F.lit(_MANY), *[at(a, i, F.lit(k)) + at(b, F.lit(k), j) for k in range(4)])
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda c: cell(F.floor(c / 4).cast("int"), (c % 4).cast("int")))


def _applied(m: str, v: str) -> Column:
    """The vector that a map makes of a vector, without its constant."""
    cell = lambda i: F.least(F.lit(_MANY), *[F.get(F.col(m), i * 4 + k) + F.get(F.col(v), F.lit(k)) for k in range(4)])
    raw = F.transform(F.sequence(F.lit(0), F.lit(3)), cell)
    return F.transform(raw, lambda x: (x - F.array_min(raw)).cast("int"))


def _next(df: DataFrame, by: int, *columns: str, prefix: str = "next_") -> DataFrame:
    """The named columns, keyed by the block that lies `by` before."""
    return df.select((F.col("block") - by).alias("block"), *[F.col(c).alias(prefix + c) for c in columns])


def rights(thin: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(block, right): for the blocks from which a conversation goes on, the vector after them;
    and the records of all blocks. thin: conv, pos, kind, block."""
    conv = thin.schema["conv"].dataType.simpleString()
    record = stored(_run(thin.select("conv", "pos", "kind", "block"), _speculate, f"block bigint, first {conv}, last {conv}, single boolean, spec array<int>, end array<int>"))
    goes_on = record.join(_next(record, 1, "first"), "block").filter(_null_safe("last", "next_first")).select("block")
    known = record.join(goes_on.withColumn("open", F.lit(True)), "block", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    known = stored(known)
    dropped(record)
    zero = F.array(*[F.lit(0)] * 4)
    through = F.col("open") & F.col("single")
    state = known.select("block", "open", through.alias("through"), zero.alias("started"), F.when(through, F.col("spec")).otherwise(F.col("end")).alias("out"))
    state = stored(state)
    if state.filter("through").limit(1).count():
        for turn in range(rounds + 1):
            ask = state.filter("through").join(_next(state, 1, "out"), "block").filter("next_out <> started").select("block", F.col("started").alias("before"), F.col("next_out").alias("now"))
            ask = stored(ask)
            if not ask.limit(1).count():
                dropped(ask)
                break
            if turn == rounds:
                state = _settled(thin, state)
                dropped(ask)
                break
            rerun = thin.select("conv", "pos", "kind", "block").join(ask, "block")
            fixed = stored(_run(rerun, _fix, "block bigint, vector array<int>, met boolean"))
            new = state.join(ask.select("block", "now"), "block", "left").join(fixed, "block", "left")
            out = F.when(F.col("met") | F.col("met").isNull(), F.col("out")).otherwise(F.col("vector"))
            new = stored(new.select("block", "open", "through", F.coalesce("now", "started").alias("started"), out.alias("out")))
            dropped(ask, fixed, state)
            state = new
    right = stored(state.filter("open").join(_next(state, 1, "out"), "block").select("block", F.col("next_out").alias("right")))
    dropped(state)
    return right, known


def _settled(thin: DataFrame, state: DataFrame) -> DataFrame:
    """state with the right vectors of all blocks that lie within a conversation, from their maps."""
    inner = state.filter("through").select("block")
    maps = stored(_run(thin.select("conv", "pos", "kind", "block").join(inner, "block"), _maps, "block bigint, map array<bigint>"))
    # upto: the block after those that a map spans
    spans = stored(maps.select("block", "map", (F.col("block") + 1).alias("upto")))
    while True:
        more = spans.select(F.col("block").alias("upto"), F.col("map").alias("next_map"), F.col("upto").alias("next_upto"))
        if not spans.join(more.select("upto"), "upto", "left_semi").limit(1).count():
            break
        grown = spans.join(more, "upto", "left")
        grown = grown.select("block", F.when(F.col("next_map").isNull(), F.col("map")).otherwise(_product("map", "next_map")).alias("map"), F.coalesce("next_upto", "upto").alias("upto"))
        new = stored(grown)
        dropped(spans)
        spans = new
    ends = spans.join(state.select(F.col("block").alias("upto"), F.col("out").alias("after")), "upto").select("block", _applied("map", "after").alias("exact"))
    out = stored(state.join(ends, "block", "left").select("block", "open", "through", "started", F.coalesce("exact", "out").alias("out")))
    dropped(maps, spans)
    return out


def entries(thin: DataFrame, right: DataFrame) -> DataFrame:
    """(block, entry): the state in which a conversation that began before a block enters it."""
    entered = right.select((F.col("block") + 1).alias("block"), F.lit(True).alias("entered"))
    ask = right.join(entered, "block", "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    exits = stored(_run(thin.select("conv", "pos", "kind", "block").join(ask, "block"), _exits, "block bigint, map array<int>"))
    by = 1
    while True:  # maps that are not constant yet take in those before them
        varies = F.size(F.array_distinct("map")) > 1
        if not exits.filter(varies).limit(1).count():
            break
        before = exits.select((F.col("block") + by).alias("block"), F.col("map").alias("earlier"))
        grown = exits.join(before, "block", "left")
        both = F.transform("earlier", lambda s: F.get(F.col("map"), s))
        new = stored(grown.select("block", F.when(varies & F.col("earlier").isNotNull(), both).otherwise(F.col("map")).alias("map")))
        dropped(exits)
        exits, by = new, 2 * by
    out = stored(exits.select((F.col("block") + 1).alias("block"), F.get("map", F.lit(0)).alias("entry")))
    dropped(exits)
    return out


def edits(rows: DataFrame, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """conv, pos, letters (what happens before, to and after an item) and the state before; written.
    rows: numbered items."""
    thin = stored(rows.select("conv", "pos", "kind", "copies", F.floor(F.col("pos") / block).alias("block")))
    right, known = rights(thin, rounds)
    entry = entries(thin, right)
    conv = thin.schema["conv"].dataType.simpleString()
    ready = thin.join(right, "block", "left").join(entry, "block", "left")
    out = stored(_run(ready, _edits, f"conv {conv}, pos bigint, letters string, state int"))
    dropped(thin, right, known, entry)
    return out


def replay(letters: str, state: int, role: str) -> tuple[list[tuple[str, bool]], int]:
    """(role, whether the text is the row's) of what an item gives, and the state after it."""
    out = []
    for x in letters:
        if x == "D":
            continue
        if x == "K":
            out.append((role, True))
            state = SYSTEM if role[:1] == "s" else _TOLD[state]
        else:
            state = _TOLD[state]
            out.append((_NAMES[state], x == "R"))
    return out, state


def _together(rows: DataFrame, edit: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Items and, right after each, its edit, in order; conversations without rows are told too."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    turn = rows.schema["turn"].dataType.simpleString()
    own = rows.select("conv", "pos", F.lit(0).alias("tag"), "turn", "role", "text", "copies", "fault", none("letters", "string"), none("state", "int"))
    made = edit.select("conv", "pos", F.lit(1).alias("tag"), none("turn", turn), none("role", "string"), none("text", "string"), none("copies", "bigint"), none("fault", "int"), "letters", "state")
    both = own.unionByName(made)
    if conversations is not None:
        both = both.unionByName(conversations.select("conv", F.lit(-1).cast("bigint").alias("pos"), F.lit(0).alias("tag")), allowMissingColumns=True)
    return both.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "pos", "tag")


def _messages(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = None
        for batch in batches:
            out = []
            for row in batch.select(["conv", "pos", "tag", "role", "text", "letters", "state"]).to_pylist():
                if not row["tag"]:
                    item = row
                    continue
                said, _ = replay(row["letters"], row["state"], item["role"])
                out += [(row["conv"], row["pos"], k, role, item["text"] if own else "") for k, (role, own) in enumerate(said)]
            yield _table(out, schema.names, schema)

    return run


def messages(rows: DataFrame, edit: DataFrame) -> DataFrame:
    """The repaired conversations: conv, pos, step, role and text, in order by pos and step."""
    ddl = f"conv {rows.schema['conv'].dataType.simpleString()}, pos bigint, step int, role string, text string"
    return _together(rows, edit).mapInArrow(_messages(_arrow(rows, ddl)), ddl)


class _Report:
    """What is told of one conversation, in constant memory but for the audit itself."""

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.cost, self.audit = conv, [0, 0, 0, 0], 0, 0, []
        self.turns, self.least, self.most, self.turn = 0, None, None, None
        self.initial: str | None = None
        self.sha, self.any = hashlib.sha256(), False
        self.item: dict = {}

    def row(self, item: dict) -> None:
        self.item = item
        turn, initial, more = item["turn"], item["role"][:1], item["copies"] - 1
        if turn is not None and (self.turns == 0 or turn != self.most):
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        self.faults[item["fault"]] += 1
        self.faults[1 if item["fault"] == 1 else 2] += more
        self.illegal += more + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial = initial

    def edit(self, letters: str, state: int) -> None:
        self.audit.append(letters)
        self.cost += DELETE * letters.count("D") + INSERT * letters.count("I") + REROLE * letters.count("R")
        said, _ = replay(letters, state, self.item["role"])
        for role, own in said:
            self.cost += CUT * (own and self.item["fault"] == 3)
            text = self.item["text"] if own else ""
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True

    def told(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _reports(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Report | None = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is None or now.conv != row["conv"]:
                    if now is not None:
                        out.append(now.told())
                    now = _Report(row["conv"])
                if row["tag"]:
                    now.edit(row["letters"], row["state"])
                elif row["pos"] >= 0:
                    now.row(row)
            yield _table(out, schema.names, schema)
        if now is not None:
            yield _table([now.told()], schema.names, schema)

    return run


def reports(rows: DataFrame, edit: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each of `conversations` (conv): gaps, faults, illegal, cost, audit, repaired_sha256.

    The hash and the audit of a conversation are each one value, made in order: a task streams its
    rows, sorted, and keeps none of them."""
    ddl = f"conv {rows.schema['conv'].dataType.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _together(rows, edit, conversations).mapInArrow(_reports(_arrow(rows, ddl)), ddl)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies after damage: crc32("conv_id:turn") % 20 drops a row (0), empties its
    text (1), removes . ! and ? from it (2), repeats it (3, as a number of copies), or sets its role to user (4)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = df.withColumn("_draw", F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20)
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(F.col("_draw") == 4, "user").otherwise(said("role"))
    copies = F.when(F.col("_draw") == 3, 2).otherwise(1)
    return out.filter("_draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, block: int = BLOCK, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(rows, edits): numbered items and what is done to each; messages() and reports() read them."""
    rows = numbered(items(df, conv, turn, role, text, copies))
    return rows, edits(rows, block, rounds)
