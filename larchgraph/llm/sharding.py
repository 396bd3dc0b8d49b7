"""Operator 3: sharding by a hierarchical weighted hash tree (built-in functions only).

A tree has regions, racks and shards; every shard has a place with `room`, and a weight. A key
descends by weighted hash draws:

1. Each region draws an exponential time, -ln(u) / room, where a region's room is that of its
   places: the first arrival at the region. The earliest one wins.
2. In that region, and nowhere else, racks draw by their rooms, then the places of the winning
   rack by theirs. (Which part an arrival falls into is independent of its time.)
3. The place takes the key with chance weight / room. If it does not, the region's next arrival
   is the first one's time plus the earliest draw among its shards, each by its own weight; and
   weight beyond a place's room draws for itself.

An arrival at a full region, whose weights are its rooms, is never refused: one draw for each
region, then one for each rack and each place on the way down. As all later arrivals are drawn
given the earlier ones, a shard's share is its weight's, whatever the rooms. Draws depend on rooms
and on the shard's own weight alone, so a change of weights moves keys only into or out of the
shards whose weights change, and one more shard takes keys only into itself: its place waits in the
layout with weight 0.

Law of `shards`: `key`: doc_id and the tree decide; equal keys always share a shard. A null key
counts as the empty string. Repeated rows keep their own slots; an empty table stays empty. Extra
columns pass through, whatever their names; only shard and grown_shard are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larchgraph.llm.common import fresh

#: What a draw is for; hashed together with the key and the subtree's number.
REGION, RACK, PLACE, ACCEPT, AGAIN, BEYOND = range(6)
#: Rows that one task numbers, and the fewest parts of a group.
PART_ROWS, PARTS = 100_000, 64


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    room: float = 1.0


def layout(n: int, per_rack: int = 5, per_region: int = 2) -> list[Shard]:
    """n equal shards, per_rack to a rack, per_region racks to a region; more shards only append.
    The last region's places that wait for a shard have weight 0."""
    per = per_rack * per_region
    return [Shard(i // per, i // per_rack, i, float(i < n)) for i in range(-(-n // per) * per)]


def _uniform(key: Column, use: int, number: Column) -> Column:
    """53 bits of a hash as a number in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(use), number), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def _time(key: Column, use: int, number: int, rate: float) -> Column:
    return -F.log(_uniform(key, use, F.lit(number))) / F.lit(float(rate))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written and computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first(draws: list[tuple[Column, Column]]) -> Column:
    """The outcome of the earliest (time, outcome) pair; alone, without a look at its time."""
    if len(draws) == 1:
        return draws[0][1]
    at = F.array(*[t for t, _ in draws])
    return F.element_at(F.array(*[o for _, o in draws]), F.array_position(at, F.array_min(at)).cast("int"))


def _descend(key: Column, racks: dict[int, list[Shard]]) -> Column:
    """The place inside a region where its first arrival falls."""
    place = lambda own: _choice([(_time(key, PLACE, s.shard, s.room), s.shard) for s in own])
    out = None
    winner = _choice([(_time(key, RACK, k, sum(s.room for s in own)), k) for k, own in racks.items()])
    for k, own in racks.items():  # only the winning rack's places draw
        out = F.when(winner == k, place(own)) if out is None else out.when(winner == k, place(own))
    return out


def _choice(draws: list[tuple[Column, int]]) -> Column:
    return _first([(t, F.lit(number)) for t, number in draws])


def _region(key: Column, time: Column, racks: dict[int, list[Shard]]) -> Column:
    """struct(t, shard): a region's first accepted arrival; shard is null where the descent is still
    to be made, since every place accepts."""
    own = [s for shards in racks.values() for s in shards]
    none = F.lit(None).cast("int")
    if all(s.weight >= s.room for s in own):
        first = F.struct(time.alias("t"), none.alias("shard"))
    else:
        share = F.create_map(*[F.lit(x) for s in own for x in (s.shard, min(1.0, s.weight / s.room))])
        again = F.array_min(F.array(*[F.struct((time + _time(key, AGAIN, s.shard, min(s.weight, s.room))).alias("t"), F.lit(s.shard).alias("shard")) for s in own if s.weight > 0]))
        met = lambda p: F.when(_uniform(key, ACCEPT, p) < F.element_at(share, p), F.struct(time.alias("t"), p.alias("shard"))).otherwise(again)
        first = _let(_descend(key, racks), met)
    beyond = [F.struct(_time(key, BEYOND, s.shard, s.weight - s.room).alias("t"), F.lit(s.shard).alias("shard")) for s in own if s.weight > s.room]
    return F.array_min(F.array(first, *beyond)) if beyond else first


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key."""
    regions: dict[int, dict[int, list[Shard]]] = {}
    for s in tree:
        if s.weight < 0 or s.room <= 0:
            raise ValueError("weights are 0 or more, rooms are more than 0")
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    regions = {r: racks for r, racks in regions.items() if any(s.weight > 0 for own in racks.values() for s in own)}
    if not regions:
        raise ValueError("the tree has no shard of positive weight")
    room = lambda racks: sum(s.room for own in racks.values() for s in own)
    drawn = {r: _region(key, _time(key, REGION, r, room(racks)), racks) for r, racks in regions.items()}
    # the winner is bound once, so that no descent is written for it twice
    best = F.array_min(F.array(*[F.struct(x["t"].alias("t"), F.lit(r).alias("region"), x["shard"].alias("shard")) for r, x in drawn.items()]))

    def down(won: Column) -> Column:
        out = F.when(won["shard"].isNotNull(), won["shard"])
        for r, racks in regions.items():
            if all(s.weight >= s.room for own in racks.values() for s in own):
                out = out.when(won["region"] == r, _descend(key, racks))
        return out

    return _let(best, down).cast("int")


def sizes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long")


def numbered(df: DataFrame, by: str, order: list[str], out: str, rows: int = 0) -> DataFrame:
    """Gapless numbers from 0 within `by`, without one task for a whole group.

    A group's rows are dealt into parts by a hash of the order columns and numbered there; each
    part starts where the counts of those before it end. rows: about how many df has; the parts
    grow with them. Rows equal in all order columns are interchangeable and share a part."""
    part, before, row, own, at = fresh(df, "part", "before", "row", "own_by", "own_part")
    parts = max(PARTS, -(-rows // PART_ROWS))
    df = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = df.groupBy(by, part).agg(F.count("*").alias("n"))
    sofar = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias(own), F.col(part).alias(at), F.coalesce(F.sum("n").over(sofar), F.lit(0)).alias(before))
    placed = df.withColumn(row, F.row_number().over(Window.partitionBy(by, part).orderBy(*order)))
    # both sides stand by (by, part) already: the counts are merged in, or broadcast where they are small
    placed = placed.join(starts, F.col(by).eqNullSafe(F.col(own)) & (F.col(part) == F.col(at)))
    placed = placed.withColumn(out, (F.col(before) + F.col(row) - 1).cast("long"))
    return placed.drop(own, at, part, before, row)


def shards(df: DataFrame, key: str, tree: list[Shard], grown: list[Shard] | None = None) -> DataFrame:
    """df with shard and, for a grown tree, grown_shard."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found = {"shard": place(k, tree)} | ({"grown_shard": place(k, grown)} if grown else {})
    return df.withColumns(found)
