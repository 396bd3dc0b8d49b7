"""Conversation repair against a plain search over all edits, in blocks of few rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from larchgraph.llm import conversation_repair as cr
from larchgraph.llm import queries

SPACES = " \t\n\x0b\f\r"
INF = 10**9


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        if not body:
            out.append(1)
        elif (role, text) in seen:
            out.append(2)
        else:
            out.append(0 if body[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def best(rows, faults):
    """(cost, letters, repaired roles and texts) by trying every edit from every place."""
    n = len(rows)
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def rest(i, s, inserted):
        options = [(0, "", ())] if i == n and s in ("", "a") else []
        if inserted < 3:
            t = follow[s]
            c, w, m = rest(i, t, inserted + 1)
            options.append((c + 2, "I" + w, (({"u": "user", "a": "assistant"}[t], ""), *m)))
        if i < n:
            _, role, text = rows[i]
            cut = faults[i] == 3
            c, w, m = rest(i + 1, s, 0)
            options.append((c + 3, "D" + w, m))
            if faults[i] not in (1, 2):
                first = role[:1]
                if first == follow[s] or (first == "s" and s == ""):
                    c, w, m = rest(i + 1, first, 0)
                    options.append((c + cut, "K" + w, ((role, text), *m)))
                t = follow[s]
                c, w, m = rest(i + 1, t, 0)
                options.append((c + 2 + cut, "R" + w, (({"u": "user", "a": "assistant"}[t], text), *m)))
        return min(options) if options else (INF, "", ())

    return rest(0, "", 0)


def plain(rows):
    """A report of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = faults_of(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = best(tuple(rows), tuple(faults))
    body = "\n".join(f"{r}:{t}" for r, t in said)
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()), said


def conversations():
    rng = random.Random(13)
    out = {}
    for c in range(120):
        n = rng.choice([1, 2, 3, 5, 8, 13, 30])
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user"], ["", "tool", None, "user"], ["x"], ["system"]])
        texts = [f"line {rng.randrange(n)}{rng.choice(['.', '!', ' ?\n', '', ''])}" if rng.random() < 0.85 else rng.choice([None, "", " \t", "a\x1c", "é"]) for _ in range(n)]
        out[c] = [(rng.choice([None, t, t, t, t + 3]), rng.choice(roles), x) for t, x in enumerate(texts)]
    out[500] = [(t, "x", f"t{t}.") for t in range(61)]  # vectors that stay apart
    out[501] = [(t, "x", "t.") for t in range(40)]  # duplicates without end
    out[502] = [(t, ("user", "assistant")[t % 2], f"t{t}") for t in range(50)]
    out[503] = [(7, "user", "same.")] * 25 + [(8, "assistant", "yes.")] * 9
    out[504] = [(t, "system", f"s{t}.") for t in range(45)]
    out[None] = [(1, "user", "a."), (4, "assistant", "b.")]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(c, t, r, x, "own", "mine") for c, turns in conversations().items() for t, r, x in turns]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, kind string, pos string").repartition(3)


@pytest.mark.parametrize("block,rounds", [(1024, 4), (5, 50), (4, 1), (3, 0)])
def test_repair_against_a_plain_search(spark, table, block, rounds):
    rows, edits = cr.repair(table, block=block, rounds=rounds)
    got = {r["conv"]: tuple(r)[1:] for r in cr.reports(rows, edits, table.select(F.col("conv_id").alias("conv")).distinct()).collect()}
    said = {}
    for r in cr.messages(rows, edits).orderBy("pos", "step").collect():
        said.setdefault(r["conv"], []).append((r["role"], r["text"]))
    want = conversations()
    assert set(got) == set(want)
    for c, turns in want.items():
        report, repaired = plain(turns)
        assert got[c] == report, c
        assert said.get(c, []) == list(repaired)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said.get(c, [])))


def test_vectors_converge_or_stay_apart():
    """Blocks of mixed rows meet whatever they started from; rows of one unusable role never do."""
    rng = random.Random(2)
    mixed = [[rng.choice([0, 1, 2, 1, 2, 5, 6, cr.FORCED, 3]) for _ in range(64)] for _ in range(200)]
    assert all(cr._back(k, cr.ZERO) == cr._back(k, cr.END) for k in mixed)
    assert cr._back([3] * 400, cr.ZERO) != cr._back([3] * 400, cr.END)
    assert len({v for v, _ in cr._steps.values()}) < 50


def test_empty_table(spark, table):
    none = table.limit(0)
    rows, edits = cr.repair(none)
    assert cr.reports(rows, edits, none.select(F.col("conv_id").alias("conv")).distinct()).count() == 0


def test_query_against_a_plain_damage(spark, tmp_path):
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["Hello there.", "What?! is", None, "ok"]) ) for c in range(40) for t in range(rng.randrange(1, 9))]
    turns += [(None, None, "user", "x."), (77, None, None, None)]
    turns += [(c, 0, "user", "gone.") for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = {}
    for c, t, role, text in turns:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if text is None else text
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else " " if role is None else role
        hurt.setdefault(c, []).extend([(t, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1))
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: plain(rows)[0] for c, rows in hurt.items()}
    assert any(not rows for rows in hurt.values())
