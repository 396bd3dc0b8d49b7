"""Near-duplicate embeddings against all pairs."""

import numpy as np
import pytest

from larchgraph.llm import embedding_dedup as ed


def all_pairs(rows, cosine):
    """(n_links, component) of each row's id, from all pairs; rows: id, vector, label."""
    def usable(r):
        return None not in (r[0], r[1], r[2]) and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    good = [r for r in rows if usable(r)]
    links, low = {}, {r[0]: r[0] for r in rows}
    x = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float) / np.abs(r[1]).max()) / np.abs(r[1]).max() for r in good]
    pairs = [(i, j) for i in range(len(good)) for j in range(i) if good[i][2] == good[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine]
    for i, j in pairs:
        links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
    moved = True
    while moved:
        moved = False
        for i, j in pairs:
            m = min(low[good[i][0]], low[good[j][0]])
            moved |= low[good[i][0]] != m or low[good[j][0]] != m
            low[good[i][0]] = low[good[j][0]] = m
    return sorted([(r[0], links.get(i, 0), low[r[0]]) for i, r in enumerate(good)] + [(r[0], 0, r[0]) for r in rows if not usable(r)], key=repr)


def crowd(rng, n, dim, noise, centers):
    """Vectors around a few directions, at many angles."""
    c = rng.normal(size=(centers, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, centers, n)] + rng.normal(size=(n, dim)) * noise * rng.random((n, 1)) / np.sqrt(dim)
    return (x * rng.uniform(0.1, 9, (n, 1))).astype(np.float32)


SCHEMA = "vec_id bigint, embedding array<float>, label int, own string, code string, w int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("dim,noise,centers,cosine,block", [(64, 0.5, 12, 0.93, 4096), (64, 0.8, 3, 0.93, 16), (6, 0.6, 20, 0.93, 40), (2, 1.0, 9, 0.93, 4096), (16, 1.5, 5, 0.4, 50)])
def test_against_all_pairs(spark, monkeypatch, dim, noise, centers, cosine, block):
    monkeypatch.setattr(ed, "QUERIES", 2 * block)
    monkeypatch.setattr(ed, "MEMBERS", block)
    rng = np.random.default_rng(dim + centers)
    x = crowd(rng, 700, dim, noise, centers)
    rows = [(int(i), v.tolist(), int(rng.integers(0, 3))) for i, v in zip(rng.permutation(700), x, strict=True)]
    rows += [(1000 + i, rows[i % 5][1], rows[i % 5][2]) for i in range(30)]  # exact copies
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in ed.near_duplicates(table(spark, rows), cosine=cosine).collect()), key=repr)
    want = all_pairs(rows, cosine)
    assert got == want
    assert sum(r[1] for r in want) > 100 and len({r[2] for r in want}) >= 3


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [3.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1),
        (14, [1.0, -0.0], 1), (15, [1e-38, 0.0], 1), (16, [3e38, 1e30], 1),
    ]
    got = ed.near_duplicates(table(spark, [*rows, (None, [1.0, 0.0], 1)])).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == sorted([*all_pairs(rows, 0.93), (None, 0, None)], key=repr)
    assert {r["vec_id"] for r in got if not r["kept"]} == {2, 14, 15, 16, 12}
    assert ed.near_duplicates(table(spark, [])).count() == 0
    assert [tuple(r) for r in ed.near_duplicates(table(spark, [(7, None, None)])).collect()] == [(7, 0, 7, True)]
    twice = ed.near_duplicates(table(spark, [(5, [1.0, 2.0], 0)] * 3)).collect()
    assert [tuple(r) for r in twice] == [(5, 2, 5, True)] * 3


def test_a_crowd_of_near_copies_is_counted_without_pairs():
    """All of a tight crowd is linked by the list's core; nothing of it is compared."""
    rng = np.random.default_rng(5)
    x = np.concatenate([ed.unit(rng.normal(size=(1, 64)) + rng.normal(size=(3000, 64)) * 0.02), ed.unit(rng.normal(size=(500, 64)))])
    index = ed.Index(x, 8, 0.93)
    own, core, _, cores = index.place(x)
    crowd = slice(0, 3000)
    assert core[crowd].all()
    assert (cores[crowd][np.arange(3000), own[crowd]] == 2).all()


def test_probes_and_lookups_lose_no_link():
    """For every linked pair one of both probes the other's list, and the lookup keeps the pair."""
    rng = np.random.default_rng(6)
    x = ed.unit(rng.normal(size=(400, 24)))
    step = rng.normal(size=x.shape)
    step -= (step * x).sum(1, keepdims=True) * x
    y = x * 0.931 + ed.unit(step) * np.sqrt(1 - 0.931**2)
    index = ed.Index(np.concatenate([x, y])[::3], 40, 0.93)
    (a, ca, rim_a, core_a), (b, cb, rim_b, core_b) = index.place(x), index.place(y)
    i = np.arange(len(x))
    reach_a = np.where(cb, core_a[i, b] > 0, rim_a[i, b])
    reach_b = np.where(ca, core_b[i, a] > 0, rim_b[i, a])
    assert (a != b).sum() > 50 and (reach_a | reach_b).all()
    codes, error = index.encode(y, b)
    for k in i:
        assert index.near(x[k : k + 1], int(b[k]), codes[k : k + 1], error[k : k + 1])[0, 0]
    far = index.near(x, int(b[0]), codes[b == b[0]], error[b == b[0]])
    assert far.mean() < 0.5
