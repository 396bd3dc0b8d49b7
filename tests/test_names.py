"""Names over files: both ways of following them, against a plain search."""

import random

import pytest

from larchgraph.operators import names as N

SEP = "\u0001"


def plain(links, files):
    """Where names lead, by walking; links: (path, kind, pos, name, spec, symbol)."""
    there = set(files)
    at = lambda path, spec: next((f for f in (spec[2:], spec[2:] + ".js") if f in there), None)
    point, stars = {}, {}
    for path, kind, _, name, spec, symbol in sorted(links, key=lambda x: x[2]):
        if kind == "star":
            if at(path, spec):
                stars.setdefault(path, []).append(at(path, spec))
            continue
        key = ("L" if kind in ("import", "alias") else "E", path, name)
        if kind in ("import", "reexport"):
            to = at(path, spec)
            if to:
                point.setdefault(key, ("M", to, "") if symbol == "*" else ("E", to, symbol))
        else:
            point.setdefault(key, ("L", path, symbol))

    def on(n):
        if n in point:
            return point[n]
        if n[0] != "E" or n[2] == "default":
            return None
        level, seen = [n[1]], {n[1]}
        while level:
            new = []
            for f in level:
                for g in stars.get(f, ()):
                    if g not in seen:
                        seen.add(g)
                        new.append(g)
            level = new
            for g in level:
                if ("E", g, n[2]) in point:
                    return ("E", g, n[2])
        return None

    out = {}
    for n in point:
        seen, x = {n}, on(n)
        while x is not None and x not in seen:
            seen.add(x)
            nxt = on(x)
            if nxt is None:
                out[SEP.join(n)] = SEP.join(x)
                break
            x = nxt
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_both_ways(spark, seed):
    rng = random.Random(seed)
    files = [f"f{i}.js" for i in range(14)]
    links, pos = [], 0
    for f in files:
        for _ in range(rng.randrange(1, 7)):
            pos += 1
            kind = rng.choice(["import", "import", "export", "reexport", "star", "alias"])
            name, symbol = rng.choice("abcd"), rng.choice(["a", "b", "c", "d", "default", "*"])
            spec = f"./f{rng.randrange(16)}" if kind in ("import", "reexport", "star") else None
            links.append((f, kind, pos, None if kind == "star" else name, spec, None if kind == "star" else symbol if spec else rng.choice("abcd")))
    for i in range(40):  # a chain that rounds have to follow
        links.append((f"g{i}.js", "reexport", 1000 + i, "x", f"./g{i + 1}", "x"))
    files += [f"g{i}.js" for i in range(41)]
    df = spark.createDataFrame([("p", *x) for x in links], "project_id string, path string, kind string, pos int, name string, spec string, symbol string")
    there = spark.createDataFrame([("p", f) for f in files], "project_id string, path string")
    want = plain(links, files)
    for in_task in (N.IN_TASK, 0):
        got = {r["node"]: r["end"] for r in N.ends(df, there, in_task=in_task).collect()}
        # exported names over stars are told too where something asks for them
        assert {k: v for k, v in got.items() if k in want} == want and all(k in want or k.startswith("E") for k in got), in_task
    assert want[SEP.join(("E", "g0.js", "x"))] == SEP.join(("E", "g40.js", "x"))


def test_circles_and_nothing(spark):
    df = spark.createDataFrame([("p", "a.js", "reexport", 1, "x", "./b", "x"), ("p", "b.js", "reexport", 1, "x", "./a", "x"), ("p", "c.js", "import", 1, "x", "./a", "x")], "project_id string, path string, kind string, pos int, name string, spec string, symbol string")
    files = df.select("project_id", "path")
    assert N.ends(df, files).count() == N.ends(df, files, in_task=0).count() == 0
    assert N.ends(df.limit(0), files).count() == 0
