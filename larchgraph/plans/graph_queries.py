"""Graph queries over the weekly hand-over graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from larchgraph.functions.tables import stored
from larchgraph.operators import graph as G
from larchgraph.plans import views as V

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {V.WEEKLY} SELECT project_id, id, (SELECT count(*) FROM edges e WHERE e.project_id = n.project_id AND e.dst = n.id) AS fan_in, (SELECT count(*) FROM edges e WHERE e.project_id = n.project_id AND e.src = n.id) AS fan_out FROM nodes n")
def degrees(spark, d):
    return G.degrees(*V.weekly(spark, d)).select("project_id", "id", "fan_in", "fan_out")


@query(f"WITH {V.WEEKLY} SELECT project_id, src, dst, count(*) AS cnt, arg_min(kind, event_id) AS kind FROM calls GROUP BY ALL")
def edge_fold(spark, d):
    return G.fold_edges(V.weekly_calls(spark, d), ["event_id"])


@query(f"WITH RECURSIVE {V.WEEKLY_SCC} SELECT project_id, id, scc FROM scc")
def scc(spark, d):
    return G.scc(V.weekly(spark, d)[1])


@query(f"WITH RECURSIVE {V.WEEKLY_SCC} SELECT project_id, id, scc FROM scc")
def scc_distributed(spark, d):
    return G.scc(V.weekly(spark, d)[1], in_task=0)


@query(f"WITH RECURSIVE {V.WEEKLY_SCC} SELECT e.project_id, e.src, e.dst, a.scc = b.scc AS cycle FROM edges e JOIN scc a ON a.project_id = e.project_id AND a.id = e.src JOIN scc b ON b.project_id = e.project_id AND b.id = e.dst")
def cycle_edges(spark, d):
    e = V.weekly(spark, d)[1]
    return G.cycle_edges(e, G.scc(e))


@query(f"WITH RECURSIVE {V.WEEKLY_SCC} SELECT project_id, count(*) AS cycles FROM (SELECT project_id, scc FROM scc GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT project_id, src FROM edges WHERE src = dst) GROUP BY ALL")
def cycle_count(spark, d):
    e = V.weekly(spark, d)[1]
    return G.cycle_count(e, G.scc(e))


_COLS = "project_id, id, file, complexity, fan_in, fan_out, in_cycle, level, score"


@query(f"WITH RECURSIVE {V.WEEKLY_SCORED} SELECT {_COLS} FROM scored")
def levels(spark, d):
    return G.scored(*V.weekly(spark, d)).select(*_COLS.split(", "))


@query(f"""WITH RECURSIVE {V.WEEKLY_SCORED} SELECT project_id, id, 'cycle' AS code, NULL::INT AS value FROM scored WHERE in_cycle UNION ALL SELECT project_id, id, 'complexity', complexity FROM scored WHERE complexity >= 10
 UNION ALL SELECT project_id, id, 'fanOut', fan_out::INT FROM scored WHERE fan_out >= 5 UNION ALL SELECT project_id, id, 'fanIn', fan_in::INT FROM scored WHERE fan_in >= 5""")
def issues_flat(spark, d):
    return G.scored(*V.weekly(spark, d)).select("project_id", "id", F.inline("issues"))


@query(f"WITH RECURSIVE {V.WEEKLY_SCORED} SELECT {_COLS} FROM scored WHERE level <> 'ok' ORDER BY score DESC, project_id, id LIMIT 20")
def hotspots_topn(spark, d):
    return G.hotspots(G.scored(*V.weekly(spark, d))).select(*_COLS.split(", "))


@query(f"WITH RECURSIVE {V.WEEKLY_SCORED} SELECT project_id, count(*) AS functions, count(*) FILTER (level = 'hot') AS hot, count(*) FILTER (level = 'warn') AS warn, count(*) FILTER (in_cycle) AS in_cycle, (SELECT count(*) FROM edges e WHERE e.project_id = s.project_id) AS calls FROM scored s GROUP BY ALL")
def overview(spark, d):
    nodes, edges = V.weekly(spark, d)
    return G.overview(G.scored(nodes, edges), edges)


@query(f"WITH {V.WEEKLY}, w AS (SELECT project_id, id FROM nodes WHERE file = 'src/f1.ts') SELECT e.project_id, src AS id, 'callee' AS role, dst AS other FROM edges e JOIN w ON w.project_id = e.project_id AND w.id = e.src UNION ALL SELECT e.project_id, dst, 'caller', src FROM edges e JOIN w ON w.project_id = e.project_id AND w.id = e.dst")
def neighbours(spark, d):
    nodes, edges = V.weekly(spark, d)
    return G.neighbours(edges, nodes.filter("file = 'src/f1.ts'"))


_START = "starts AS (SELECT project_id, min(src) AS id FROM edges GROUP BY ALL)"


def _starts(edges):
    return edges.groupBy("project_id").agg(F.min("src").alias("id"))


@query(f"WITH RECURSIVE {V.WEEKLY}, {_START}, walk AS (SELECT project_id, id AS start, id, 0 AS depth FROM starts UNION SELECT w.project_id, w.start, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.project_id = w.project_id AND e.src = w.id WHERE w.depth < 4) SELECT project_id, start, id, min(depth) AS depth FROM walk GROUP BY ALL")
def trace_bfs(spark, d):
    edges = V.weekly(spark, d)[1]
    return G.trace(edges, _starts(edges), 4)


_WALK = """adj AS (SELECT DISTINCT project_id, src, dst FROM edges), near AS (SELECT project_id, id AS start, id, 0 AS depth FROM starts UNION SELECT w.project_id, w.start, e.dst, w.depth + 1 FROM near w JOIN adj e ON e.project_id = w.project_id AND e.src = w.id WHERE w.depth < 4)"""


@query(f"WITH RECURSIVE {V.WEEKLY}, {_START}, {_WALK} SELECT DISTINCT n.project_id, n.start, e.src, e.dst FROM (SELECT project_id, start, id, min(depth) AS depth FROM near GROUP BY ALL) n JOIN adj e ON e.project_id = n.project_id AND e.src = n.id WHERE n.depth < 4")
def trace_edges(spark, d):
    edges = V.weekly(spark, d)[1]
    return G.trace_edges(edges, G.trace(edges, _starts(edges), 4), 4)


@query()
def trace_dfs(spark, d):
    edges = V.weekly(spark, d)[1]
    return G.trace_order(edges, _starts(edges), 4)


_LAYERS = f"""{V.WEEKLY_SCORED}, dag AS (SELECT e.* FROM edges e JOIN scc a ON a.project_id = e.project_id AND a.id = e.src JOIN scc b ON b.project_id = e.project_id AND b.id = e.dst WHERE a.scc <> b.scc),
 lay AS (SELECT project_id, id, 0 AS layer FROM nodes UNION SELECT l.project_id, g.dst, l.layer + 1 FROM lay l JOIN dag g ON g.project_id = l.project_id AND g.src = l.id), layers AS (SELECT project_id, id, max(layer) AS layer FROM lay GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_LAYERS} SELECT project_id, id, layer FROM layers")
def layers(spark, d):
    nodes, edges = V.weekly(spark, d)
    return G.layers(nodes, G.cycle_edges(edges, G.scc(edges)))


@query(f"WITH RECURSIVE {_LAYERS} SELECT project_id, id, layer, CAST(130 + 230 * layer AS INT) AS x, CAST(78 + 86 * (row_number() OVER (PARTITION BY project_id, layer ORDER BY score DESC, id) - 1) AS INT) AS y FROM scored JOIN layers USING (project_id, id)")
def layered_layout(spark, d):
    nodes, edges = V.weekly(spark, d)
    comp = stored(G.scc(edges))
    layer = G.layers(nodes, G.cycle_edges(edges, comp))
    return G.layout(G.scored(nodes, edges, comp=comp), layer).select("project_id", "id", "layer", F.col("x").cast("int"), F.col("y").cast("int"))


@query(f"WITH RECURSIVE {V.WEEKLY_SCORED} SELECT project_id, id, level FROM scored WHERE contains(lower(name || ' ' || file), 'f3.ts') AND level <> 'ok'")
def search_nodes(spark, d):
    return G.search(G.scored(*V.weekly(spark, d)), "F3.ts", only_issues=True).select("project_id", "id", "level")


@query(f"WITH {V.WEEKLY}, v AS (SELECT project_id, id FROM nodes WHERE file <> 'tests/f0.test.ts') SELECT e.* FROM edges e JOIN v a ON a.project_id = e.project_id AND a.id = e.src JOIN v b ON b.project_id = e.project_id AND b.id = e.dst")
def induced_edges(spark, d):
    nodes, edges = V.weekly(spark, d)
    return G.induced(edges, nodes.filter("file <> 'tests/f0.test.ts'"))


_TWO = f"{V.SNAPSHOTS}, {V.components_sql()}, {V.scored_sql()}"


@query(f"""WITH RECURSIVE {_TWO} SELECT n.id, b.id IS NULL AS is_new, CAST(n.complexity - b.complexity AS BIGINT) AS d_complexity, n.score - b.score AS d_score, b.level AS old_level, n.level AS level
 FROM scored n LEFT JOIN scored b ON b.project_id = 'before' AND b.id = n.id WHERE n.project_id = 'after'""")
def baseline_delta(spark, d):
    s = G.scored(*V.snapshots(spark, d)).drop("issues")
    before = s.filter("project_id = 'before'").withColumn("project_id", F.lit("p"))
    return G.baseline_delta(before, s.filter("project_id = 'after'").withColumn("project_id", F.lit("p"))).drop("project_id")


@query(f"WITH {V.WEEKLY} SELECT project_id, id, file <> 'src/f1.ts' AS dimmed FROM nodes")
def dimmed_nodes(spark, d):
    return G.dimmed(V.weekly(spark, d)[0], "src/f1.ts").select("project_id", "id", "dimmed")


@query(f"WITH {V.WEEKLY} SELECT e.project_id, e.src, e.dst, NOT (a.file = 'src/f1.ts' AND b.file = 'src/f1.ts') AS dimmed FROM edges e JOIN nodes a ON a.project_id = e.project_id AND a.id = e.src JOIN nodes b ON b.project_id = e.project_id AND b.id = e.dst")
def dimmed_edges(spark, d):
    nodes, edges = V.weekly(spark, d)
    return G.dimmed_edges(edges, G.dimmed(nodes, "src/f1.ts"))


@query(f"WITH {V.WEEKLY} SELECT project_id, file, CAST((row_number() OVER (PARTITION BY project_id ORDER BY file) - 1) % 4 AS INT) AS colour FROM (SELECT DISTINCT project_id, file FROM nodes)")
def file_colours(spark, d):
    return G.file_colours(V.weekly(spark, d)[0], 4)


@query(f"WITH RECURSIVE {V.WEEKLY_SCORED} SELECT project_id, count(*) FILTER (level = 'hot') AS hot, count(*) FILTER (level = 'warn') AS warn, bool_or(in_cycle) AS any_cycle FROM scored GROUP BY ALL")
def panel(spark, d):
    return G.panel(G.scored(*V.weekly(spark, d)))
