"""Graphs, endpoints and snapshots derived from the given tables, in Spark and in DuckDB SQL.

A node is a user; an edge leads from the user of an event to the user of the next one. `weekly`
graphs have a project for each week; `snapshots` are two graphs, before and after, that see other
events. DuckDB's text of a view stands beside its Spark form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larchgraph.functions.tables import dealt, stored, table


def _nodes(edges: DataFrame, file: Column | None = None) -> DataFrame:
    ends = edges.select("project_id", F.col("src").alias("id")).union(edges.select("project_id", F.col("dst").alias("id"))).distinct()
    k = F.col("id") % 7
    return ends.select(
        "project_id", "id", F.concat(F.lit("user"), "id").alias("name"),
        F.coalesce(file if file is not None else F.lit(None), F.when(k == 0, "tests/f0.test.ts").otherwise(F.concat(F.lit("src/f"), k, F.lit(".ts")))).alias("file"), (F.lit(1) + F.col("id") % 15).cast("int").alias("complexity"),
    )


def _steps(events: DataFrame, project) -> DataFrame:
    """Errors with the user of the project's next event. The next one is looked for inside the hour,
    and for an hour's last event among the hours' first ones, one row each; so no project is sorted
    in one task."""
    order = F.struct("ts", "event_id")
    e = events.select(project.alias("project_id"), F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "user_id", "event_type", "value")
    hours = e.groupBy("project_id", "hour").agg(F.min_by("user_id", order).alias("first"))
    later = hours.select("project_id", "hour", F.lead("first").over(Window.partitionBy("project_id").orderBy("hour")).alias("later"))
    inside = e.withColumn("next", F.lead("user_id").over(Window.partitionBy("project_id", "hour").orderBy("ts", "event_id")))
    steps = inside.join(dealt(later), ["project_id", "hour"]).withColumn("dst", F.coalesce("next", "later")).filter("event_type = 'error' and dst is not null")
    kind = F.when(F.col("dst") == F.col("user_id"), "recursive").when(F.col("value") > 20, "async").otherwise("call")
    return steps.select("project_id", F.col("user_id").alias("src"), "dst", kind.alias("kind"), "ts", "event_id")


def weekly_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(table(spark, sf_dir, "events"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))


def weekly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = stored(weekly_calls(spark, sf_dir).select("project_id", "src", "dst").distinct())
    return _nodes(edges), edges


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two projects, `before` and `after`. A tenth of the users is only in the one, a tenth only in the
    other, a tenth has files of the snapshot's own, and a tenth of the events is missing from each."""
    events = table(spark, sf_dir, "events")
    before = _steps(events.filter("event_id % 10 < 9 and user_id % 10 <> 8"), F.lit("before"))
    after = _steps(events.filter("event_id % 10 > 0 and user_id % 10 <> 7"), F.lit("after"))
    edges = stored(before.unionByName(after).select("project_id", "src", "dst").distinct())
    own = F.when(F.col("id") % 10 == 3, F.concat(F.lit("src/"), "project_id", F.col("id") % 7, F.lit(".ts")))
    return _nodes(edges, own), edges


_NODES = """nodes AS (SELECT project_id, id, 'user' || id AS name, CASE WHEN id % 7 = 0 THEN 'tests/f0.test.ts' ELSE 'src/f' || (id % 7) || '.ts' END AS file,
 CAST(1 + id % 15 AS INT) AS complexity FROM (SELECT project_id, src AS id FROM edges UNION SELECT project_id, dst FROM edges))"""

WEEKLY = f"""steps AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS project_id, user_id AS src, lead(user_id) OVER (PARTITION BY date_trunc('week', ts) ORDER BY ts, event_id) AS dst, event_type, value, ts, event_id FROM events),
calls AS (SELECT project_id, src, dst, CASE WHEN src = dst THEN 'recursive' WHEN value > 20 THEN 'async' ELSE 'call' END AS kind, ts, event_id FROM steps WHERE event_type = 'error' AND dst IS NOT NULL),
edges AS (SELECT DISTINCT project_id, src, dst FROM calls), {_NODES}"""

_SNAP = "SELECT '{p}' AS project_id, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_type FROM events WHERE event_id % 10 {cut} AND user_id % 10 <> {out}"
_SNAP_NODES = _NODES.replace("CASE WHEN id % 7 = 0", "CASE WHEN id % 10 = 3 THEN 'src/' || project_id || (id % 7) || '.ts' WHEN id % 7 = 0")
SNAPSHOTS = f"""edges AS (SELECT DISTINCT project_id, src, dst FROM ({_SNAP.format(p='before', cut='< 9', out=8)} UNION ALL {_SNAP.format(p='after', cut='> 0', out=7)}) WHERE event_type = 'error' AND dst IS NOT NULL), {_SNAP_NODES}"""


def components_sql(edges: str = "edges", prefix: str = "") -> str:
    """Reachability closure, components and nodes in cycles of an edge relation."""
    p = prefix
    return f"""{p}reach AS (SELECT DISTINCT project_id, src, dst FROM {edges} UNION SELECT r.project_id, r.src, e.dst FROM {p}reach r JOIN {edges} e ON e.project_id = r.project_id AND e.src = r.dst),
{p}scc AS (SELECT n.project_id, n.id, coalesce(min(CASE WHEN b.src IS NOT NULL AND r.dst < n.id THEN r.dst END), n.id) AS scc FROM (SELECT project_id, src AS id FROM {edges} UNION SELECT project_id, dst FROM {edges}) n
 LEFT JOIN {p}reach r ON r.project_id = n.project_id AND r.src = n.id LEFT JOIN {p}reach b ON b.project_id = r.project_id AND b.src = r.dst AND b.dst = n.id GROUP BY n.project_id, n.id),
{p}cyc AS (SELECT DISTINCT project_id, src AS id FROM {p}reach WHERE src = dst)"""


def scored_sql(nodes: str = "nodes", edges: str = "edges", prefix: str = "") -> str:
    """Degrees, level and score of a graph, after components_sql of the same prefix."""
    p = prefix
    return f"""{p}deg AS (SELECT n.*, (SELECT count(*) FROM {edges} e WHERE e.project_id = n.project_id AND e.dst = n.id) AS fan_in, (SELECT count(*) FROM {edges} e WHERE e.project_id = n.project_id AND e.src = n.id) AS fan_out,
 EXISTS (SELECT 1 FROM {p}cyc c WHERE c.project_id = n.project_id AND c.id = n.id) AS in_cycle FROM {nodes} n),
{p}scored AS (SELECT *, CASE WHEN in_cycle OR complexity >= 12 THEN 'hot' WHEN complexity >= 10 OR fan_out >= 5 OR fan_in >= 5 THEN 'warn' ELSE 'ok' END AS level,
 CAST(100 * CAST(in_cycle AS INT) + 3 * complexity + fan_in + fan_out AS BIGINT) AS score FROM {p}deg)"""


WEEKLY_SCC = f"{WEEKLY}, {components_sql()}"
WEEKLY_SCORED = f"{WEEKLY_SCC}, {scored_sql()}"
