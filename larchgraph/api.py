"""Analyses of source_files(project_id, path, content), each a DataFrame or a named tuple of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchgraph.extract import facts as X
from larchgraph.extract import http as H
from larchgraph.functions import paths as P
from larchgraph.functions.tables import kept, stored
from larchgraph.operators import files as FI
from larchgraph.operators import graph as G
from larchgraph.operators import impact as I
from larchgraph.operators import policy as PO
from larchgraph.operators import radar as R
from larchgraph.operators import resolve as V


class Analysis(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    facts: DataFrame


class Simulation(NamedTuple):
    outcomes: DataFrame
    broken: DataFrame
    orphaned: DataFrame
    tests: DataFrame
    delta: DataFrame
    summary: DataFrame


class Radar(NamedTuple):
    summary: DataFrame
    clients: DataFrame
    routes: DataFrame
    observations: DataFrame
    matches: DataFrame
    issues: DataFrame
    drift: DataFrame
    covered_by: DataFrame
    unknowns: DataFrame
    gate: DataFrame


def analyze(source_files: DataFrame, reuse: bool = False) -> Analysis:
    """Scored functions and folded, marked edges. reuse: facts of the same files, by their digest, are
    read from the shared folder if an earlier call has left them there."""
    files = H.first_paths(source_files)
    if reuse:
        whole = files.select(F.lit("all").alias("snapshot_id"), F.concat_ws("\u0000", "project_id", "path").alias("path"), "content")
        row = PO.files_digest(whole).first()
        facts = kept(X.extract(files), f"facts-{row['digest'].split(':')[1] if row else 'none'}")
    else:
        facts = stored(X.extract(files))
    nodes, edges = stored(V.functions(facts)), stored(V.edges(V.calls(facts)))
    marked = G.cycle_edges(edges, G.scc(edges))
    return Analysis(G.scored(nodes, edges), edges.join(marked, G.PAIR), facts)


def hotspots(a: Analysis, n: int = 20) -> DataFrame:
    return G.hotspots(a.nodes, n).select("project_id", "id", "name", "file", "line", "level", "complexity", "fan_in", "fan_out", "in_cycle", F.transform("issues", lambda x: x["code"]).alias("issues"), "score")


def get_function(a: Analysis, project_id: str, fid: str, known: int = 50) -> DataFrame:
    """role and other of one function: itself, its callers and callees. For an unknown id, the first
    ids that there are, with the role `known`."""
    mine = a.nodes.filter(F.col("project_id") == project_id)
    me = stored(mine.filter(F.col("id") == fid).select("project_id", "id"))
    row = lambda df, role: df.select("project_id", F.lit(fid).alias("id"), F.lit(role).alias("role"), F.col("id").alias("other"))
    if not me.limit(1).count():
        return row(mine.select("project_id", "id").orderBy("id").limit(known), "known")
    return row(me, "self").unionByName(G.neighbours(a.edges, me))


def trace(a: Analysis, starts: DataFrame, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes with their depth, edges walked) from starts(project_id, id)."""
    reached = G.trace(a.edges, starts, depth)
    return reached, G.trace_edges(a.edges, reached, depth)


def _file_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, specs) of the script files in facts."""
    f = facts.filter(F.col("path").rlike(P.SCRIPT_NAME) & ~F.col("path").rlike(P.DECLARATION))
    files = f.filter("fact = 'file'").select("project_id", "path", "exports", "shebang", "parse_error", "loc")
    return files, f.filter("fact = 'import'").select("project_id", "path", F.col("name").alias("spec")).distinct()


def import_health(source_files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    files, specs = _file_facts(facts if facts is not None else stored(X.extract(H.first_paths(source_files))))
    return FI.health(files, *FI.resolve(specs, files))


def file_graph(source_files: DataFrame, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary)."""
    files, specs = _file_facts(facts if facts is not None else stored(X.extract(H.first_paths(source_files))))
    found, lost = (stored(df) for df in FI.resolve(specs, files))
    nodes, edges = (stored(df) for df in FI.file_graph(files, found))
    return nodes, edges, FI.graph_summary(nodes, edges, found, lost)


def simulate(a: Analysis, changes: DataFrame) -> Simulation:
    """What changes(change_id, project_id, kind, target) break."""
    nodes = a.nodes.select("project_id", "id", "name", "file", "complexity")
    gone = stored(I.removed(changes, nodes))
    found, broken, orphaned = I.outcomes(changes, gone), stored(I.broken_callers(gone, nodes, a.edges)), stored(I.newly_orphaned(gone, nodes, a.edges))
    tests, delta = I.affected_tests(broken), stored(I.metric_delta(gone, nodes, a.edges))
    return Simulation(found, I.by_loss(broken), orphaned, tests, delta, I.summary_lines(found, broken, orphaned, tests, delta))


def snapshot_facts(source_files: DataFrame) -> DataFrame:
    """facts(snapshot_id, kind, key) of two snapshots whose project_id is `before` or `after`. Scripts
    are analysed; other files are only there."""
    files = H.first_paths(source_files)
    code = files.filter(F.col("path").rlike(P.SCRIPT_NAME) & ~F.col("path").rlike(P.DECLARATION))
    a = analyze(code)
    known, specs = _file_facts(a.facts)
    found, lost = FI.resolve(specs, known)
    nodes, _ = FI.file_graph(known, found)
    one = lambda df, kind, key: df.select(F.col("project_id").alias("snapshot_id"), F.lit(kind).alias("kind"), key.alias("key"))
    out = one(a.nodes, "function", F.col("id"))
    for part in (
        one(a.nodes.filter("in_cycle"), "cycle-function", F.col("id")), one(a.nodes.filter("level <> 'ok'"), "hotspot", F.col("id")), one(files, "file", F.col("path")), one(code, "script", F.col("path")),
        one(nodes.filter("in_cycle"), "cycle-file", F.col("path")), one(lost, "unresolved", F.concat_ws(" -> ", "path", "spec")), one(known.filter("parse_error"), "parse-error", F.col("path")),
    ):
        out = out.unionByName(part)
    return out.distinct()


def verify_change(source_files: DataFrame, policy: PO.Policy, allow_unknown: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(checks, overall, gate, fingerprint) of two snapshots whose project_id is `before` or `after`. An
    empty path, or one that a snapshot has twice, is a ValueError."""
    files = PO.canonical(source_files.select(F.col("project_id").alias("snapshot_id"), "path", "content"))
    checked = stored(PO.checks(snapshot_facts(source_files), policy))
    return checked, PO.overall(checked), PO.change_gate(checked, allow_unknown), PO.fingerprint(files, policy)


def contract_radar(source_files: DataFrame, allow_unknown: bool = False) -> Radar:
    rows = H.parsed(source_files)
    projects = source_files.select("project_id").distinct()
    clients, routes, seen = stored(H.clients(rows)), stored(H.routes(rows)), stored(H.observations(rows))
    empty = projects.join(rows.select("project_id").distinct(), "project_id", "left_anti")
    no = empty.select("project_id", F.lit("server").alias("side"), F.lit("").alias("file"), F.lit(1).alias("line"), F.lit("").alias("expression"), F.lit("no-script-files").alias("reason"))
    unknown = stored(H.unknowns(rows).unionByName(no))
    matches = stored(R.matches(clients, routes))
    drift, covered = stored(R.drift(clients, routes, matches)), stored(R.coverage(routes, seen))
    issues = stored(R.status_issues(clients, routes, matches).unionByName(R.drift_issues(drift)).unionByName(R.untested(covered)))
    counts = R.summary(projects, clients, routes, matches, issues, covered, unknown)
    gate = R.radar_gate(issues, unknown.agg(F.count("*").alias("unknowns")), allow_unknown)
    return Radar(counts, R.endpoint_order(clients), R.endpoint_order(routes), seen, R.match_order(matches), R.issue_order(issues), drift, R.covered_by(routes, seen), R.unknown_order(unknown), gate)


def as_json(df: DataFrame) -> DataFrame:
    """One column, `value`: each row as a JSON object; for write.text or a report."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
