"""File, contract, policy and join queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larchgraph.functions import paths as P
from larchgraph.functions.tables import dealt, table
from larchgraph.operators import files as FI
from larchgraph.operators import hash_tree as HT
from larchgraph.operators import graph as G
from larchgraph.operators import impact as I
from larchgraph.operators import joins as J
from larchgraph.operators import policy as PO
from larchgraph.operators import quantiles as QU
from larchgraph.operators import radar as R
from larchgraph.plans import views as V
from larchgraph.sources import corpus as S

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pages as files and imports -------------------------------------------------------------

_HTTP = """CASE WHEN b = '/' THEN b ELSE regexp_replace(b, '/$', '') END"""
_PATHS = """paths AS (SELECT page_id, url, html, CASE WHEN b = '/' THEN b ELSE regexp_replace(b, '/$', '') END AS path FROM (SELECT *, regexp_replace('/' || replace(CASE WHEN regexp_matches(trim(url), '(?i)^https?://') THEN regexp_extract(trim(url), '(?i)^https?://[^/?#]*([^?#]*)', 1) ELSE regexp_extract(trim(url), '^[^?#]*', 0) END, '\\', '/'), '/+', '/', 'g') AS b FROM pages))"""
_FILES = f"""{_PATHS}, pf AS (SELECT page_id, path AS web, CASE WHEN page_id % 11 = 0 THEN 'bin' ELSE 'src' END || path || CASE page_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' WHEN 3 THEN '.js' ELSE '.test.ts' END AS path FROM paths),
files AS (SELECT 'p' AS project_id, path, CAST(min(page_id) % 4 AS INT) AS exports, min(page_id) % 37 = 0 AS shebang, min(page_id) % 41 = 0 AS parse_error FROM pf GROUP BY path),
specs AS (SELECT DISTINCT 'p' AS project_id, a.path, '..' || b.web || CASE WHEN b.page_id % 9 = 0 THEN '.css' ELSE '' END AS spec FROM pf a JOIN pf b ON b.page_id IN (a.page_id + 1, a.page_id + 3, a.page_id - a.page_id % 10)),
bases AS (SELECT *, list_reduce(list_concat([''], string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), string_split(spec, '/')), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END) AS base FROM specs),
tried AS (SELECT project_id, path, spec, base || s AS target, n FROM bases, (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.mts', '.cts', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs']) AS s, unnest(range(15)) AS n)),
hit AS (SELECT t.project_id, t.path, t.spec, arg_min(t.target, n) AS target FROM tried t JOIN files f ON f.path = t.target GROUP BY ALL),
imports AS (SELECT DISTINCT project_id, path, target FROM hit),
lost AS (SELECT project_id, path, spec FROM specs s WHERE NOT regexp_matches(spec, '\\.css$') AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.path = s.path AND h.spec = s.spec)),
good AS (SELECT i.* FROM imports i JOIN files f ON f.path = i.path WHERE NOT parse_error),
reasons AS (SELECT *, CASE WHEN shebang THEN 'shebang' WHEN regexp_matches(path, '\\.(test|spec)\\.[cm]?[jt]sx?$') THEN 'test' WHEN regexp_matches(path, '(^|/)bin/') THEN 'bin' WHEN regexp_matches(path, '(^|/)(index|main|app|server|cli|mod|entry|bootstrap)\\.[cm]?[jt]sx?$') THEN 'entry-name' END AS reason FROM files),
health AS (SELECT r.*, coalesce(i.n, 0) AS imported_by, coalesce(o.n, 0) AS imports, coalesce(l.n, 0) AS n_unresolved FROM reasons r LEFT JOIN (SELECT target, count(*) n FROM good GROUP BY 1) i ON i.target = r.path LEFT JOIN (SELECT path, count(*) n FROM good GROUP BY 1) o ON o.path = r.path LEFT JOIN (SELECT path, count(*) n FROM lost GROUP BY 1) l ON l.path = r.path),
verdicts AS (SELECT *, CASE WHEN parse_error THEN 'parse-error' WHEN reason IS NOT NULL THEN 'entry' WHEN imported_by = 0 THEN 'possibly-unused' ELSE 'ok' END AS verdict FROM health)"""


def _page_files(spark, d):
    pages = table(spark, d, "pages").select("page_id", P.http_path(F.col("url")).alias("web"))
    k = F.col("page_id") % 5
    end = F.when(k == 0, ".ts").when(k == 1, ".tsx").when(k == 2, "/index.ts").when(k == 3, ".js").otherwise(".test.ts")
    pf = pages.withColumn("path", F.concat(F.when(F.col("page_id") % 11 == 0, "bin").otherwise("src"), "web", end))
    files = pf.groupBy("path").agg(F.min("page_id").alias("i")).select(
        F.lit("p").alias("project_id"), "path", (F.col("i") % 4).cast("int").alias("exports"), (F.col("i") % 37 == 0).alias("shebang"), (F.col("i") % 41 == 0).alias("parse_error")
    )
    i = F.col("page_id")
    a = pf.select("path", F.explode(F.array_distinct(F.array(i + 1, i + 3, i - i % 10))).alias("page_id"))
    b = pf.select("page_id", "web")
    spec = F.concat(F.lit(".."), "web", F.when(F.col("page_id") % 9 == 0, ".css").otherwise(""))
    specs = a.join(dealt(b), "page_id").select(F.lit("p").alias("project_id"), "path", spec.alias("spec")).distinct()
    return files, specs


@query(f"WITH {_PATHS} SELECT page_id, path FROM paths")
def http_path_norm(spark, d):
    return table(spark, d, "pages").select("page_id", P.http_path(F.col("url")).alias("path"))


@query(f"WITH {_FILES} SELECT path, spec, base FROM bases")
def relative_join(spark, d):
    return _page_files(spark, d)[1].select("path", "spec", P.join_relative(F.col("path"), F.col("spec")).alias("base"))


@query(f"WITH {_FILES} SELECT path, target FROM imports")
def resolve_priority(spark, d):
    files, specs = _page_files(spark, d)
    return FI.resolve(specs, files)[0].select("path", "target")


@query(f"WITH {_FILES} SELECT path, spec FROM lost")
def unresolved_imports(spark, d):
    files, specs = _page_files(spark, d)
    return FI.resolve(specs, files)[1].select("path", "spec")


@query(f"WITH {_FILES} SELECT path, reason FROM reasons")
def entry_reason(spark, d):
    return _page_files(spark, d)[0].select("path", P.entry_reason(F.col("path"), F.col("shebang")).alias("reason"))


def _health(spark, d):
    files, specs = _page_files(spark, d)
    return FI.health(files, *FI.resolve(specs, files))


@query(f"WITH {_FILES} SELECT path, verdict, imports, imported_by, n_unresolved, CASE WHEN verdict = 'possibly-unused' THEN CAST(least(85, 55 + CASE WHEN exports > 0 THEN 15 ELSE 0 END + CASE WHEN imports = 0 THEN 10 ELSE 0 END) AS INT) END AS confidence FROM verdicts")
def unused_confidence(spark, d):
    return _health(spark, d).select("path", "verdict", "imports", "imported_by", "n_unresolved", "confidence")


@query(f"WITH {_FILES} SELECT count(*) AS files, count(*) FILTER (verdict = 'entry') AS entry_points, count(*) FILTER (verdict = 'possibly-unused') AS possibly_unused, count(*) FILTER (verdict = 'parse-error') AS parse_errors, CAST(sum(n_unresolved) AS BIGINT) AS unresolved_imports FROM verdicts")
def health_summary(spark, d):
    return FI.health_summary(_health(spark, d)).drop("project_id")


_FGRAPH = f"""{_FILES}, fe AS (SELECT DISTINCT project_id, path AS src, target AS dst FROM good WHERE path <> target), {V.components_sql('fe')},
fnodes AS (SELECT r.path, (SELECT count(*) FROM fe WHERE src = r.path) AS imports, (SELECT count(*) FROM fe WHERE dst = r.path) AS imported_by, EXISTS (SELECT 1 FROM cyc WHERE id = r.path) OR EXISTS (SELECT 1 FROM good WHERE path = r.path AND target = r.path) AS in_cycle, reason, string_split(r.path, '/') AS seg, count(*) OVER (PARTITION BY string_split(r.path, '/')[-1]) AS same FROM reasons r)"""


@query(f"WITH RECURSIVE {_FGRAPH} SELECT path, imports, imported_by, in_cycle, CASE WHEN reason IS NOT NULL THEN 'entry' WHEN imported_by = 0 THEN 'orphan' ELSE 'normal' END AS kind, CASE WHEN same > 1 AND len(seg) > 1 THEN seg[-2] || '/' || seg[-1] ELSE seg[-1] END AS label FROM fnodes")
def file_graph(spark, d):
    files, specs = _page_files(spark, d)
    return FI.file_graph(files, FI.resolve(specs, files)[0])[0].select("path", "imports", "imported_by", "in_cycle", "kind", "label")


@query(f"WITH RECURSIVE {_FGRAPH} SELECT e.src, e.dst, a.scc = b.scc AS cycle FROM fe e JOIN scc a ON a.id = e.src JOIN scc b ON b.id = e.dst")
def file_edges(spark, d):
    files, specs = _page_files(spark, d)
    return FI.file_graph(files, FI.resolve(specs, files)[0])[1].drop("project_id")


@query(f"WITH RECURSIVE {_FGRAPH} SELECT path AS id, CAST(imports + imported_by AS BIGINT) AS complexity, CASE WHEN in_cycle THEN 'hot' WHEN reason IS NULL AND imported_by = 0 THEN 'warn' ELSE 'ok' END AS level, CAST(2 * imported_by + imports AS BIGINT) AS score FROM fnodes")
def file_adapter(spark, d):
    files, specs = _page_files(spark, d)
    return FI.as_graph(FI.file_graph(files, FI.resolve(specs, files)[0])[0]).select("id", "complexity", "level", "score")


# --- simulation ----------------------------------------------------------------------------

_CHANGES = """changes AS (SELECT project_id || '/fn' AS change_id, project_id, 'delete-function' AS kind, CAST(max(dst) AS VARCHAR) AS target FROM edges GROUP BY project_id UNION ALL SELECT DISTINCT project_id || '/file', project_id, 'delete-file', 'src/f1.ts' FROM edges),
gone AS (SELECT c.change_id, c.project_id, n.id FROM changes c JOIN nodes n ON n.project_id = c.project_id AND (kind = 'delete-function' AND CAST(n.id AS VARCHAR) = target OR kind = 'delete-file' AND n.file = target)),
hit AS (SELECT g.change_id, e.project_id, e.src AS id, count(*) AS lost FROM gone g JOIN edges e ON e.project_id = g.project_id AND e.dst = g.id WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.change_id = g.change_id AND x.id = e.src) GROUP BY ALL),
snodes AS (SELECT p.change_id AS project_id, n.id, n.name, n.file, n.complexity FROM nodes n JOIN (SELECT DISTINCT change_id, project_id FROM gone) p USING (project_id) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.change_id = p.change_id AND g.id = n.id)),
sedges AS (SELECT p.change_id AS project_id, e.src, e.dst FROM edges e JOIN (SELECT DISTINCT change_id, project_id FROM gone) p USING (project_id) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.change_id = p.change_id AND g.id IN (e.src, e.dst)))"""


def _simulation(spark, d):
    nodes, edges = V.weekly(spark, d)
    one = edges.groupBy("project_id").agg(F.max("dst").cast("string").alias("target"))
    fn = one.select(F.concat("project_id", F.lit("/fn")).alias("change_id"), "project_id", F.lit("delete-function").alias("kind"), "target")
    file = one.select(F.concat("project_id", F.lit("/file")).alias("change_id"), "project_id", F.lit("delete-file").alias("kind"), F.lit("src/f1.ts").alias("target"))
    changes = fn.unionByName(file)
    return changes, I.removed(changes, nodes), nodes, edges


@query(f"WITH {V.WEEKLY}, {_CHANGES} SELECT c.change_id, count(g.id) > 0 AS found, count(g.id) AS n_removed FROM changes c LEFT JOIN gone g USING (change_id) GROUP BY ALL")
def simulate_delete(spark, d):
    changes, gone, _, _ = _simulation(spark, d)
    return I.outcomes(changes, gone)


@query(f"WITH {V.WEEKLY}, {_CHANGES} SELECT h.change_id, h.id, h.lost, (SELECT array_to_string(list(CAST(e.dst AS VARCHAR) ORDER BY CAST(e.dst AS VARCHAR)), ',') FROM edges e JOIN gone g ON g.change_id = h.change_id AND g.id = e.dst WHERE e.project_id = h.project_id AND e.src = h.id) AS callees, (SELECT count(*) FROM edges e WHERE e.project_id = h.project_id AND e.src = h.id) AS fan_out_before, (SELECT count(*) FROM edges e WHERE e.project_id = h.project_id AND e.src = h.id) - h.lost AS fan_out_after FROM hit h")
def broken_callers(spark, d):
    _, gone, nodes, edges = _simulation(spark, d)
    return I.broken_callers(gone, nodes, edges).select("change_id", "id", "lost", F.array_join("callees", ",").alias("callees"), "fan_out_before", "fan_out_after")


@query(f"WITH {V.WEEKLY}, {_CHANGES} SELECT DISTINCT h.change_id, n.file FROM hit h JOIN nodes n ON n.project_id = h.project_id AND n.id = h.id WHERE regexp_matches(n.file, '\\.(test|spec)\\.[cm]?[jt]sx?$')")
def affected_tests(spark, d):
    _, gone, nodes, edges = _simulation(spark, d)
    return I.affected_tests(I.broken_callers(gone, nodes, edges))


@query(f"WITH {V.WEEKLY}, {_CHANGES} SELECT s.project_id AS change_id, s.id FROM snodes s WHERE NOT EXISTS (SELECT 1 FROM sedges e WHERE e.project_id = s.project_id AND e.dst = s.id) AND EXISTS (SELECT 1 FROM gone g JOIN edges e ON e.project_id = g.project_id WHERE g.change_id = s.project_id AND e.dst = s.id)")
def newly_orphaned(spark, d):
    _, gone, nodes, edges = _simulation(spark, d)
    return I.newly_orphaned(gone, nodes, edges)


@query(f"""WITH RECURSIVE {V.WEEKLY_SCORED}, {_CHANGES}, {V.components_sql('sedges', 's_')}, {V.scored_sql('snodes', 'sedges', 's_')}, p AS (SELECT DISTINCT change_id, project_id FROM gone)
SELECT p.change_id, b.functions_before, b.in_cycle_before, b.flagged_before, coalesce(a.f, 0) AS functions_after, coalesce(a.c, 0) AS in_cycle_after, coalesce(a.l, 0) AS flagged_after FROM p
JOIN (SELECT project_id, count(*) AS functions_before, count(*) FILTER (in_cycle) AS in_cycle_before, count(*) FILTER (level <> 'ok') AS flagged_before FROM scored GROUP BY 1) b USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS f, count(*) FILTER (in_cycle) AS c, count(*) FILTER (level <> 'ok') AS l FROM s_scored GROUP BY 1) a ON a.project_id = p.change_id""")
def metric_delta(spark, d):
    _, gone, nodes, edges = _simulation(spark, d)
    return I.metric_delta(gone, nodes, edges)


# --- before/after policy ---------------------------------------------------------------------

POLICY = PO.Policy(name="hand-over", allow_functions=("3", "6", "9", "12"), preserve_functions=("15", "18", "999999"), preserve_files=("src/f1.ts",), max_new_hotspots=1000, max_new_function_cycles=3)
_FACTS = f"""{V.SNAPSHOTS}, {V.components_sql()}, {V.scored_sql()},
facts AS (SELECT project_id AS snapshot_id, 'function' AS kind, CAST(id AS VARCHAR) AS key FROM scored UNION SELECT project_id, 'cycle-function', CAST(id AS VARCHAR) FROM scored WHERE in_cycle UNION SELECT project_id, 'hotspot', CAST(id AS VARCHAR) FROM scored WHERE level <> 'ok'
 UNION SELECT project_id, 'file', file FROM scored UNION SELECT project_id, 'script', file FROM scored UNION SELECT project_id, 'cycle-file', file FROM scored WHERE in_cycle UNION SELECT project_id, 'unresolved', CAST(id AS VARCHAR) FROM scored WHERE fan_out % 13 = 0),
deltas AS (SELECT kind, key, CASE WHEN bool_or(snapshot_id = 'after') THEN 'added' ELSE 'removed' END AS change FROM facts GROUP BY kind, key HAVING count(*) = 1),
ev AS (SELECT 'new-' || kind AS what, key FROM deltas WHERE change = 'added' AND kind IN ('unresolved', 'cycle-file', 'cycle-function', 'hotspot') UNION ALL SELECT 'undeclared-' || kind, key FROM deltas WHERE change = 'removed' AND (kind = 'file' OR kind = 'function' AND key NOT IN ('3', '6', '9', '12'))
 UNION ALL SELECT 'lost-' || k, v FROM (VALUES ('function', '15'), ('function', '18'), ('function', '999999'), ('file', 'src/f1.ts')) t(k, v) WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.snapshot_id = 'after' AND f.kind = k AND f.key = v)),
checks AS (SELECT id, count(ev.key) AS n, CASE WHEN count(ev.key) > most THEN 'fail' ELSE 'pass' END AS status FROM (VALUES ('analysis-complete', '', 0), ('removed-files-declared', 'undeclared-file', 0), ('removed-functions-declared', 'undeclared-function', 0), ('preserved-files-exist', 'lost-file', 0), ('preserved-functions-exist', 'lost-function', 0),
 ('unresolved-import-budget', 'new-unresolved', 0), ('file-cycle-budget', 'new-cycle-file', 0), ('function-cycle-budget', 'new-cycle-function', 3), ('hotspot-budget', 'new-hotspot', 1000)) c(id, what, most) LEFT JOIN ev USING (what) GROUP BY id, most)"""


def _facts(spark, d):
    s = G.scored(*V.snapshots(spark, d))
    key = F.col("id").cast("string")
    fact = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    kinds = F.array(
        fact("function", key), F.when(F.col("in_cycle"), fact("cycle-function", key)), F.when(F.col("level") != "ok", fact("hotspot", key)),
        fact("file", F.col("file")), fact("script", F.col("file")), F.when(F.col("in_cycle"), fact("cycle-file", F.col("file"))), F.when(F.col("fan_out") % 13 == 0, fact("unresolved", key)),
    )
    return s.select(F.col("project_id").alias("snapshot_id"), F.inline(F.filter(kinds, lambda x: x.isNotNull()))).distinct()


@query(f"WITH RECURSIVE {_FACTS} SELECT kind, key, change FROM deltas")
def fact_deltas(spark, d):
    return PO.deltas(_facts(spark, d))


@query(f"WITH RECURSIVE {_FACTS} SELECT id, status, n, array_to_string((SELECT list(key ORDER BY key)[1:3] FROM (SELECT key FROM ev JOIN (VALUES ('removed-functions-declared', 'undeclared-function'), ('preserved-functions-exist', 'lost-function'), ('unresolved-import-budget', 'new-unresolved'), ('function-cycle-budget', 'new-cycle-function'), ('hotspot-budget', 'new-hotspot'), ('file-cycle-budget', 'new-cycle-file'), ('removed-files-declared', 'undeclared-file'), ('preserved-files-exist', 'lost-file')) m(i, w) ON m.w = ev.what AND m.i = checks.id)), ',') || CASE WHEN n > 3 THEN ',... ' || (n - 3) || ' more' ELSE '' END AS evidence FROM checks")
def policy_checks(spark, d):
    df = PO.checks(_facts(spark, d), POLICY, limit=3)
    return df.select("id", "status", "n", F.when(F.size("evidence") > 0, F.array_join("evidence", ",")).alias("evidence"))


@query(f"WITH RECURSIVE {_FACTS} SELECT CASE WHEN bool_or(status = 'fail') THEN 'fail' ELSE 'pass' END AS status, NOT bool_or(status = 'fail') AS accepted FROM checks")
def overall_status(spark, d):
    return PO.overall(PO.checks(_facts(spark, d), POLICY))


@query(f"""WITH RECURSIVE {_FACTS} SELECT id, CASE WHEN id IN ('removed-files-declared', 'preserved-files-exist') THEN status ELSE 'unknown' END AS status, CASE id WHEN 'analysis-complete' THEN 2 ELSE n END AS n, CASE id WHEN 'analysis-complete' THEN 'after: src/f2.ts,before: src/f3.ts' END AS evidence FROM checks""")
def incomplete_checks(spark, d):
    """The checks where a file of each snapshot cannot be read: those that need the graph stay open."""
    facts = _facts(spark, d)
    broken = spark.createDataFrame([("after", "parse-error", "src/f2.ts"), ("before", "parse-error", "src/f3.ts")], facts.schema)
    df = PO.checks(facts.unionByName(broken), POLICY, limit=3)
    return df.select("id", "status", "n", F.when(F.col("id") == "analysis-complete", F.array_join("evidence", ",")).alias("evidence"))


@query(f"WITH RECURSIVE {_FACTS} SELECT 'change' AS mode, count(*) FILTER (status = 'fail') = 0 AS passed, CAST(count(*) FILTER (status = 'fail') > 0 AS INT) AS exit_code, count(*) FILTER (status = 'fail') AS errors, 0::BIGINT AS unknowns FROM checks")
def change_gate(spark, d):
    return PO.change_gate(PO.checks(_facts(spark, d), POLICY))


_SNAPFILES = "sf AS (SELECT 'before' AS snapshot_id, url AS path, html AS content FROM pages WHERE page_id % 10 < 9 UNION ALL SELECT 'after', url, CASE WHEN page_id % 7 = 0 THEN html || '.' ELSE html END FROM pages WHERE page_id % 10 > 0)"


def _snap_files(spark, d):
    pages = table(spark, d, "pages")
    before = pages.filter("page_id % 10 < 9").select(F.lit("before").alias("snapshot_id"), F.col("url").alias("path"), F.col("html").alias("content"), F.col("page_id").alias("ordinal"))
    after = pages.filter("page_id % 10 > 0").select(F.lit("after").alias("snapshot_id"), F.col("url").alias("path"), F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("."))).otherwise(F.col("html")).alias("content"), F.col("page_id").alias("ordinal"))
    return before.unionByName(after)


@query(f"WITH {_SNAPFILES}, b AS (SELECT * FROM sf WHERE snapshot_id = 'before'), a AS (SELECT * FROM sf WHERE snapshot_id = 'after') SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.path = b.path WHERE a.content IS DISTINCT FROM b.content")
def snapshot_diff(spark, d):
    return PO.snapshot_diff(_snap_files(spark, d))


@query(f"WITH {_SNAPFILES}, b AS (SELECT * FROM sf WHERE snapshot_id = 'before'), a AS (SELECT * FROM sf WHERE snapshot_id = 'after') SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.path = b.path WHERE a.content IS DISTINCT FROM b.content")
def snapshot_tree_diff(spark, d):
    files = _snap_files(spark, d)
    depth = HT.depth_for(files.count() // 2, 16)
    before, after = (HT.tree(files.filter(F.col("snapshot_id") == s), depth) for s in ("before", "after"))
    return HT.diff(before, after)


@query(f"""WITH {_SNAPFILES}, l2 AS (SELECT snapshot_id, substr(sha256(path), 1, 2) AS p, sha256(string_agg(path || chr(0) || sha256(content) || chr(0), '' ORDER BY path)) AS d FROM sf GROUP BY ALL),
l1 AS (SELECT snapshot_id, p[1] AS p, sha256(string_agg(d, '' ORDER BY l2.p)) AS d FROM l2 GROUP BY ALL), l0 AS (SELECT snapshot_id, sha256(string_agg(d, '' ORDER BY p)) AS digest FROM l1 GROUP BY 1)
SELECT * FROM l0 UNION ALL SELECT 'updated', digest FROM l0 WHERE snapshot_id = 'after'""")
def snapshot_tree_roots(spark, d):
    """Roots of both snapshots, and of the first one's tree after the changes that lead to the second."""
    files = _snap_files(spark, d)
    side = {s: files.filter(F.col("snapshot_id") == s).drop("snapshot_id") for s in ("before", "after")}
    trees = {s: HT.tree(f, 2) for s, f in side.items()}
    changes = HT.changed(trees["before"], trees["after"]).join(side["after"], "path", "left").select("path", "ordinal", "content", "removed")
    trees["updated"] = HT.updated(trees["before"], changes)
    roots = [t.root().select(F.lit(s).alias("snapshot_id"), "digest") for s, t in trees.items()]
    return roots[0].unionByName(roots[1]).unionByName(roots[2])


_DIGESTS = f"""{_SNAPFILES}, rg AS (SELECT snapshot_id, substr(sha256(path), 1, 4) AS r, sha256(string_agg(path || chr(0) || sha256(content) || chr(0), '' ORDER BY path)) AS d FROM sf GROUP BY ALL),
dg AS (SELECT snapshot_id, 'sha256:' || sha256(string_agg(d, '' ORDER BY r)) AS digest FROM rg GROUP BY 1)"""


@query(f"WITH {_DIGESTS} SELECT * FROM dg")
def snapshot_digests(spark, d):
    return PO.files_digest(_snap_files(spark, d))


@query(f"WITH {_DIGESTS} SELECT 'sha256:' || sha256('1|' || (SELECT digest FROM dg WHERE snapshot_id = 'before') || '|' || (SELECT digest FROM dg WHERE snapshot_id = 'after') || '|sha256:' || sha256('{POLICY.text}')) AS fingerprint")
def fingerprint(spark, d):
    return PO.fingerprint(_snap_files(spark, d), POLICY)


# --- contracts -------------------------------------------------------------------------------

_ENDPOINTS = f"""{_PATHS}, cl AS (SELECT CAST(page_id AS VARCHAR) AS id, ['GET', 'POST', 'DELETE'][page_id % 3 + 1] AS method, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, page_id % 4 = 1 AS has_b, CASE WHEN page_id % 5 = 0 THEN 'absent' ELSE 'present' END AS auth, page_id FROM paths),
rt AS (SELECT 'GET ' || '/' || seg[1] || '/:id' AS id, 'GET' AS method, '/' || seg[1] || '/:id' AS path, [seg[1], ':id'] AS seg, seg[1] = 'de' AS wants, seg[1] = 'fr' AS guarded FROM cl WHERE len(seg) > 0 GROUP BY seg[1] UNION ALL SELECT 'ANY /de/*', 'ANY', '/de/*', ['de', '*'], false, true WHERE EXISTS (SELECT 1 FROM cl WHERE seg[1] = 'de')
 UNION ALL SELECT DISTINCT 'POST ' || path, 'POST', path, seg, true, false FROM cl WHERE page_id % 20 = 0),
pairs AS (SELECT cl.id AS client_id, rt.id AS route_id, rt.method = 'ANY' OR rt.method = cl.method AS method_ok, cl.has_b, cl.auth, rt.wants, rt.guarded FROM cl JOIN rt ON CASE WHEN coalesce(list_position(rt.seg, '*'), 0) > 0 THEN len(cl.seg) >= list_position(rt.seg, '*') - 1 ELSE len(cl.seg) = len(rt.seg) END
 AND len(list_filter(range(1, CASE WHEN coalesce(list_position(rt.seg, '*'), 0) > 0 THEN list_position(rt.seg, '*') ELSE len(rt.seg) + 1 END), lambda i: NOT (cl.seg[i] = rt.seg[i] OR starts_with(cl.seg[i], ':') OR starts_with(rt.seg[i], ':')))) = 0),
iss AS (SELECT c.id, CASE WHEN count(p.route_id) = 0 THEN 'missing-route' ELSE 'method-mismatch' END AS kind, 'error' AS severity, count(p.route_id) AS candidates FROM cl c LEFT JOIN pairs p ON p.client_id = c.id GROUP BY c.id HAVING NOT coalesce(bool_or(method_ok), false)
 UNION ALL SELECT id, 'no-local-consumer', 'info', 0 FROM rt WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.route_id = rt.id AND method_ok))"""


def _endpoints(spark, d):
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    i = F.col("page_id")
    pages = table(spark, d, "pages").select("page_id", P.http_path(F.col("url")).alias("path"))
    clients = pages.select(
        F.lit("p").alias("project_id"), i.cast("string").alias("id"), F.element_at(strings("GET", "POST", "DELETE"), (i % 3 + 1).cast("int")).alias("method"), "path",
        F.when(i % 4 == 1, strings("a", "b")).otherwise(strings("a")).alias("request_fields"), strings("x").alias("response_fields"), ints(200).alias("statuses"), F.when(i % 5 == 0, "absent").otherwise("present").alias("auth"),
    )
    first = P.segments(F.col("path"))
    heads = clients.filter(F.size(first) > 0).select(first[0].alias("s")).distinct()
    route = lambda method, path, wants, guarded: (
        F.lit("p").alias("project_id"), F.concat(F.lit(method + " "), path).alias("id"), F.lit(method).alias("method"), path.alias("path"), F.when(wants, strings("a", "b")).otherwise(strings()).alias("request_fields"),
        F.when(wants, strings("y")).otherwise(strings("x")).alias("response_fields"), F.when(guarded, ints(401)).otherwise(ints(200)).alias("statuses"), F.when(guarded, "required").otherwise("unknown").alias("auth"),
    )
    one = heads.select(*route("GET", F.concat(F.lit("/"), "s", F.lit("/:id")), F.col("s") == "de", F.col("s") == "fr"))
    rest = heads.filter("s = 'de'").select(*route("ANY", F.lit("/de/*"), F.lit(False), F.lit(True)))
    exact = pages.filter("page_id % 20 = 0").select("path").distinct().select(*route("POST", F.col("path"), F.lit(True), F.lit(False)))
    return clients, one.unionByName(rest).unionByName(exact)


@query(f"WITH {_ENDPOINTS} SELECT client_id, route_id, method_ok FROM pairs")
def path_match(spark, d):
    return R.matches(*_endpoints(spark, d)).drop("project_id")


@query(f"WITH {_ENDPOINTS} SELECT * FROM iss")
def match_status(spark, d):
    c, r = _endpoints(spark, d)
    return R.status_issues(c, r, R.matches(c, r)).drop("project_id")


@query(f"""WITH {_ENDPOINTS} SELECT client_id, route_id, 'request-schema-mismatch' AS kind, 'b' AS detail FROM pairs WHERE method_ok AND wants AND NOT has_b UNION ALL SELECT client_id, route_id, 'response-schema-mismatch', 'x' FROM pairs WHERE method_ok AND wants
 UNION ALL SELECT client_id, route_id, 'missing-auth', '' FROM pairs WHERE method_ok AND guarded AND auth = 'absent' UNION ALL SELECT client_id, route_id, 'status-mismatch', '200' FROM pairs WHERE method_ok AND guarded""")
def contract_drift(spark, d):
    c, r = _endpoints(spark, d)
    return R.drift(c, r, R.matches(c, r)).drop("project_id")


@query(f"WITH {_ENDPOINTS} SELECT rt.id, count(p.client_id) AS n_tests FROM rt LEFT JOIN pairs p ON p.route_id = rt.id AND method_ok AND CAST(p.client_id AS BIGINT) % 6 = 0 GROUP BY rt.id")
def route_coverage(spark, d):
    c, r = _endpoints(spark, d)
    return R.coverage(r, c.filter(F.col("id").cast("bigint") % 6 == 0)).drop("project_id")


@query(f"WITH {_ENDPOINTS} SELECT 'radar' AS mode, count(*) FILTER (severity = 'error') = 0 AS passed, CAST(count(*) FILTER (severity = 'error') > 0 AS INT) AS exit_code, count(*) FILTER (severity = 'error') AS errors, (SELECT count(*) FROM cl WHERE len(seg) = 0) AS unknowns FROM iss")
def radar_gate(spark, d):
    c, r = _endpoints(spark, d)
    unknown = c.agg(F.count_if(F.size(P.segments(F.col("path"))) == 0).alias("unknowns"))
    return R.radar_gate(R.status_issues(c, r, R.matches(c, r)), unknown)


_MOUNTS = """mounts AS (SELECT DISTINCT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, '/' || lower(r_name) AS prefix FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT DISTINCT 'n' || s_nationkey, 's' || s_suppkey, '/supplier' FROM supplier UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey, '/back' FROM supplier WHERE s_suppkey % 10 = 0)"""


@query(f"""WITH RECURSIVE {_MOUNTS}, walk AS (SELECT DISTINCT child AS receiver, child AS at, '/' AS prefix, [child] AS seen, false AS over FROM mounts
 UNION ALL SELECT w.receiver, m.parent, CASE WHEN w.prefix = '/' THEN m.prefix ELSE m.prefix || w.prefix END, list_append(w.seen, m.parent), list_contains(w.seen, m.parent) OR m.parent NOT IN (SELECT child FROM mounts) FROM walk w JOIN mounts m ON m.child = w.at WHERE NOT w.over)
 SELECT DISTINCT receiver, prefix FROM walk WHERE over UNION SELECT parent, '/' FROM mounts WHERE parent NOT IN (SELECT child FROM mounts)""")
def mount_prefixes(spark, d):
    t = lambda n: table(spark, d, n)
    name = lambda p, c: F.concat(F.lit(p), c)
    a = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"), F.concat(F.lit("/"), F.lower("r_name")).alias("prefix"))
    b = t("supplier").select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("child"), F.lit("/supplier").alias("prefix"))
    c = t("supplier").filter("s_suppkey % 10 = 0").select(name("s", "s_suppkey").alias("parent"), name("n", "s_nationkey").alias("child"), F.lit("/back").alias("prefix"))
    mounts = a.union(b).union(c).distinct().select(F.lit("p").alias("project_id"), "*")
    return R.mount_prefixes(mounts).drop("project_id")


# --- guarded joins -----------------------------------------------------------------------------


@query("""WITH c AS (SELECT DISTINCT p_brand AS scope, p_name AS name, p_partkey AS target FROM part), pr AS (SELECT l_orderkey, l_linenumber, p_brand AS scope, p_name AS name FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey),
n AS (SELECT scope, name, count(*) AS n, min(target) AS t FROM c GROUP BY ALL), f AS (SELECT name, count(*) AS n, min(target) AS t FROM c GROUP BY ALL) SELECT l_orderkey, l_linenumber, CASE WHEN n.n = 1 THEN n.t ELSE f.t END AS target, CASE WHEN n.n = 1 THEN 'same-file' ELSE 'exact' END AS resolution FROM pr LEFT JOIN n USING (scope, name) JOIN f USING (name) WHERE n.n = 1 OR f.n = 1""")
def unique_match_join(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_name").alias("name"), F.col("p_partkey").alias("target"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target")).distinct()
    probes = lines.join(part, "target").select("l_orderkey", "l_linenumber", "scope", "name")
    return J.unique_match(probes, part, ["l_orderkey", "l_linenumber"], "name", "target")


_DOTTED = f"{_PATHS}, dotted AS (SELECT page_id, path, replace(regexp_extract(url, '://([^/]*)', 1), '.', '.') || replace(path, '/', '.') AS receiver FROM paths)"


def _dotted(spark, d):
    host = F.regexp_extract("url", "://([^/]*)", 1)
    return table(spark, d, "pages").select("page_id", F.concat(host, F.translate(P.http_path(F.col("url")), "/", ".")).alias("receiver"), host.alias("host"))


@query(f"WITH {_DOTTED}, b AS (SELECT local, min(value) AS value FROM (SELECT regexp_extract(url, '://([^/]*)', 1) AS local, page_id AS value FROM pages UNION ALL SELECT receiver, page_id FROM dotted WHERE page_id % 3 = 0) GROUP BY 1) SELECT page_id, arg_max(local, length(local)) AS local, arg_max(value, length(local)) AS value FROM dotted JOIN b ON receiver = local OR starts_with(receiver, local || '.') GROUP BY 1")
def longest_prefix_join(spark, d):
    df = _dotted(spark, d)
    bindings = df.select(F.col("host").alias("local"), F.col("page_id").alias("value")).unionByName(df.filter("page_id % 3 = 0").select(F.col("receiver").alias("local"), F.col("page_id").alias("value")))
    return J.longest_prefix(df, bindings, ["page_id"], "receiver", "local", "value")


@query(f"WITH {_DOTTED}, t AS (SELECT DISTINCT regexp_extract(url, '://([^/]*)', 1) AS module, replace(substr(path, 2), '/', '.') AS owner, page_id AS target FROM paths WHERE page_id % 2 = 0) SELECT DISTINCT page_id, target FROM dotted JOIN t ON receiver = module || '.' || owner")
def prefix_split_join(spark, d):
    df = _dotted(spark, d)
    owner = F.substring(F.col("receiver"), F.length("host") + 2, F.length("receiver"))
    targets = df.filter("page_id % 2 = 0").select(F.col("host").alias("module"), owner.alias("owner"), F.col("page_id").alias("target"))
    return J.prefix_split(df, targets, ["page_id"], "receiver", "target")


@query("""WITH a AS (SELECT event_id, event_type AS base, user_id % 3 AS line, user_id % 50 AS file, row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY ts, event_id) AS nth, ts FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY file, base, line, nth > 1 ORDER BY ts, event_id) AS again FROM a) SELECT event_id, CASE WHEN nth = 1 THEN base WHEN again = 1 THEN base || '@' || line ELSE base || '@' || line || '-' || again END AS uid FROM b""")
def uniquify_ids(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("base"), (F.col("user_id") % 3).alias("line"), (F.col("user_id") % 50).alias("file"), "ts")
    return J.unique_ids(e, ["file"], "base", "line", ["ts", "event_id"]).select("event_id", "uid")


# --- sources and reports -------------------------------------------------------------------------


@query("WITH f AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS project_id, url AS path, CAST(strlen(html) AS BIGINT) AS bytes FROM pages) SELECT project_id, path, CAST(sum(bytes) OVER (PARTITION BY project_id ORDER BY path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, sum(bytes) OVER (PARTITION BY project_id ORDER BY path ROWS UNBOUNDED PRECEDING) <= 20000 AS kept FROM f")
def running_limit(spark, d):
    host = F.regexp_extract("url", "://([^/]*)", 1)
    files = table(spark, d, "pages").select(host.alias("project_id"), F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("bytes"), "page_id")
    return S.running_limit(files, 20_000, order=("path", "page_id")).select("project_id", "path", "total", "kept")


@query(f"WITH {_PATHS} SELECT page_id AS ordinal, path, CASE WHEN page_id % 13 = 0 THEN 'invalidFiles' WHEN row_number() OVER (PARTITION BY path ORDER BY page_id) > 1 THEN 'duplicateFilePath' END AS code FROM paths")
def payload_validation(spark, d):
    pages = table(spark, d, "pages")
    windows_path = F.concat(F.lit(" "), F.translate(P.http_path(F.col("url")), "/", "\\"))
    return S.validate(pages.select(F.col("page_id").alias("ordinal"), windows_path.alias("path"), F.when(F.col("page_id") % 13 > 0, F.col("html")).alias("content")))


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^/]*)', 1) AS name, url FROM pages), r AS (SELECT name, substr(sha256(url), 1, 4) AS r, sha256(string_agg(url || '|', '' ORDER BY url)) AS d FROM p GROUP BY ALL)
 SELECT name, sha1(name || chr(0) || sha256(string_agg(d, '' ORDER BY r))) AS signature FROM r GROUP BY name""")
def project_signature(spark, d):
    return S.signature(table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("name"), F.col("url").alias("path")))


_SAVED = "saved AS (SELECT CAST(event_id AS VARCHAR) AS id, 's' || (user_id % 200) AS signature, ts AS created_at, ts AS updated_at FROM events)"


@query(f"WITH {_SAVED} SELECT arg_min(id, created_at) AS id, signature, min(created_at) AS created_at, max(updated_at) AS updated_at FROM saved GROUP BY signature")
def store_upsert(spark, d):
    saved = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("s"), F.col("user_id") % 200).alias("signature"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return S.upsert(saved.filter("cast(id as bigint) % 2 = 0"), saved.filter("cast(id as bigint) % 2 = 1"))


@query("SELECT page_id, regexp_extract(html, '<script>[^<]*(?:</p>)?[^<]*?([A-Za-z_]+)\\(([0-9]+)\\)', 1) AS callee, regexp_extract(html, '<script>[^<]*(?:</p>)?[^<]*?([A-Za-z_]+)\\(([0-9]+)\\)', 2) AS argument FROM pages")
def extract_script_calls(spark, d):
    from larchgraph.extract import scripts

    return scripts.script_calls(table(spark, d, "pages")).select("page_id", "callee", "argument")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (k = n // 2 + 1) AS median, max(value) FILTER (k = CAST(ceil(0.95 * n) AS BIGINT)) AS p95 FROM r GROUP BY 1")
def p95_median(spark, d):
    """The upper median and the nearest rank."""
    events = table(spark, d, "events")
    return QU.quantiles(events, ["event_type"], "value", {"median": lambda n: F.floor(n / 2) + 1, "p95": lambda n: F.ceil(n * 0.95)})


@query("SELECT user_id, array_to_string(list(DISTINCT event_type ORDER BY event_type)[1:3], ',') || CASE WHEN count(DISTINCT event_type) > 3 THEN ',... ' || (count(DISTINCT event_type) - 3) || ' more' ELSE '' END AS evidence FROM events GROUP BY 1")
def evidence_sample(spark, d):
    kinds = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("k"))
    return kinds.select("user_id", F.array_join(PO.sample(F.col("k"), 3), ",").alias("evidence"))
