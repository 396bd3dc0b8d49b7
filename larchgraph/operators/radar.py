"""HTTP contracts: clients against routes, drift, test coverage, mounts and the gate.

endpoints: project_id, id, method, path, request_fields, response_fields, statuses (arrays), auth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchgraph.functions import paths as P
from larchgraph.functions.tables import dropped, stored
from larchgraph.operators import graph as G
from larchgraph.operators.policy import _gate


def route_trie(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes as a trie relation: edges(project_id, node, segment, child) and ends(project_id, node,
    route_id, open). A node is named by the segments that lead to it, a parameter by `:`; a route with * is
    open: it ends at the node before and fits whatever follows there."""
    r = routes.select("project_id", F.col("id").alias("route_id"), P.segments(F.col("path")).alias("rs"))
    star = F.coalesce(F.array_position("rs", "*"), F.lit(0)).cast("int")
    head = F.when(star > 0, F.slice("rs", 1, F.greatest(star - 1, F.lit(0)))).otherwise(F.col("rs"))
    r = r.select("project_id", "route_id", (star > 0).alias("open"), F.transform(head, lambda x: F.when(x.startswith(":"), ":").otherwise(x)).alias("_h"))
    ends = r.select("project_id", F.array_join("_h", "/").alias("node"), "route_id", "open")
    heads = r.select("project_id", "_h").distinct().withColumn("_n", F.explode(F.when(F.size("_h") > 0, F.sequence(F.lit(1), F.size("_h")))))
    part = lambda n: F.array_join(F.slice("_h", 1, n), "/")
    edges = heads.select("project_id", part(F.col("_n") - 1).alias("node"), F.get("_h", F.col("_n") - 1).alias("segment"), part(F.col("_n")).alias("child"), F.col("_n").alias("depth")).distinct()
    return edges, ends


def trie_walk(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, path, node, whole): the nodes that each distinct path passes, and whether it ends
    there. One segment is taken in a round, by equality with the children of the nodes reached: its own
    child and the parameter's; a segment that is a parameter itself takes all children. Written."""
    edges = stored(edges)
    front = stored(paths.select("project_id", "path", P.segments(F.col("path")).alias("cs"), F.lit("").alias("node")).distinct())
    passed, k = [front.select("project_id", "path", "node", (F.size("cs") == 0).alias("whole"))], 0
    while front.filter(F.size("cs") > k).limit(1).count():
        here = F.get("cs", F.lit(k))
        child = edges.filter(F.col("depth") == k + 1).select("project_id", "node", "segment", "child")
        live = front.filter(F.size("cs") > k)
        one = live.filter(~here.startswith(":")).withColumn("segment", F.explode(F.array(here, F.lit(":")))).join(child, ["project_id", "node", "segment"])
        any_ = live.filter(here.startswith(":")).join(child, ["project_id", "node"])
        cols = ["project_id", "path", "cs", F.col("child").alias("node")]
        front, k = stored(one.select(*cols).unionByName(any_.select(*cols))), k + 1
        passed.append(front.select("project_id", "path", "node", (F.size("cs") == k).alias("whole")))
    return reduce(DataFrame.unionByName, passed)


def path_pairs(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """(project_id, client_id, route_id) of every client path that fits a route's: distinct paths walk the
    routes' trie, so a path meets the routes that it fits and nodes on the way to them only."""
    edges, ends = route_trie(routes)
    passed = trie_walk(clients.select("project_id", "path").filter("path is not null"), edges)
    fit = passed.join(ends, ["project_id", "node"]).filter("open or whole").select("project_id", "path", "route_id")
    return clients.select("project_id", F.col("id").alias("client_id"), "path").join(fit, ["project_id", "path"]).select("project_id", "client_id", "route_id")


def matches(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """path_pairs with method_ok: the route answers the client's method or any."""
    c = clients.select("project_id", F.col("id").alias("client_id"), F.col("method").alias("cm"))
    r = routes.select("project_id", F.col("id").alias("route_id"), F.col("method").alias("rm"))
    df = path_pairs(clients, routes).join(c, ["project_id", "client_id"]).join(r, ["project_id", "route_id"])
    return df.select("project_id", "client_id", "route_id", ((F.col("rm") == "ANY") | (F.col("rm") == F.col("cm"))).alias("method_ok"))


def status_issues(clients: DataFrame, routes: DataFrame, matched: DataFrame) -> DataFrame:
    """(project_id, id, kind, severity, candidates): missing-route, method-mismatch, no-local-consumer."""
    per = matched.groupBy("project_id", F.col("client_id").alias("id")).agg(F.bool_or("method_ok").alias("ok"), F.count("*").alias("candidates"))
    c = clients.select("project_id", "id").join(per, ["project_id", "id"], "left")
    c = c.filter("ok is null or not ok").select("project_id", "id", F.when(F.col("ok").isNull(), "missing-route").otherwise("method-mismatch").alias("kind"), F.lit("error").alias("severity"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    used = matched.filter("method_ok").select("project_id", F.col("route_id").alias("id"))
    r = routes.select("project_id", "id").join(used, ["project_id", "id"], "left_anti")
    return c.unionByName(r.select("project_id", "id", F.lit("no-local-consumer").alias("kind"), F.lit("info").alias("severity"), F.lit(0).cast("bigint").alias("candidates")))


def drift(clients: DataFrame, routes: DataFrame, matched: DataFrame) -> DataFrame:
    """(project_id, client_id, route_id, kind, detail) of every matched pair that disagrees."""
    parts = ("request_fields", "response_fields", "statuses", "auth")
    side = lambda df, key, p: df.select("project_id", F.col("id").alias(key), *[F.col(c).alias(p + c) for c in parts])
    df = matched.filter("method_ok").join(side(clients, "client_id", "c_"), ["project_id", "client_id"]).join(side(routes, "route_id", "r_"), ["project_id", "route_id"])
    both = lambda part: (F.size(f"c_{part}") > 0) & (F.size(f"r_{part}") > 0)
    asked = F.array_sort(F.array_except("r_request_fields", "c_request_fields"))
    read = F.array_sort(F.array_except("c_response_fields", "r_response_fields"))
    codes = F.array_sort(F.array_except("c_statuses", "r_statuses"))
    one = lambda cond, kind, detail: F.when(cond, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    found = F.array(
        one(F.size(asked) > 0, "request-schema-mismatch", F.array_join(asked, ",")),
        one(both("response_fields") & (F.size(read) > 0), "response-schema-mismatch", F.array_join(read, ",")),
        one((F.col("r_auth") == "required") & (F.col("c_auth") == "absent"), "missing-auth", F.lit("")),
        one(both("statuses") & (F.size(codes) > 0), "status-mismatch", F.array_join(codes.cast("array<string>"), ",")),
    )
    return df.select("project_id", "client_id", "route_id", F.inline(F.filter(found, lambda x: x.isNotNull())))


def covered_by(routes: DataFrame, observations: DataFrame) -> DataFrame:
    """(project_id, id, observation_id, file, line): the test observations that reach each route."""
    hit = matches(observations, routes).filter("method_ok").select("project_id", F.col("route_id").alias("id"), F.col("client_id").alias("observation_id"))
    seen = observations.select("project_id", F.col("id").alias("observation_id"), "file", "line")
    return hit.join(seen, ["project_id", "observation_id"]).select("project_id", "id", "observation_id", "file", "line")


def coverage(routes: DataFrame, observations: DataFrame) -> DataFrame:
    """(project_id, id, n_tests): test observations of each route; 0 is a warning."""
    hit = matches(observations, routes).filter("method_ok").groupBy("project_id", F.col("route_id").alias("id")).agg(F.count("*").alias("n_tests"))
    return routes.select("project_id", "id").join(hit, ["project_id", "id"], "left").fillna(0, ["n_tests"])


def untested(covered: DataFrame) -> DataFrame:
    """Issues of routes that no test observation reaches, from coverage()."""
    return covered.filter("n_tests = 0").select("project_id", "id", F.lit("route-without-test").alias("kind"), F.lit("warning").alias("severity"), F.lit(0).cast("bigint").alias("candidates"))


def drift_issues(drifted: DataFrame) -> DataFrame:
    """Issues of matched pairs that disagree, from drift(): one for each pair and kind."""
    return drifted.select("project_id", F.col("client_id").alias("id"), "kind", F.lit("error").alias("severity"), F.lit(1).cast("bigint").alias("candidates"))


def summary(projects: DataFrame, clients: DataFrame, routes: DataFrame, matched: DataFrame, issues: DataFrame, covered: DataFrame, unknown: DataFrame) -> DataFrame:
    """The thirteen counters of each project of projects(project_id)."""
    per = lambda df, **aggs: df.groupBy("project_id").agg(*[v.alias(k) for k, v in aggs.items()])
    is_ = lambda kind: F.count_if(F.col("kind") == kind)
    parts = (
        per(clients, client_calls=F.count("*")), per(routes, server_routes=F.count("*")), per(matched.filter("method_ok"), matches=F.count("*")),
        per(
            issues, missing_routes=is_("missing-route"), method_mismatches=is_("method-mismatch"), request_schema_mismatches=is_("request-schema-mismatch"),
            response_schema_mismatches=is_("response-schema-mismatch"), missing_auth=is_("missing-auth"), status_mismatches=is_("status-mismatch"), no_local_consumers=is_("no-local-consumer"),
        ),
        per(covered, routes_with_tests=F.count_if(F.col("n_tests") > 0), routes_without_tests=F.count_if(F.col("n_tests") == 0)), per(unknown, unknowns=F.count("*")),
    )
    df = projects.select("project_id").distinct()
    for part in parts:
        df = df.join(part, "project_id", "left")
    return df.fillna(0)


def by_severity(issues: DataFrame) -> DataFrame:
    """(project_id, severity, kind, n): the issues' partition."""
    return issues.groupBy("project_id", "severity", "kind").agg(F.count("*").alias("n"))


def _icu(c: str):
    return F.collate(c, "UNICODE")


def endpoint_order(endpoints: DataFrame) -> DataFrame:
    return endpoints.orderBy("project_id", _icu("file"), "line", _icu("method"), _icu("path"), "id")


def issue_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy("project_id", _icu("kind"), _icu("id"))


def match_order(matched: DataFrame) -> DataFrame:
    return matched.orderBy("project_id", _icu("client_id"), _icu("route_id"))


def unknown_order(unknown: DataFrame) -> DataFrame:
    return unknown.orderBy("project_id", _icu("file"), "line", _icu("expression"))


def _loops(mounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mounts in circles, climbed from each of their receivers to where the climb leaves the circle or
    meets itself: (the mounts that lead to each receiver from outside its circle, with the whole prefix;
    the prefixes of climbs that met themselves). Written."""
    inner = mounts.filter("_circle = _own").select("project_id", F.col("child").alias("at"), "parent", F.col("prefix").alias("_p"))
    outer = mounts.filter("_own is not null and not _circle <=> _own").select("project_id", F.col("child").alias("at"), F.col("parent").alias("_from"), F.col("prefix").alias("_p"))
    starts = mounts.filter("_own is not null").select("project_id", F.col("child").alias("receiver")).distinct()
    front = stored(starts.select("project_id", "receiver", F.col("receiver").alias("at"), F.lit("/").alias("prefix"), F.array("receiver").alias("seen")))
    left, met = [], []
    while front.limit(1).count():
        left.append(stored(front.join(outer, ["project_id", "at"]).select("project_id", F.col("_from").alias("parent"), F.col("receiver").alias("child"), P.join_http(F.col("_p"), F.col("prefix")).alias("prefix")).distinct()))
        step = front.join(inner, ["project_id", "at"]).withColumn("prefix", P.join_http(F.col("_p"), F.col("prefix")))
        step = stored(step.select("project_id", "receiver", F.col("parent").alias("at"), "prefix", "seen", F.array_contains("seen", F.col("parent")).alias("over")).distinct())
        met.append(stored(step.filter("over").select("project_id", "receiver", "prefix").distinct()))
        new = stored(step.filter("not over").select("project_id", "receiver", "at", "prefix", F.concat("seen", F.array("at")).alias("seen")))
        dropped(front, step)
        front = new
    every = lambda parts, like: reduce(DataFrame.unionByName, parts, like).distinct()
    empty = mounts.limit(0)
    return every(left, empty.select("project_id", "parent", "child", "prefix")), every(met, empty.select("project_id", F.col("child").alias("receiver"), "prefix"))


def mount_prefixes(mounts: DataFrame) -> DataFrame:
    """(project_id, receiver, prefix): every prefix under which a receiver is reached. Mounts are
    project_id, parent, child, prefix.

    Prefixes go down from the receivers that nothing mounts, round by round, and only what the last round
    has found goes on; ways that give a receiver the same prefix are one from there, so stacked
    diamonds stay small. A receiver in a circle is climbed from inside the circle first, once through each
    receiver: a climb ends where it meets itself, which counts as a start, and where it leaves the circle
    it is a mount from there. What is left has no circle, so rounds are as many as mounts are nested."""
    every = mounts.select("project_id", F.col("parent").alias("receiver")).unionByName(mounts.select("project_id", F.col("child").alias("receiver"))).distinct()
    edges = stored(mounts.select("project_id", "parent", "child", "prefix").distinct())
    circles = G.scc(edges.select("project_id", F.col("parent").alias("src"), F.col("child").alias("dst")))
    pairs = edges.select("project_id", F.col("parent").alias("src"), F.col("child").alias("dst")).distinct()
    within = G.in_cycles(pairs, circles)
    known = stored(circles.join(within, ["project_id", "id"], "left_semi").select("project_id", "id", "scc"))
    side = lambda df, c, name: df.join(known.select("project_id", F.col("id").alias(c), F.col("scc").alias(name)), ["project_id", c], "left")
    marked = stored(side(side(edges, "parent", "_circle"), "child", "_own"))
    plain = marked.filter("_own is null").select("project_id", "parent", "child", "prefix")
    roots = every.join(edges.select("project_id", F.col("child").alias("receiver")).distinct(), ["project_id", "receiver"], "left_anti").select("project_id", "receiver", F.lit("/").alias("prefix"))
    if known.limit(1).count():
        through, met = _loops(marked)
        plain, roots = plain.unionByName(through), roots.unionByName(met)
    down = stored(plain.select("project_id", F.col("parent").alias("receiver"), "child", F.col("prefix").alias("_p")).distinct())
    front = stored(roots.distinct())
    parts = [front]
    while front.limit(1).count():
        step = front.join(down, ["project_id", "receiver"]).select("project_id", F.col("child").alias("receiver"), P.join_http(F.col("prefix"), F.col("_p")).alias("prefix")).distinct()
        front = stored(step)
        parts.append(front)
    dropped(edges, known, marked, down)
    return reduce(DataFrame.unionByName, parts).distinct()


def mounted(drafts: DataFrame, prefixes: DataFrame, path: str = "path") -> DataFrame:
    """Route drafts (with receiver and path) at each of their prefixes; unmounted ones stay as they are."""
    df = drafts.join(prefixes, ["project_id", "receiver"], "left")
    return df.withColumn(path, P.join_http(F.coalesce("prefix", F.lit("/")), F.col(path))).drop("prefix")


def radar_gate(issues: DataFrame, n_unknown: DataFrame, allow_unknown: bool = False) -> DataFrame:
    """One row. issues has severity; n_unknown is one row with `unknowns`."""
    df = issues.agg(F.count_if(F.col("severity") == "error").alias("errors")).crossJoin(n_unknown.select("unknowns"))
    return _gate(df, "radar", allow_unknown)
