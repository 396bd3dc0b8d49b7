"""Before/after verification: facts of two snapshots, nine checks, an overall status, digests.

facts(snapshot_id, kind, key) holds what each snapshot has: function, cycle-function, hotspot,
file, script (a file that can be analysed), cycle-file, unresolved and parse-error.
files(snapshot_id, path, content) is the text; a path that a snapshot has more than once needs an ordinal,
which tells the order of its texts in digests.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larchgraph.functions import paths as P
from larchgraph.functions.tables import dealt, stored

EVIDENCE = 50
#: Paths of a digest's range, as hex digits of the path's own digest.
RANGE_DIGITS = 4
#: Names of limits in policy files.
LIMITS = {"maxNewUnresolvedImports": "max_new_unresolved", "maxNewFilesInCycles": "max_new_file_cycles", "maxNewFunctionsInCycles": "max_new_function_cycles", "maxNewHotspots": "max_new_hotspots"}


@dataclass(frozen=True)
class Policy:
    allow_files: tuple[str, ...] = ()
    allow_functions: tuple[str, ...] = ()
    preserve_files: tuple[str, ...] = ()
    preserve_functions: tuple[str, ...] = ()
    max_new_unresolved: int = 0
    max_new_file_cycles: int = 0
    max_new_function_cycles: int = 0
    max_new_hotspots: int = 0
    name: str = ""
    #: The policy in a fixed order, for the digest.
    text: str = field(init=False, default="")

    def __post_init__(self):
        path = lambda x: re.sub("^/", "", re.sub(r"^\./", "", x.strip().replace("\\", "/")))
        fid = lambda x: path(x.split("#", 1)[0]) + "#" + x.strip().split("#", 1)[1] if "#" in x else x.strip()
        for f, normal in (("allow_files", path), ("allow_functions", fid), ("preserve_files", path), ("preserve_functions", fid)):
            object.__setattr__(self, f, tuple(sorted({normal(x) for x in getattr(self, f) if normal(x)})))
        object.__setattr__(self, "name", self.name.strip() or "unnamed-change")
        limits = {k: getattr(self, k) for k in LIMITS.values()}
        for k, v in limits.items():
            if not isinstance(v, int) or isinstance(v, bool) or v < 0:
                raise ValueError(f"{k} must be a non-negative integer")
        lists = {f: list(getattr(self, f)) for f in ("allow_files", "allow_functions", "preserve_files", "preserve_functions")}
        object.__setattr__(self, "text", json.dumps({"name": self.name, **lists, **limits}, separators=(",", ":"), ensure_ascii=False))

    @classmethod
    def from_json(cls, data: dict) -> Policy:
        """A policy of the nested shape of policy files: name, allow, preserve, limits. Parts that are
        missing have their defaults; what is no object, list of texts or number is an error."""
        part = lambda name: data.get(name) or {}
        if not isinstance(data, dict) or any(not isinstance(part(n), dict) for n in ("allow", "preserve", "limits")):
            raise ValueError("a policy is an object with the objects allow, preserve and limits")
        lists = {"allow_files": part("allow").get("removedFiles"), "allow_functions": part("allow").get("removedFunctions"), "preserve_files": part("preserve").get("files"), "preserve_functions": part("preserve").get("functions")}
        for k, v in lists.items():
            if v is not None and (not isinstance(v, list) or any(not isinstance(x, str) for x in v)):
                raise ValueError(f"{k} must be a list of texts")
        limits = {LIMITS[k]: v for k, v in part("limits").items() if k in LIMITS and v is not None}
        return cls(name=str(data.get("name") or ""), **{k: tuple(v or ()) for k, v in lists.items()}, **limits)


#: Each check: what makes it fail (kind of evidence), and whether incomplete snapshots leave it open.
CHECKS = (
    ("analysis-complete", "unreadable", None, True),
    ("removed-files-declared", "undeclared-file", None, False),
    ("removed-functions-declared", "undeclared-function", None, True),
    ("preserved-files-exist", "lost-file", None, False),
    ("preserved-functions-exist", "lost-function", None, True),
    ("unresolved-import-budget", "new-unresolved", "max_new_unresolved", True),
    ("file-cycle-budget", "new-cycle-file", "max_new_file_cycles", True),
    ("function-cycle-budget", "new-cycle-function", "max_new_function_cycles", True),
    ("hotspot-budget", "new-hotspot", "max_new_hotspots", True),
)


def snapshot_diff(files: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified, with content compared by digest."""
    side = lambda s: files.filter(F.col("snapshot_id") == s).select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias(s))
    both = side("before").join(side("after"), "path", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def deltas(facts: DataFrame) -> DataFrame:
    """(kind, key, change): facts that only one snapshot has."""
    per = facts.groupBy("kind", "key").agg(F.max(F.col("snapshot_id") == "before").alias("b"), F.max(F.col("snapshot_id") == "after").alias("a"))
    return per.filter("a <> b").select("kind", "key", F.when(F.col("a"), "added").otherwise("removed").alias("change"))


def _listed(spark: SparkSession, kind: str, keys: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(kind, k) for k in keys], "kind string, key string")


def evidence(facts: DataFrame, policy: Policy) -> DataFrame:
    """(what, key): every fact that counts against some check."""
    spark, d = facts.sparkSession, deltas(facts)
    new = d.filter("change = 'added' and kind in ('unresolved', 'cycle-file', 'cycle-function', 'hotspot')")
    out = new.select(F.concat(F.lit("new-"), "kind").alias("what"), "key")
    allowed = _listed(spark, "file", policy.allow_files).unionByName(_listed(spark, "function", policy.allow_functions))
    lost = d.filter("change = 'removed' and kind in ('file', 'function')").join(dealt(allowed), ["kind", "key"], "left_anti")
    out = out.unionByName(lost.select(F.concat(F.lit("undeclared-"), "kind").alias("what"), "key"))
    broken = facts.filter("kind = 'parse-error'").select(F.lit("unreadable").alias("what"), F.concat("snapshot_id", F.lit(": "), "key").alias("key"))
    out = out.unionByName(broken)
    wanted = _listed(spark, "file", policy.preserve_files).unionByName(_listed(spark, "function", policy.preserve_functions))
    after = facts.filter("snapshot_id = 'after'").select("kind", "key")
    missing = wanted.join(dealt(after), ["kind", "key"], "left_anti")
    return out.unionByName(missing.select(F.concat(F.lit("lost-"), "kind").alias("what"), "key"))


def sample(values: Column, limit: int = EVIDENCE) -> Column:
    """The first of a sorted list, and one marker that says how many more there are."""
    more = F.concat(F.lit("... "), (F.size(values) - limit).cast("string"), F.lit(" more"))
    return F.when(F.size(values) <= limit, values).otherwise(F.concat(F.slice(values, 1, limit), F.array(more)))


def completeness(facts: DataFrame) -> DataFrame:
    """One row, complete: both snapshots have files that can be analysed, and no parse error."""
    has = lambda s: F.coalesce(F.max((F.col("snapshot_id") == s) & (F.col("kind") == "script")), F.lit(False))
    broken = F.coalesce(F.max(F.col("kind") == "parse-error"), F.lit(False))
    return facts.agg((has("before") & has("after") & ~broken).alias("complete"))


def checks(facts: DataFrame, policy: Policy, limit: int = EVIDENCE) -> DataFrame:
    """(id, status, n, evidence) of the nine checks. Evidence keeps the least `limit` keys: ranked
    inside each kind before they are gathered, so no row holds more."""
    facts = stored(facts)  # read five times below
    spark, found = facts.sparkSession, evidence(facts, policy)
    counts = found.groupBy("what").agg(F.count("*").alias("n"))
    w = Window.partitionBy("what").orderBy("key")
    first = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).groupBy("what").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    rows = [(i, what or "", getattr(policy, most) if most else 0, open_) for i, what, most, open_ in CHECKS]
    table = spark.createDataFrame(rows, "id string, what string, most int, open boolean")
    df = table.join(counts, "what", "left").join(first, "what", "left").fillna(0, ["n"]).crossJoin(completeness(facts))
    status = (
        F.when(F.col("open") & ~F.col("complete"), "unknown").when((F.col("id") != "analysis-complete") & (F.col("n") > F.col("most")), "fail").otherwise("pass")
    )
    marker = F.concat(F.lit("... "), (F.col("n") - limit).cast("string"), F.lit(" more"))
    keys = F.coalesce("keys", F.array().cast("array<string>"))
    return df.select("id", status.alias("status"), "n", F.when(F.col("n") > limit, F.concat(keys, F.array(marker))).otherwise(keys).alias("evidence"))


def overall(checked: DataFrame) -> DataFrame:
    """One row, status and accepted: fail outranks unknown, which outranks pass."""
    any_ = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    df = checked.agg(F.when(any_("fail"), "fail").when(any_("unknown"), "unknown").otherwise("pass").alias("status"))
    return df.withColumn("accepted", F.col("status") == "pass")


def change_gate(checked: DataFrame, allow_unknown: bool = False) -> DataFrame:
    """One row: mode, passed, exit_code, errors, unknowns."""
    df = checked.agg(F.count_if(F.col("status") == "fail").alias("errors"), F.count_if(F.col("status") == "unknown").alias("unknowns"))
    return _gate(df, "change", allow_unknown)


def _gate(df: DataFrame, mode: str, allow_unknown: bool) -> DataFrame:
    passed = (F.col("errors") == 0) & ((F.col("unknowns") == 0) | F.lit(allow_unknown))
    return df.select(F.lit(mode).alias("mode"), passed.alias("passed"), F.when(passed, 0).otherwise(1).alias("exit_code"), "errors", "unknowns")


def ranged_digest(rows: DataFrame, by: list[str], path: str, entry: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """by and `digest`: sha256 over the entries of each group in the order of path and ties, in two steps:
    entries of a range of path digests, then the at most 16 ** RANGE_DIGITS ranges. No task gathers a whole group."""
    entries = rows.select(*by, F.substring(F.sha2(F.col(path), 256), 1, RANGE_DIGITS).alias("_range"), F.struct(path, *ties).alias("_p"), entry.alias("_e"))
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["e"]), "")
    ranges = entries.groupBy(*by, "_range").agg(F.sha2(ordered(F.struct(F.col("_p"), F.col("_e").alias("e"))), 256).alias("_d"))
    return ranges.groupBy(*by).agg(F.sha2(ordered(F.struct("_range", F.col("_d").alias("e"))), 256).alias("digest"))


def files_digest(files: DataFrame, by: str = "snapshot_id") -> DataFrame:
    """(by, digest) over the files' paths and contents."""
    one = F.concat("path", F.lit("\u0000"), F.sha2(F.coalesce("content", F.lit("")), 256), F.lit("\u0000"))
    ties = ("ordinal",) if "ordinal" in files.columns else ()
    return ranged_digest(files, [by], "path", one, ties).withColumn("digest", F.concat(F.lit("sha256:"), "digest"))


def canonical(files: DataFrame) -> DataFrame:
    """files with normal paths; an empty path, or one that a snapshot has twice, is an error."""
    df = files.withColumn("path", P.normal_path(P.trimmed(F.coalesce("path", F.lit("")))))
    wrong = df.groupBy("snapshot_id", "path").count().filter("path = '' or count > 1").orderBy("snapshot_id", "path").first()
    if wrong:
        raise ValueError(f"empty path in snapshot {wrong[0]}" if not wrong[1] else f"snapshot {wrong[0]} has the path {wrong[1]} more than once")
    return df


def unsupported(files: DataFrame) -> DataFrame:
    """(path): files of either snapshot that the analysis does not read, in order."""
    return files.filter(~F.col("path").rlike(P.SCRIPT_NAME)).select("path").distinct().orderBy(F.collate("path", "UNICODE"))


def limitations(files: DataFrame, limit: int = EVIDENCE) -> DataFrame:
    """(line, text): what a certificate does not say, and the files that it does not analyse."""
    out = unsupported(files)
    first = out.limit(limit).agg(F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("some"))
    n = out.agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > limit, F.concat(F.lit(", ... "), (F.col("n") - limit).cast("string"), F.lit(" more"))).otherwise("")
    said = F.when(F.col("n") > 0, F.concat(F.lit("In the digests and the diff, but not in the graphs: "), "some", more))
    lines = F.array(F.lit("Static structure only: equal behaviour is not shown."), F.lit("A renamed or moved function counts as one removed and one added."), said)
    return first.crossJoin(n).select(F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line", "text"))


def fingerprint(files: DataFrame, policy: Policy) -> DataFrame:
    """One row: fingerprint of both snapshots and the policy."""
    d = files_digest(files).groupBy().pivot("snapshot_id", ["before", "after"]).agg(F.first("digest"))
    policy_digest = F.concat(F.lit("sha256:"), F.sha2(F.lit(policy.text), 256))
    text = F.concat_ws("|", F.lit("1"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), policy_digest)
    return d.select(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("fingerprint"))
