"""Operator 2: URL filter by a path-template tree.

Explicit rules come first, and their verdicts are the labels of the pages they fit. Each host's
paths form a tree. Segments that vary by their form (numbers, hashes, mixed tokens) are wildcards
at once. Then, level by level, segments that are each a small part of many are generalised into
`*`, and sibling branches merge:

- Branches with labels stand in order of their blocked share of labelled pages; a two-proportion
  test merges neighbours that do not differ significantly. Unlabelled pages are no evidence.
- A branch without labels says nothing against any of them: it joins the labelled sibling whose
  paths go on most alike (mean number of segments below; then the one with most labels, then the
  least name). Where no sibling has a label, branches stay apart.

A template is rejected where its smoothed share of blocked pages among labelled ones is at least
PURITY; so labels reach pages that no rule fits, where enough of them agree. Templates without
labels are allowed.

Levels beyond the tree's depth, DEPTH or one more than the deepest rule has, are one segment, `**`.
Work on the tree is on counts of distinct generalised paths, summed before any shuffle; a parent
has 1 / FEW + MANY branches at most when they are compared. A null url, or one without ://, has
empty host and path, fits no rule and belongs to the empty host's tree. Repeated rows are judged
alike, and count. Columns besides key and url are ignored; an empty table stays empty.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larchgraph.llm.common import ascii_lower, dropped, stored

DEPTH = 4
#: A segment is generalised where its parent has over MANY distinct segments and it has under FEW of the pages.
MANY, FEW = 20, 0.05
#: Branches merge where their blocked shares are within Z standard errors; purity is smoothed with STRENGTH pseudo-pages at PRIOR.
Z, STRENGTH, PRIOR, PURITY = 2.0, 4.0, 0.5, 0.8


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def shapes(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments with those that vary by form as wildcards, at most depth and `**`."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")

    def shape(x: Column) -> Column:
        stem, ending = F.regexp_extract(x, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(x, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        kind = (
            F.when(stem.rlike(r"^[0-9]+$"), "{n}")
            .when(stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "{hex}")
            .when(stem.rlike(r"[0-9].*[0-9].*[0-9]") | (F.length(stem) > 40), "{mix}")
            .otherwise(stem)
        )
        return F.concat(kind, ending)

    shaped = F.transform(F.slice(parts, 1, depth), shape)
    return F.when(F.size(parts) > depth, F.concat(shaped, F.array(F.lit("**")))).otherwise(shaped)


def deep_enough(rules: tuple[Rule, ...]) -> int:
    return max([DEPTH, *(len([x for x in r.path.split("/") if x]) + 1 for r in rules)])


def _merged(branch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gen and own: the name of each generalised branch after merging with its siblings.
    branch: keys, gen, n, blocked, allowed and below (segments below, summed over pages)."""
    df = branch.withColumn("m", F.col("blocked") + F.col("allowed")).withColumn("share", F.when(F.col("m") > 0, F.col("blocked") / F.col("m")))
    ranked = Window.partitionBy(*keys).orderBy(F.col("share").asc_nulls_last(), "gen")
    last = lambda c: F.lag(c).over(ranked)
    # add-one counts keep the error of shares of 0 or 1 from being 0
    pooled = (F.col("blocked") + last("blocked") + 1) / (F.col("m") + last("m") + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("m") + 1 / last("m")))
    apart = F.when(last("share").isNull() | (F.abs(F.col("share") - last("share")) > Z * error), 1).otherwise(0)
    df = df.withColumn("_apart", F.when(F.col("m") > 0, apart))
    df = df.withColumn("_group", F.when(F.col("m") > 0, F.sum("_apart").over(ranked.rowsBetween(Window.unboundedPreceding, 0))))
    at = F.col("below") / F.col("n")
    known = F.collect_list(F.when(F.col("m") > 0, F.struct(at.alias("at"), "m", "gen", "_group"))).over(Window.partitionBy(*keys))
    df = df.withColumn("_known", known).withColumn("_at", at)
    nearest = F.array_min(F.transform("_known", lambda x: F.struct(F.abs(x["at"] - F.col("_at")).alias("d"), (-x["m"]).alias("m"), x["gen"].alias("gen"), x["_group"].alias("g"))))["g"]
    df = df.withColumn("_group", F.coalesce("_group", nearest))
    own = Window.partitionBy(*keys, "_group")
    alone = F.col("_group").isNull() | (F.count("*").over(own) == 1)
    name = F.when(~alone, F.concat(F.lit("/~"), F.min("gen").over(own))).when(F.col("gen") == "", "").otherwise(F.concat(F.lit("/"), "gen"))
    return df.select(*keys, "gen", name.alias("own"))


def tree(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, segments, template, purity, verdict from (host, segments, n, blocked, allowed) counts."""
    state = stored(paths.withColumn("template", F.lit("")))
    keys = ["host", "template"]
    for level in range(depth + 1):
        state_now = state.withColumn("_seg", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        below = F.sum(F.col("n") * F.greatest(F.size("segments") - level - 1, F.lit(0))).alias("below")
        branch = state_now.groupBy(*keys, "_seg").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"), below)
        parent = branch.groupBy(*keys).agg(F.count("*").alias("_kinds"), F.sum("n").alias("_n"))
        varied = (F.col("_kinds") > MANY) & (F.col("n") < F.col("_n") * FEW)
        branch = stored(branch.join(parent, keys).withColumn("gen", F.when(varied & (F.col("_seg") != ""), "*").otherwise(F.col("_seg"))))
        sums = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed", "below")]
        names = _merged(branch.groupBy(*keys, "gen").agg(*sums), keys)
        own = branch.select(*keys, "_seg", "gen").join(names, [*keys, "gen"]).drop("gen")
        after = state_now.join(own, [*keys, "_seg"]).withColumn("template", F.concat("template", "own"))
        after = stored(after.select(*paths.columns, "template"))
        dropped(state, branch)
        state = after
    per = state.groupBy("host", "template").agg(F.sum("blocked").alias("_b"), F.sum("allowed").alias("_a"))
    purity = (F.col("_b") + STRENGTH * PRIOR) / (F.col("_b") + F.col("_a") + STRENGTH)
    per = per.select("host", "template", purity.alias("purity")).withColumn("verdict", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return state.select("host", "template", "segments").join(per, ["host", "template"])


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, depth: int = 0) -> DataFrame:
    """key, host, path, rule, verdict, template and purity of every page."""
    depth = depth or deep_enough(rules)
    host, path = host_and_path(F.col(url))
    df = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "_ruled": verdict, "segments": shapes(F.col("path"), depth)})
    counts = df.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count_if(F.col("_ruled") == "block").alias("blocked"), F.count_if(F.col("_ruled") == "allow").alias("allowed")
    )
    known = tree(counts, depth)
    # one row of the tree for each (host, segments); a hot host's pages are the side that may be split
    df = df.join(known, ["host", "segments"], "left")
    return df.select(key, "host", "path", "rule", F.coalesce("_ruled", "verdict").alias("verdict"), "template", "purity")
