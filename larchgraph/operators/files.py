"""Import health and file graph over
files(project_id, path, exports, shebang, parse_error) and imports(project_id, path, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchgraph.functions import paths as P
from larchgraph.functions.tables import dealt
from larchgraph.operators import graph as G

KEY = ["project_id", "path"]


def resolve(specs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imports, unresolved) of specs(project_id, path, spec). Bare packages are left out; a relative
    specifier that no file answers is unresolved, unless it names an asset."""
    wanted = specs.filter(P.is_relative(F.col("spec"))).distinct().withColumn("_base", P.join_relative(F.col("path"), F.col("spec")))
    tried = wanted.select(*KEY, "spec", F.posexplode(F.concat(*[F.array(F.concat("_base", F.lit(s))) for s in P.SUFFIXES])).alias("_n", "target"))
    known = files.select("project_id", F.col("path").alias("target")).distinct()
    found = tried.join(dealt(known), ["project_id", "target"]).groupBy(*KEY, "spec").agg(F.min_by("target", "_n").alias("target"))
    lost = wanted.filter(~F.col("spec").rlike(P.ASSET_NAME)).join(dealt(found), [*KEY, "spec"], "left_anti").select(*KEY, "spec").distinct()
    return found.select(*KEY, "target").distinct(), lost


def _counts(imports: DataFrame, files: DataFrame) -> DataFrame:
    good = imports.join(dealt(files.filter("not parse_error").select(*KEY)), KEY, "left_semi").select(*KEY, "target").distinct()
    into = good.groupBy("project_id", F.col("target").alias("path")).agg(F.count("*").alias("imported_by"))
    out = good.groupBy(*KEY).agg(F.count("*").alias("imports"))
    return files.join(dealt(into), KEY, "left").join(dealt(out), KEY, "left").fillna(0, ["imported_by", "imports"])


def health(files: DataFrame, imports: DataFrame, unresolved: DataFrame) -> DataFrame:
    """files with imports, imported_by (a file's import of itself counts), verdict, confidence,
    entry_reason and n_unresolved. A parse error outranks an entry name."""
    lost = unresolved.groupBy(*KEY).agg(F.count("*").alias("n_unresolved"))
    df = _counts(imports, files).join(lost, KEY, "left").fillna(0, ["n_unresolved"])
    df = df.withColumn("entry_reason", F.when(~F.col("parse_error"), P.entry_reason(F.col("path"), F.col("shebang"))))
    verdict = F.when(F.col("parse_error"), "parse-error").when(F.col("entry_reason").isNotNull(), "entry").when(F.col("imported_by") == 0, "possibly-unused").otherwise("ok")
    df = df.withColumn("verdict", verdict)
    sure = F.lit(55) + F.when(F.col("exports") > 0, 15).otherwise(0) + F.when(F.col("imports") == 0, 10).otherwise(0)
    df = df.withColumn("confidence", F.when(F.col("verdict") == "possibly-unused", F.least(F.lit(85), sure)).cast("int"))
    unused = F.col("verdict") == "possibly-unused"
    evidence = F.array(
        F.when(unused, "imported-by-none"), F.when(unused, "not-an-entry"), F.when(unused & (F.col("exports") > 0), "exports-unused"),
        F.when(unused & (F.col("exports") == 0), "exports-none"), F.when(unused & (F.col("imports") == 0), "isolated"), F.when(unused & (F.col("n_unresolved") > 0), "broken-imports"),
    )
    return df.withColumn("evidence", F.filter(evidence, lambda x: x.isNotNull()))


def health_order(df: DataFrame) -> DataFrame:
    rank = F.when(F.col("verdict") == "possibly-unused", 0).when(F.col("verdict") == "parse-error", 1).when(F.col("verdict") == "ok", 2).otherwise(3)
    return df.orderBy(rank, F.desc(F.coalesce("confidence", F.lit(0))), F.collate("path", "UNICODE"))


def health_summary(df: DataFrame) -> DataFrame:
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    return df.groupBy("project_id").agg(
        F.count("*").alias("files"), is_("entry").alias("entry_points"), is_("possibly-unused").alias("possibly_unused"), is_("parse-error").alias("parse_errors"), F.sum("n_unresolved").alias("unresolved_imports")
    )


def file_graph(files: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). A file's import of itself is no edge, but puts the file in a cycle."""
    good = imports.join(dealt(files.filter("not parse_error").select(*KEY)), KEY, "left_semi").select("project_id", F.col("path").alias("src"), F.col("target").alias("dst")).distinct()
    own = good.filter("src = dst").select("project_id", F.col("src").alias("path")).withColumn("_self", F.lit(True))
    edges = good.filter("src <> dst")
    comp = G.scc(edges)
    marked = G.cycle_edges(edges, comp)
    cyc = G.in_cycles(edges, comp).withColumnRenamed("id", "path").withColumn("_cyc", F.lit(True))
    df = _counts(edges.withColumnsRenamed({"src": "path", "dst": "target"}), files).join(dealt(own), KEY, "left").join(dealt(cyc), KEY, "left").fillna(False, ["_self", "_cyc"])
    df = df.withColumn("in_cycle", F.col("_self") | F.col("_cyc"))
    entry = P.entry_reason(F.col("path"), F.col("shebang")).isNotNull()
    df = df.withColumn("kind", F.when(entry, "entry").when(F.col("imported_by") == 0, "orphan").otherwise("normal"))
    return labelled(df).drop("_self", "_cyc"), marked


def labelled(df: DataFrame) -> DataFrame:
    """df with label: the base name, or folder/base name where a project has it more than once. Names
    are counted before the join, so a name of very many files is one row."""
    df = df.withColumn("_base", P.basename(F.col("path")))
    many = df.groupBy("project_id", "_base").count().filter("count > 1").select("project_id", "_base", F.lit(True).alias("_many"))
    parent = P.basename(P.dir_of(F.col("path")))
    label = F.when(F.col("_many") & (parent != ""), F.concat(parent, F.lit("/"), "_base")).otherwise(F.col("_base"))
    return df.join(many, ["project_id", "_base"], "left").withColumn("label", label).drop("_base", "_many")


def graph_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("project_id", F.desc("in_cycle"), F.desc("imported_by"), F.collate("path", "UNICODE"))


def edge_order(edges: DataFrame) -> DataFrame:
    return edges.orderBy("project_id", F.collate("src", "UNICODE"), F.collate("dst", "UNICODE"))


def graph_summary(nodes: DataFrame, edges: DataFrame, imports: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(project_id, files, edges, cycles, files_in_cycle, entries, orphans, unresolved_imports)."""
    per = nodes.groupBy("project_id").agg(
        F.count("*").alias("files"), F.count_if("in_cycle").alias("files_in_cycle"), F.count_if(F.col("kind") == "entry").alias("entries"), F.count_if(F.col("kind") == "orphan").alias("orphans")
    )
    n = edges.groupBy("project_id").agg(F.count("*").alias("edges"))
    lost = unresolved.groupBy("project_id").agg(F.count("*").alias("unresolved_imports"))
    out = per.join(n, "project_id", "left").join(file_cycles(nodes, edges, imports), "project_id", "left").join(lost, "project_id", "left").fillna(0)
    return out.select("project_id", "files", "edges", "cycles", "files_in_cycle", "entries", "orphans", "unresolved_imports")


def file_cycles(nodes: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    good = imports.join(dealt(nodes.filter("not parse_error").select(*KEY)), KEY, "left_semi") if "parse_error" in nodes.columns else imports
    own = good.filter("path = target").select("project_id", F.col("path").alias("src"), F.col("target").alias("dst"))
    comp = G.scc(edges.select(*G.PAIR))
    return G.cycle_count(edges.select(*G.PAIR).unionByName(own), comp)


def as_graph(nodes: DataFrame) -> DataFrame:
    """File nodes in the shape of function nodes."""
    level = F.when(F.col("in_cycle"), "hot").when(F.col("kind") == "orphan", "warn").otherwise("ok")
    return nodes.select(
        "project_id", F.col("path").alias("id"), (F.col("imports") + F.col("imported_by")).alias("complexity"), F.col("imported_by").alias("fan_in"), F.col("imports").alias("fan_out"),
        "in_cycle", level.alias("level"), (F.col("imported_by") * 2 + F.col("imports")).alias("score"),
    )
