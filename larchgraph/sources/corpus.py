"""Source trees and payloads as source_files(project_id, path, content), limits, and saved projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larchgraph.functions import paths as P
from larchgraph.operators.policy import ranged_digest
from larchgraph.operators.running import running_sums

# Limits of one project.
MAX_FILES, MAX_TOTAL, MAX_FILE, MAX_PATH = 1500, 40 * 1024 * 1024, 800_000, 2048


class LimitError(ValueError):
    """A project is over a limit; `code` says which."""

    def __init__(self, code: str, status: int = 413):
        super().__init__(code)
        self.code, self.status = code, status


def _below(root: str) -> Column:
    at = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.substring(at, F.length(F.lit(base)) + 1, F.length(at))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(at, path, bytes) of the source files under a folder that are small enough: no content is read,
    and ignored folders and declarations are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = raw.filter(F.col("length") <= MAX_FILE).select(F.col("path").alias("at"), _below(root).alias("path"), F.col("length").alias("bytes"))
    return df.filter(P.is_source(F.col("path")) & ~P.is_ignored(F.col("path")))


def read_tree(spark: SparkSession, root: str, project_id: str = "p", on_limit: str = "error") -> DataFrame:
    """Source files under a folder, with paths relative to it, in path order. Any store that Spark
    reads will do. The listing comes first; only files that are kept are opened.

    A tree over MAX_FILES files or MAX_TOTAL bytes is a LimitError, or, with on_limit="truncate", is
    read as far as the limits go."""
    found = listing(spark, root).orderBy("path").limit(MAX_FILES + 1).collect()
    if len(found) > MAX_FILES and on_limit == "error":
        raise LimitError("tooManyFiles")
    kept, total = [], 0
    for r in found[:MAX_FILES]:
        if total + r["bytes"] > MAX_TOTAL:
            if on_limit == "error":
                raise LimitError("projectTooLarge")
            break
        total += r["bytes"]
        kept.append(r["at"])
    schema = "project_id string, path string, content string"
    if not kept:
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").load(kept)
    df = raw.select(F.lit(project_id).alias("project_id"), _below(root).alias("path"), F.decode("content", "UTF-8").alias("content"))
    return df.orderBy("path")


def source_files(spark: SparkSession, files: DataFrame | None = None, path: str | None = None, root: str | None = None, project_id: str = "p") -> DataFrame:
    """Given files win, then a path, then the root that the session was started with."""
    if files is not None and files.limit(1).count():
        return check_limits(files)
    if not (path or root):
        raise ValueError("files or a path are needed")
    df = read_tree(spark, path or root, project_id)
    if not df.limit(1).count():
        raise ValueError(f"no source files under {path or root}")
    return df


def check_limits(files: DataFrame) -> DataFrame:
    """files, or a LimitError where a project has too many files or bytes."""
    per = files.groupBy("project_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("b"))
    worst = per.agg(F.max("n"), F.max("b")).first()
    if (worst[0] or 0) > MAX_FILES:
        raise LimitError("tooManyFiles")
    if (worst[1] or 0) > MAX_TOTAL:
        raise LimitError("projectTooLarge")
    return files


def running_limit(files: DataFrame, most_bytes: int = MAX_TOTAL, size: str = "bytes", order: tuple[str, ...] = ("path",)) -> DataFrame:
    """files, in path order, or one that also tells equal paths apart, with `total` so far and `kept`: within the byte limit of the project."""
    return running_sums(files, ["project_id"], list(order), {"total": F.col(size)}).withColumn("kept", F.col("total") <= most_bytes)


def validate(payload: DataFrame) -> DataFrame:
    """(ordinal, path, code): the normalised path and what is wrong with each row, or null.

    payload: ordinal, path, content. Backslashes become slashes and paths are trimmed; a null, a
    NUL character or an overlong path is invalid; of equal paths, all after the first are duplicates."""
    path = F.trim(F.translate(F.col("path"), "\\", "/"))
    df = payload.select("ordinal", path.alias("path"), "content")
    bad = F.col("path").isNull() | F.col("content").isNull() | (F.col("path") == "") | F.col("path").contains("\u0000") | (F.length("path") > MAX_PATH)
    # the first of equal paths is found by an aggregate: a path of very many rows is one row
    firsts = df.filter("path is not null").groupBy("path").agg(F.min("ordinal").alias("_first"))
    df = df.join(firsts, "path", "left")
    code = F.when(bad, "invalidFiles").when(F.col("_first") < F.col("ordinal"), "duplicateFilePath").when(F.octet_length("content") > MAX_FILE, "sourceFileTooLarge")
    return df.select("ordinal", "path", code.alias("code"))


def signature(projects: DataFrame) -> DataFrame:
    """(name, signature) of projects(name, path): sha1 of the name and a digest of the distinct paths;
    contents do not count."""
    paths = ranged_digest(projects.select("name", "path").distinct(), ["name"], "path", F.concat("path", F.lit("|")))
    return paths.select("name", F.sha1(F.concat(F.col("name"), F.lit("\u0000"), "digest")).alias("signature"))


def stamped(projects: DataFrame) -> DataFrame:
    """projects with created_at and updated_at: the query's own time, as ISO text in UTC. upsert() keeps
    the earliest created_at of a signature and the latest updated_at."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return projects.withColumns({"created_at": now, "updated_at": now})


def upsert(saved: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each signature: the latest, with the earliest created_at. Columns: id, signature,
    created_at, updated_at and whatever else both have. Rows are aggregated before they are shuffled."""
    every = saved.unionByName(new)
    rest = [c for c in every.columns if c not in ("id", "signature", "created_at")]
    latest = F.max_by(F.struct(*rest), F.struct("updated_at", "id")).alias("_latest")
    found = every.groupBy("signature").agg(latest, F.min("created_at").alias("created_at"), F.min_by("id", F.struct("created_at", "id")).alias("id"))
    return found.select(*[F.col(f"_latest.{c}").alias(c) if c in rest else F.col(c) for c in every.columns])


def listed(saved: DataFrame) -> DataFrame:
    return saved.orderBy(F.desc("updated_at"), "id")


def deleted(saved: DataFrame, ids: list[str]) -> DataFrame:
    return saved.filter(~F.col("id").isin(*ids))


def lookup(saved: DataFrame, project_id: str) -> DataFrame:
    return saved.filter(F.col("id") == project_id)
