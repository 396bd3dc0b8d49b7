"""Reading tables and cutting lineage through the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. A local session
    without that setting, as in tests, gets a temporary folder; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own[0]


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder and read back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """df for joins that deal both sides out by key. Spark would else gather a side under its limit in the driver and
    send it to all executors, at every join of every round."""
    return df.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Removes tables that stored() wrote. Only for those that nothing unwritten still reads."""
    for t in tables:
        if path := t.__dict__.pop("stored_at", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table of this name in the shared folder: written if it is not there, else read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
