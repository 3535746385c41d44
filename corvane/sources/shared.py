"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Makes Spark remove a query's shuffle files at its end; it is read when a frame is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset and the session is one JVM, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="corvane-")
    return _own[app]


def spread(df: DataFrame) -> DataFrame:
    """A table over all cores, if it has fewer partitions than there are; a large one is left as it is read. Not for frames with a shuffle, which would run here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what is used several times is computed once, and survives lost executors. Its folder is ``_stored_at``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        own = df.select("*")
    finally:
        spark.conf.set(CLEANUP, before)
    own.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out
