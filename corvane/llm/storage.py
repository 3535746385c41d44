"""Tables written in the folder that the whole cluster shares.

Long lineages are cut by writing Parquet under ``spark.checkpoint.dir``, so
a lost executor costs a re-read and nothing is recomputed from the start. The
shuffle files of a written table go once it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.sources.shared import stored


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it."""
    return stored(df, name)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these frames; nothing that is yet to run may read them."""
    for df in frames:
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
