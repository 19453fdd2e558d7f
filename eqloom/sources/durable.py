"""Tables written to the shared folder, so that no page is parsed twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, tag: str) -> DataFrame:
    """The table written to the folder in spark.checkpoint.dir and read back (local mode: under /tmp).

    It lasts as long as the session's driver and is deleted with it.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints"
    path = f"{folder.rstrip('/')}/eqloom/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what the plan shuffled is deleted as soon as the table is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def spread(df: DataFrame, key: str, rounds: int = 1) -> DataFrame:
    """A table that comes in fewer parts than there are cores (which means it is small), dealt out by a key.

    With `rounds`, fewer than that many parts a core: long work on a few parts leaves cores idle in its last round.
    A table with the mark `dealt` stays as it is; to count its parts would run the shuffle that dealt it out.
    """
    if "dealt" in vars(df):
        return df
    parts = rounds * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < parts else df


def drop(df: DataFrame) -> None:
    """Delete a table that keep wrote, once whatever needed it has been written itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
