"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder below ``spark.checkpoint.dir`` that this application's executors share.

    Where that is unset, a local session takes a temporary folder; on a cluster it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return context._jsc.sc().getCheckpointDir().get()


def own_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which is deleted when the driver's JVM ends."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(root)
    system.deleteOnExit(root)
    return f"{root.toString()}/data"


def settled(df: DataFrame) -> DataFrame:
    """``df`` after a reliable checkpoint below ``shared_root``."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as it was written below ``shared_root``, for rows that are read several times, each time by a few columns."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
