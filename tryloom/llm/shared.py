"""Folders and small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a local session
    (as in tests) takes a temporary folder; on a cluster it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return context._jsc.sc().getCheckpointDir().get()


#: This driver's folder below the shared one.
_OWN = f"tables-{uuid.uuid4().hex}"


def folder(spark: SparkSession) -> str:
    """Where this driver's intermediate tables lie: below the shared folder. It is deleted when the driver's JVM ends."""
    path = f"{checkpoint_root(spark)}/{_OWN}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        system.mkdirs(at)
        system.deleteOnExit(at)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this driver; results that still read them must have been written before."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage, survives the loss of an executor, and lets later
    reads prune columns. The table goes when the driver ends, or with ``clear``.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of texts in a batch that Spark hands to Python at once.
TEXT_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Within it, jobs hand at most ``rows`` rows to Python at once; after it, the session is as before.

    For steps that are written at once: Spark reads the setting when a job runs.
    """
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many rows of 64-bit ids (8 MB) are broadcast.
IDS_BROADCAST = 1_000_000


def id_side(ids: DataFrame, most: int = IDS_BROADCAST) -> DataFrame:
    """``ids`` marked for the inner side of a join: broadcast if their counted number is at most ``most``, else hashed by partition."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids.hint("shuffle_hash")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
