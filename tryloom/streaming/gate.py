"""A gate in front of the stateful streams: what comes too late is counted, the rest is landed for them.

Spark's state operators drop rows behind the watermark without a trace of whose
they were. The gate splits each batch by the same rule, against the greatest time
of all batches before it, and keeps three folders, each with one part a batch:
``rows`` (what came in time), ``late`` (how many late ones of each build) and
``clock`` (the greatest time so far). A batch that is run again after a failure
replaces its own parts, so counts survive restarts and no row is counted twice.
A row that is landed twice by such a batch is a repetition, which the streams
behind the gate leave out.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DELAY_S = 60.0


def _clock(spark: SparkSession, path: str, number: int) -> datetime | None:
    """The greatest time of all batches up to ``number``."""
    return None if number < 0 else spark.read.schema("ts timestamp").parquet(f"{path}/clock/batch={number}").first()["ts"]


def gated(rows: DataFrame, path: str, checkpoint: str, delay_s: float = DELAY_S, prepare: Callable[[DataFrame], DataFrame] | None = None, key: str = "build_id", **start: str) -> StreamingQuery:
    """Starts the gate on a stream with ``key`` and ``ts``. ``prepare`` is applied to the rows of a batch that came in time, before they are landed."""

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _clock(spark, path, number - 1)
        bar = F.lit(before) - F.make_dt_interval(secs=F.lit(delay_s)) if before else F.lit(None).cast("timestamp")
        held = batch.withColumn("_late", F.coalesce(F.col("ts") <= bar, F.lit(False))).persist()
        try:
            late = held.where("_late").groupBy(key).agg(F.count("*").alias("late"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            good = held.where("NOT _late").drop("_late")
            (prepare(good) if prepare else good).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            good.agg(F.greatest(F.max("ts"), F.lit(before).cast("timestamp")).alias("ts")).write.mode("overwrite").parquet(f"{path}/clock/batch={number}")
        finally:
            held.unpersist()

    writer = rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(**start) if start else writer).start()


def accepted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The landed rows as a stream."""
    return spark.readStream.schema(schema).parquet(f"{path}/rows/*")


def late_counts(spark: SparkSession, path: str, key: str = "build_id") -> DataFrame:
    """``key``, how many rows of it came too ``late`` so far, and the time of the first and the last of them."""
    try:
        found = spark.read.parquet(f"{path}/late/*")
    except AnalysisException:  # no batch yet
        found = spark.createDataFrame([], f"{key} string, late long, first_ts timestamp, last_ts timestamp")
    return found.groupBy(key).agg(F.sum("late").alias("late"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
