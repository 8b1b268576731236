"""Order within a corpus, without one task ever holding a whole corpus.

A corpus is cut into blocks of its order. What a window would carry through the
corpus (a running count, the row before) is worked out within blocks, and
between blocks from one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a corpus in a block of its sequence.
BLOCK = 100_000


def number_rows(df: DataFrame, keys: list[str], block: Column, order: list[str], out: str = "seq") -> DataFrame:
    """``out``: the rank, from 0, of a row among those of its ``keys`` by ``order``.

    ``block`` must not decrease along the order; a task sorts one block of one key.
    """
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    ranked = rows.withColumn("_rank", rank).join(starts, [*keys, "_block"])
    return ranked.withColumn(out, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_start", "_rank", "_block")


def _blocks(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(seq) / BLOCK))


def running_count(df: DataFrame, flag: Column, out: str, key: str = "corpus_id", seq: str = "seq") -> DataFrame:
    """``out``: how many rows before this one, in ``seq`` order, have ``flag``."""
    rows = _blocks(df.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long")), seq)
    counts = rows.groupBy(key, "_block").agg(F.sum("_flag").alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(key, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("_flag").over(inside), F.lit(0))
    counted = rows.withColumn("_within", within).join(starts, [key, "_block"])
    return counted.withColumn(out, F.col("_start") + F.col("_within")).drop("_start", "_within", "_flag", "_block")


def with_previous(df: DataFrame, columns: list[str], out: str = "prev", key: str = "corpus_id", seq: str = "seq") -> DataFrame:
    """``out``: a struct of ``columns`` of the row before, null for a corpus's first."""
    rows = _blocks(df, seq)
    row = F.struct(*columns)
    last = rows.groupBy(key, "_block").agg(F.max_by(row, seq).alias("_last"))
    edges = last.withColumn("_edge", F.lag("_last").over(Window.partitionBy(key).orderBy("_block"))).drop("_last")
    inside = F.lag(row).over(Window.partitionBy(key, "_block").orderBy(seq))
    return rows.withColumn("_inside", inside).join(edges, [key, "_block"]).withColumn(out, F.coalesce("_inside", "_edge")).drop("_inside", "_edge", "_block")


def with_last(df: DataFrame, value: Column, out: str, key: str = "corpus_id") -> DataFrame:
    """``out``: the last ``value`` that is not null among the rows before, null where there is none."""
    rows = _blocks(df.withColumn("_value", value))
    last = rows.groupBy(key, "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("seq"))).alias("_v"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edges = last.withColumn("_edge", F.last("_v", ignorenulls=True).over(earlier)).drop("_v")
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy(key, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_inside", inside).join(edges, [key, "_block"]).withColumn(out, F.coalesce("_inside", "_edge")).drop("_inside", "_edge", "_block", "_value")
