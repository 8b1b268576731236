"""Audits: outcomes, timeouts and empty diffs, recomputed by development and era."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tryloom.operators.episodes import EPISODE, era
from tryloom.operators.ordered import with_previous

_rate = lambda flag: F.round(F.avg(flag.cast("int")), 6)


def outcome_mix(episodes: DataFrame) -> DataFrame:
    """Fails, timeouts, their share of attempts, and the share of episodes with a timeout."""
    return episodes.groupBy("project").agg(F.sum("fails").alias("fails"), F.sum("timeouts").alias("timeouts"), F.round(F.sum("timeouts") / F.sum("len_raw"), 6).alias("timeout_share"), _rate(F.col("timeouts") > 0).alias("runs_with_timeout"))


def one_shot_treatments(episodes: DataFrame) -> DataFrame:
    """One-shot rates of closed episodes as counted, with timeouts taken out (one left at least), and without episodes that have any."""
    closed = episodes.where("is_closed")
    without = F.greatest(F.lit(1), F.col("len_raw") - F.col("timeouts"))
    return closed.groupBy("project").agg(_rate(F.col("len_raw") == 1).alias("as_counted"), _rate(without == 1).alias("timeouts_removed"), F.round(F.avg(F.when(F.col("timeouts") == 0, (F.col("len_raw") == 1).cast("int"))), 6).alias("runs_removed"))


def load_conditions(attempts: DataFrame) -> DataFrame:
    """Battery share, mean time, instances and switches beyond the least, by development."""
    rows = with_previous(attempts, ["instance_id"], "_p", key="project")
    switch = F.col("_p").isNotNull() & ~F.col("_p.instance_id").eqNullSafe(F.col("instance_id"))
    each = rows.groupBy("project", "instance_id").agg(F.count("*").alias("n"), F.count_if(F.col("power") == "battery").alias("b"), F.sum("elapsed_s").alias("e"), F.count("elapsed_s").alias("ne"), F.count_if(switch).alias("s"))
    return each.groupBy("project").agg(F.round(F.sum("b") / F.sum("n"), 6).alias("battery_share"), F.round(F.sum("e") / F.sum("ne"), 4).alias("mean_elapsed"), F.count("*").alias("instances"), F.greatest(F.lit(0), F.sum("s") - (F.count("*") - 1)).alias("excess"))


def timeout_reasons(attempts: DataFrame, reasons: tuple[str, ...] = ("activity", "wall", "loop_progress")) -> DataFrame:
    """Timeouts by reason, and how often an attempt diverges (is killed in a loop)."""
    return attempts.groupBy("project").agg(*[F.count_if(F.col("timeout_reason") == r).alias(r) for r in reasons], F.round(F.count_if(F.col("timeout_reason") == "loop_progress") / F.count("*"), 6).alias("divergence_rate"))


def disguised_timeouts(attempts: DataFrame) -> DataFrame:
    """Median and longest failing time, and fails that took as long as the shortest timeout.

    The median is exact; it is taken from counts of equal times.
    """
    least = attempts.groupBy("project").agg(F.min(F.when(F.col("outcome") == "timeout", F.col("elapsed_s"))).alias("_least"))
    fails = attempts.where("outcome = 'fail' AND elapsed_s IS NOT NULL").groupBy("project", "elapsed_s").agg(F.count("*").alias("n"))
    order, every = Window.partitionBy("project").orderBy("elapsed_s"), Window.partitionBy("project")
    placed = fails.withColumns({"_hi": F.sum("n").over(order), "_all": F.sum("n").over(every)})
    at = lambda i: F.min(F.when(F.col("_hi") > i, F.col("elapsed_s")))
    median = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2
    joined = placed.join(least, "project")
    return joined.groupBy("project").agg(F.round(median, 6).alias("median_fail"), F.max("elapsed_s").alias("longest_fail"), F.sum(F.when(F.col("elapsed_s") >= F.col("_least"), F.col("n")).otherwise(0)).alias("disguised"))


def failure_texts(attempts: DataFrame, phrases: list[str]) -> DataFrame:
    """The share of failing heads with each phrase, and with none of them."""
    head = F.lower(F.coalesce("error_head", F.lit("")))
    has = [F.contains(head, F.lit(p.lower())) for p in phrases]
    none = ~has[0]
    for h in has[1:]:
        none = none & ~h
    return attempts.where("outcome = 'fail'").agg(*[_rate(h).alias("share_" + p.lower().replace(" ", "_")) for p, h in zip(phrases, has, strict=True)], _rate(none).alias("unmatched"))


def divergence_by_length(attempts: DataFrame, episodes: DataFrame) -> DataFrame:
    """By band of episode length: loop rate of attempts, and episodes with a loop against those to expect at one common rate."""
    n = F.col("len_raw")
    band = F.when(n <= 1, "1").when(n <= 4, "2-4").when(n <= 9, "5-9").otherwise("10+")
    loops = attempts.groupBy(*EPISODE).agg(F.count_if(F.col("timeout_reason") == "loop_progress").alias("loops"))
    rows = episodes.select(*EPISODE, "len_raw").join(loops, EPISODE)
    p = rows.agg((F.sum("loops") / F.sum("len_raw")).alias("p"))
    return rows.join(F.broadcast(p), how="cross").groupBy(band.alias("band")).agg(F.round(F.sum("loops") / F.sum("len_raw"), 6).alias("loop_rate"), F.count_if(F.col("loops") > 0).alias("observed"), F.round(F.sum(1 - F.pow(1 - F.col("p"), F.col("len_raw"))), 4).alias("expected"))  # one row


def class_by_outcome(attempts: DataFrame, stamp: str = "timestamp") -> DataFrame:
    """Attempts by era, class and outcome, with a subtotal (null class) for each era."""
    return attempts.withColumn("era", era(stamp)).groupBy("era", "delta_class").agg(F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "fail").alias("fail"), F.count_if(F.col("outcome") == "timeout").alias("timeout"), F.count("*").alias("n")).transform(_with_era_totals)


def _with_era_totals(rows: DataFrame) -> DataFrame:
    totals = rows.groupBy("era").agg(*[F.sum(c).alias(c) for c in ("ok", "fail", "timeout", "n")]).withColumn("delta_class", F.lit(None).cast("string"))
    both = rows.unionByName(totals)
    share = F.col("n") / F.max("n").over(Window.partitionBy("era"))
    return both.withColumn("share", F.round(share, 6))


def empty_by_predecessor(attempts: DataFrame, stamp: str = "timestamp") -> DataFrame:
    """Empty diffs by era, outcome and what came before: bad, ok or first."""
    rows = with_previous(attempts.withColumn("era", era(stamp)), ["outcome"], "_p")
    before = F.when(F.col("_p").isNull(), "first").when(F.col("_p.outcome") == "ok", "ok").otherwise("bad")
    return rows.where("delta_class = 'none'").groupBy("era", "outcome", before.alias("before")).agg(F.count("*").alias("n"))


def lost_episodes(episodes: DataFrame) -> DataFrame:
    """What counting code records alone loses of closed episodes: dropped, shortened, attempts missed, wrongly one-shot.

    Dropped ones whose errors name a directory (``error_dirs``) are recoverable.
    """
    attempts = F.coalesce("len_attempt", F.lit(0))
    dropped = (F.col("len_code") == 0) & (attempts > 0)
    shortened = (F.col("len_code") > 0) & (F.col("len_code") < attempts)
    return episodes.where("is_closed").agg(
        F.count_if(dropped).alias("dropped"),
        F.count_if(shortened).alias("shortened"),
        F.sum(F.when(dropped | shortened, attempts - F.col("len_code")).otherwise(0)).alias("missed"),
        F.count_if((F.col("len_code") == 1) & (attempts > 1)).alias("wrongly_one_shot"),
        F.count_if(dropped & (F.size("error_dirs") > 0)).alias("recoverable"),
    )
