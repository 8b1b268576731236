"""Episodes: runs of attempts closed by a success, and what is counted over them.

Throughout, an attempts table has ``corpus_id``, ``seq`` and the fields of a
record; an episode table has one row for each ``corpus_id`` and ``episode_no``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tryloom.operators.ordered import running_count, with_previous

EPISODE = ["corpus_id", "episode_no"]
#: The day from which captures are complete (a fixed value), as text.
CAPTURE_FIX = "2026-07-27"


def inside() -> Window:
    return Window.partitionBy(*EPISODE).orderBy("seq")


def segment(attempts: DataFrame, by_instance: bool = False) -> DataFrame:
    """``attempts`` with ``episode_no``: how many successes came before in the corpus.

    ``by_instance`` separates working copies: the key becomes corpus and instance.
    """
    if by_instance:
        attempts = attempts.withColumn("corpus_id", F.concat_ws("/", "corpus_id", F.coalesce("instance_id", F.lit("unknown"))))
    return running_count(attempts, F.col("outcome") == "ok", "episode_no")


def is_attempt(delta_class: Column | str = "delta_class") -> Column:
    """Whether a row is an attempt: no success, or code, or after a non-success of its episode."""
    kind = F.col(delta_class) if isinstance(delta_class, str) else delta_class
    after_bad = F.lag("outcome").over(inside()) != "ok"
    return (F.col("outcome") != "ok") | (kind == "code") | F.coalesce(after_bad, F.lit(False))


def summary(attempts: DataFrame, *more: Column) -> DataFrame:
    """One row an episode: span, outcome counts and the three lengths.

    ``attempts`` has ``episode_no`` and ``delta_class``. ``more`` are further
    aggregates, worked out in the same pass.
    """
    rows = attempts.withColumns({
        "_attempt": is_attempt(),
        "_blind": F.coalesce((F.col("delta_class") == "none") & (F.lag("outcome").over(inside()) != "ok"), F.lit(False)),
    })
    return rows.groupBy(*EPISODE).agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.min_by("build_id", "seq").alias("first_build"),
        F.max_by("build_id", "seq").alias("last_build"),
        F.min_by("ts", "seq").alias("started"),
        F.count("*").alias("len_raw"),
        F.count_if(F.col("outcome") == "fail").alias("fails"),
        F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
        F.count_if(F.col("delta_class") == "code").alias("len_code"),
        F.nullif(F.count_if("_attempt"), F.lit(0)).alias("len_attempt"),
        F.bool_or(F.col("outcome") == "ok").alias("is_closed"),
        F.bool_or("_blind").alias("blind"),
        *more,
    )


def histogram(episodes: DataFrame, length: str = "len_code", last: int = 0) -> DataFrame:
    """Closed episodes by length. ``last`` keeps a corpus's latest ones, before lengths of 0 are dropped."""
    closed = tail(episodes.where("is_closed"), last, "episode_no")
    return closed.where(F.col(length) > 0).groupBy(F.col(length).alias("length")).agg(F.count("*").alias("trajectories"))


def tail(rows: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The last ``n`` rows of each corpus; 0 means all. Each task first keeps its own last ``n``."""
    if not n:
        return rows
    rank = F.row_number().over(Window.partitionBy("corpus_id").orderBy(F.desc(order)))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def upper_median(hist: DataFrame, groups: list[str]) -> DataFrame:
    """The element at place n div 2 (from 0) of the sorted lengths, from a histogram."""
    order = Window.partitionBy(*groups).orderBy("length")
    every = Window.partitionBy(*groups)
    placed = hist.withColumns({"_upto": F.sum("trajectories").over(order), "_all": F.sum("trajectories").over(every)})
    return placed.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*groups).agg(F.min("length").alias("median"))


def length_summary(episodes: DataFrame, length: str = "len_code") -> DataFrame:
    """Trajectories, steps, mean, upper median, longest, one-shot share, dropped and blind closed episodes."""
    closed = episodes.where("is_closed")
    ranked = upper_median(histogram(episodes, length).withColumn("_g", F.lit(1)), ["_g"]).select("median")
    good = F.col(length) > 0
    totals = closed.agg(
        F.count_if(good).alias("trajectories"),
        F.sum(F.when(good, F.col(length))).alias("steps"),
        F.round(F.avg(F.when(good, F.col(length))), 6).alias("mean"),
        F.max(length).alias("longest"),
        F.round(F.count_if(F.col(length) == 1) / F.count_if(good), 6).alias("one_shot"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("dropped"),
        F.count_if("blind").alias("blind"),
    )
    return totals.join(F.broadcast(ranked), how="left")  # one row with one row


def by_development(episodes: DataFrame, project: str = "project", length: str = "len_code") -> DataFrame:
    """Trajectories, steps, one-shot share, mean and longest of each development, the most frequent first."""
    good = episodes.where("is_closed").where(F.col(length) > 0)
    return good.groupBy(project).agg(
        F.count("*").alias("trajectories"),
        F.sum(length).alias("steps"),
        F.round(F.count_if(F.col(length) == 1) / F.count("*"), 6).alias("one_shot"),
        F.round(F.avg(length), 6).alias("mean"),
        F.max(length).alias("longest"),
    ).orderBy(F.desc("trajectories"), project)


def recent(attempts: DataFrame, n: int, code_only: bool = True, order: str = "timestamp") -> DataFrame:
    """The last ``n`` attempts, by ``order``, corpus and sequence, with how many are not shown."""
    rows = attempts.where("delta_class = 'code'") if code_only else attempts
    total = rows.agg(F.count("*").alias("_all"))
    shown = rows.orderBy(F.desc(order), F.desc("corpus_id"), F.desc("seq")).limit(n)
    return shown.crossJoin(F.broadcast(total)).withColumn("hidden", F.greatest(F.col("_all") - n, F.lit(0))).drop("_all")


def show(attempts: DataFrame, prefix: str) -> DataFrame:
    """The last record of each corpus whose build id begins with ``prefix``."""
    row = F.struct(*attempts.columns)
    found = attempts.where(F.startswith("build_id", F.lit(prefix)))
    return found.groupBy("corpus_id").agg(F.max_by(row, "seq").alias("r")).select("r.*")


def base_trees(attempts: DataFrame, trees: DataFrame) -> DataFrame:
    """``base``: the tree of the head (from ``trees``: ``git_head``, ``head_tree``) when there is no
    previous tree or the head moved, else the previous tree."""
    rows = with_previous(attempts, ["tree", "git_head"], "_p").join(trees, "git_head", "left")
    moved = F.col("_p.tree").isNull() | ~F.col("_p.git_head").eqNullSafe(F.col("git_head"))
    return rows.withColumn("base", F.when(moved, F.col("head_tree")).otherwise(F.col("_p.tree"))).drop("_p")


def snapshot_bases(attempts: DataFrame, known: DataFrame) -> DataFrame:
    """``incremental``: whether the writer may diff against the last tree: same head, and the tree is in ``known``."""
    rows = with_previous(attempts, ["tree", "git_head"], "_p")
    found = known.select(F.col("tree").alias("_tree")).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(found, F.col("_p.tree") == F.col("_tree"), "left")
    same = F.col("_p.git_head").eqNullSafe(F.col("git_head")) & F.col("_p").isNotNull()
    return joined.withColumn("incremental", same & F.coalesce("_known", F.lit(False))).drop("_p", "_tree", "_known")


def mid_flight(attempts: DataFrame) -> DataFrame:
    """``mid_flight``: the head differs from that of the attempt before in the same episode."""
    w = inside()
    changed = ~F.lag("git_head").over(w).eqNullSafe(F.col("git_head"))
    return attempts.withColumn("mid_flight", (F.row_number().over(w) > 1) & changed)


def interleaving(attempts: DataFrame) -> DataFrame:
    """Instances of each corpus and its switches beyond the least possible. Null counts as an instance."""
    rows = with_previous(attempts, ["instance_id"], "_p")
    switch = F.col("_p").isNotNull() & ~F.col("_p.instance_id").eqNullSafe(F.col("instance_id"))
    by = rows.groupBy("corpus_id", "instance_id").agg(F.count_if(switch).alias("s"))
    instances = F.count("*")
    return by.groupBy("corpus_id").agg(instances.alias("instances"), F.greatest(F.lit(0), F.sum("s") - (instances - 1)).alias("excess"))


def export(attempts: DataFrame) -> DataFrame:
    """Nested episodes: ``episode_id``, ``instance_id``, ``open``, ``closed_by`` and the ordered attempts.

    An episode's id is its closing build's, else its first one's with ``-open``.
    """
    own = F.struct("seq", *[c for c in attempts.columns if c not in (*EPISODE, "seq")])
    rows = attempts.groupBy(*EPISODE).agg(
        F.array_sort(F.collect_list(own), lambda a, b: F.signum(a["seq"] - b["seq"]).cast("int")).alias("attempts"),
        F.max_by("instance_id", "seq").alias("instance_id"),
        F.min_by("build_id", "seq").alias("_first"),
        F.max_by("build_id", F.when(F.col("outcome") == "ok", F.col("seq"))).alias("closed_by"),
        F.count("*").alias("n"),
    )
    opened = F.col("closed_by").isNull()
    return rows.select(*EPISODE, F.coalesce("instance_id", F.lit("unknown")).alias("instance_id"), F.when(opened, F.concat("_first", F.lit("-open"))).otherwise(F.col("closed_by")).alias("episode_id"), opened.alias("open"), "closed_by", "n", "attempts")


def export_counts(attempts: DataFrame) -> DataFrame:
    """Episodes, closed, open and mid-flight commits."""
    each = mid_flight(attempts).groupBy(*EPISODE).agg(F.bool_or(F.col("outcome") == "ok").alias("closed"), F.count_if("mid_flight").alias("moves"))
    return each.agg(F.count("*").alias("episodes"), F.count_if("closed").alias("closed"), F.count_if(~F.col("closed")).alias("open"), F.coalesce(F.sum("moves"), F.lit(0)).alias("mid_flight"))


def view(attempts: DataFrame, episodes: DataFrame, with_diff: bool = False) -> DataFrame:
    """Attempts beside their episode's figures, the diff only if asked."""
    kept = attempts if with_diff else attempts.drop("diff")
    return kept.join(episodes.select(*EPISODE, "len_raw", "len_attempt", "is_closed"), EPISODE)


def era(timestamp: Column | str = "timestamp") -> Column:
    """``post`` from the day of the capture fix on, else ``pre``; text is compared."""
    stamp = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.when(F.coalesce(stamp, F.lit("")) >= CAPTURE_FIX, "post").otherwise("pre")


def derived(attempts: DataFrame) -> DataFrame:
    """The writer's arithmetic: time on mains power, dirtiness, age of the note and whether it preceded the build.

    Needs ``elapsed_s``, ``battery_factor``, ``tree``, ``head_tree``, ``note_mtime`` and ``now`` (seconds).
    """
    factor = F.nullif(F.col("battery_factor"), F.lit(0.0))
    return attempts.withColumns({
        "elapsed_s_ac": F.round(F.col("elapsed_s") / F.coalesce(factor, F.lit(1.0)), 1),
        "head_dirty": F.col("tree") != F.col("head_tree"),
        "note_age_s": F.round(F.col("now") - F.col("note_mtime"), 1),
        "note_pre_build": F.col("note_mtime") <= F.col("now") - F.col("elapsed_s"),
    })
