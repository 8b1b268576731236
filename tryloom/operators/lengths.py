"""Statistics of episode lengths: the two-regime fit, rates of one-shot episodes, and how sure they are.

Everything after the histogram has a row for each distinct length or each day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tryloom.functions.scalars import two_proportions

#: Least sizes of a tail and of a power law's support (fixed values).
LEAST_TAIL, LEAST_SUPPORT = 20, 15
#: Labels that are no development.
SYNTHETIC = ("none", "mixed", "tooling")


def _ks(lo: Column, hi: Column, n: Column, cdf: Column) -> Column:
    """Largest distance of a sorted sample's steps lo+1..hi from ``cdf`` at their common point: its ends decide."""
    return F.greatest(F.abs((lo + 1) / n - cdf), F.abs(hi / n - cdf), F.abs(cdf - lo / n), F.abs(cdf - (hi - 1) / n))


def fit(hist: DataFrame, groups: list[str]) -> DataFrame:
    """For each group of a length histogram (``length``, ``trajectories``): the fit of its tail of 2 and more.

    A geometric law on the whole tail (``p``), the power law (``alpha``,
    ``xmin``) of least distance ``ks`` among supports of enough points, the
    geometric law on that support (``ks_geom``), and what either expects at
    ``probe`` and beyond against what is ``observed``. Groups with a short tail
    or without a support have no row; equal distances keep the smaller ``xmin``.
    """
    tail = hist.where("length >= 2").select(*groups, F.col("length").alias("k"), F.col("trajectories").alias("n"))
    whole = tail.groupBy(*groups).agg(F.sum("n").alias("n_tail"), (F.lit(1.0) / (F.sum(F.col("k") * F.col("n")) / F.sum("n") - 1)).alias("p")).where(F.col("n_tail") >= LEAST_TAIL)
    after = Window.partitionBy(*groups).orderBy(F.desc("k"))
    starts = tail.withColumn("support", F.sum("n").over(after)).where(F.col("support") >= LEAST_SUPPORT).select(*groups, F.col("k").alias("xmin"), "support")
    # distinct lengths with distinct lengths, within a group
    pairs = starts.join(tail, groups).where("k >= xmin")
    base = F.col("xmin") - 0.5
    law = pairs.groupBy(*groups, "xmin", "support").agg((1 + F.col("support") / F.sum(F.col("n") * F.log(F.col("k") / base))).alias("alpha"), (F.lit(1.0) / (F.sum(F.col("n") * (F.col("k") - F.col("xmin") + 1)) / F.col("support"))).alias("p_support"))
    placed = pairs.join(law, [*groups, "xmin", "support"]).withColumn("hi", F.sum("n").over(Window.partitionBy(*groups, "xmin").orderBy("k"))).withColumn("lo", F.col("hi") - F.col("n"))
    power = 1 - F.pow((F.col("k") + 0.5) / base, 1 - F.col("alpha"))
    geometric = 1 - F.pow(1 - F.col("p_support"), F.col("k") - F.col("xmin") + 1)
    ks = lambda cdf: F.max(_ks(F.col("lo"), F.col("hi"), F.col("support"), cdf))
    each = placed.groupBy(*groups, "xmin", "support", "alpha", "p_support").agg(ks(power).alias("ks"), ks(geometric).alias("ks_geom"))
    best = each.groupBy(*groups).agg(F.min(F.struct("ks", "xmin", "alpha", "support", "ks_geom")).alias("b")).select(*groups, "b.*")
    probe = F.greatest(F.lit(10), 4 * F.col("xmin"))
    chosen = whole.join(best, groups).withColumn("probe", probe)
    far = chosen.select(*groups, "probe").join(tail, groups).groupBy(*groups).agg(F.sum(F.when(F.col("k") >= F.col("probe"), F.col("n")).otherwise(0)).alias("observed"))
    r = lambda c: F.round(c, 6)
    return chosen.join(far, groups).select(
        *groups, "n_tail", r(F.col("p")).alias("p"), "xmin", "support", r(F.col("alpha")).alias("alpha"), r(F.col("ks")).alias("ks"), r(F.col("ks_geom")).alias("ks_geom"), "probe", "observed",
        r(F.col("n_tail") * F.pow(1 - F.col("p"), F.col("probe") - 1)).alias("expected_geom"),
    )


def trials(episodes: DataFrame, length: str = "len_attempt") -> DataFrame:
    """``project``, ``day`` and ``one_shot`` of closed, counted, proof-bearing episodes."""
    return episodes.where("is_closed AND proof_bearing").where(F.col(length) > 0).select("project", F.substring(F.col("started").cast("string"), 1, 10).alias("day"), (F.col(length) == 1).cast("int").alias("one_shot"))


def daily(found: DataFrame) -> DataFrame:
    """``trials`` by development and day: ``n`` of them, of which ``one_shot`` were so."""
    return found.groupBy("project", "day").agg(F.count("*").alias("n"), F.sum("one_shot").alias("one_shot"))


def choose_groups(found: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """``found`` with ``side``: ``a`` for the most frequent development (ties: the first in order) or the one named, ``b`` for the others or the one named.

    With fewer than two developments there is no row. ``found`` are trials, or ``daily`` ones, which count ``n`` times.
    """
    real = found.where(~F.col("project").isin(*SYNTHETIC))
    counts = real.groupBy("project").agg((F.sum("n") if "n" in found.columns else F.count("*")).alias("n"))
    largest = counts.agg(F.min_by("project", F.struct(-F.col("n"), F.col("project"))).alias("_a"), F.count("*").alias("_groups"))
    rows = real.join(F.broadcast(largest), how="cross").where("_groups >= 2")  # one row
    is_a = F.col("project") == (F.lit(a) if a else F.col("_a"))
    is_b = (F.col("project") == b) if b else ~is_a
    return rows.withColumn("side", F.when(is_a, "a").when(is_b, "b")).where("side IS NOT NULL").drop("_a", "_groups")


def by_day(sided: DataFrame) -> DataFrame:
    """``day`` with trials and one-shots of either side."""
    pick = lambda s, v: F.sum(F.when(F.col("side") == s, v).otherwise(0))
    one = F.col("n") if "n" in sided.columns else F.lit(1)
    return sided.groupBy("day").agg(pick("a", one).alias("n_a"), pick("a", F.col("one_shot")).alias("x_a"), pick("b", one).alias("n_b"), pick("b", F.col("one_shot")).alias("x_b"))


def two_proportion_test(days: DataFrame) -> DataFrame:
    """Rates of both sides, their gap, its naive standard error, z, p and a 95 % interval."""
    t = days.agg(*[F.sum(c).cast("double").alias(c) for c in ("n_a", "x_a", "n_b", "x_b")])
    z, p = two_proportions(*[F.col(c) for c in ("x_a", "n_a", "x_b", "n_b")])
    ra, rb = F.col("x_a") / F.col("n_a"), F.col("x_b") / F.col("n_b")
    error = F.sqrt(ra * (1 - ra) / F.col("n_a") + rb * (1 - rb) / F.col("n_b"))
    out = {"rate_a": ra, "rate_b": rb, "gap": ra - rb, "z": z, "p": p, "error": error, "low": ra - rb - 1.96 * error, "high": ra - rb + 1.96 * error}
    return t.select("n_a", "n_b", *[F.round(c, 6).alias(n) for n, c in out.items()])


#: Up to so many days (40 bytes each) go with every replicate as one row.
DAYS_BROADCAST = 100_000


def bootstrap(days: DataFrame, replicates: int = 10_000, seed: str = "trials") -> DataFrame:
    """``replicate`` and ``gap`` with whole days drawn again.

    Draw i of a replicate takes the day whose rank is a hash of seed, replicate
    and i, so any engine draws alike. A replicate is one row: it draws from an
    array of the days' sums, which are counted before they are broadcast; only
    beyond ``DAYS_BROADCAST`` draws are rows that are joined to the days.
    """
    figures = ("n_a", "x_a", "n_b", "x_b")
    n = days.count()
    rank = lambda replicate, i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), replicate.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(max(n, 1)))
    all_ = days.sparkSession.range(replicates).withColumnRenamed("id", "replicate")
    if n <= DAYS_BROADCAST:
        whole = days.agg(F.array_sort(F.collect_list(F.struct("day", *[F.col(c).cast("long").alias(c) for c in figures]))).alias("days"))
        rows = all_.join(F.broadcast(whole), how="cross")  # one row
        drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("days", rank(F.col("replicate"), i).cast("int")))
        start = F.struct(*[F.lit(0).cast("long").alias(c) for c in figures])
        total = F.aggregate(drawn, start, lambda acc, d: F.struct(*[(acc[c] + d[c]).alias(c) for c in figures]))
        sums = rows.where(F.lit(n > 0)).select("replicate", total.alias("t")).select("replicate", "t.*")
    else:
        ranked = days.withColumn("rank", F.row_number().over(Window.orderBy("day")) - 1)  # a row a day
        draws = all_.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        sums = draws.select("replicate", rank(F.col("replicate"), F.col("i")).alias("rank")).join(ranked, "rank").groupBy("replicate").agg(*[F.sum(c).alias(c) for c in figures])
    return sums.where("n_a > 0 AND n_b > 0").select("replicate", (F.col("x_a") / F.col("n_a") - F.col("x_b") / F.col("n_b")).alias("gap"))


def interval(gaps: DataFrame, test: DataFrame) -> DataFrame:
    """The bootstrap's 95 % interval by places of the sorted gaps, the share at or below 0, and the design effect."""
    order = Window.orderBy("gap", "replicate")  # a row a replicate
    ranked = gaps.withColumns({"at": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    place = lambda q: F.max(F.when(F.col("at") == F.floor(F.col("n") * q), F.col("gap")))
    made = ranked.agg(place(0.025).alias("low"), place(0.975).alias("high"), F.avg((F.col("gap") <= 0).cast("int")).alias("crossing"), F.stddev("gap").alias("boot_error"))
    both = made.join(F.broadcast(test.select("error")), how="cross")  # one row with one row
    return both.select(*[F.round(c, 6).alias(c) for c in ("low", "high", "crossing", "boot_error")], F.round(F.pow(F.col("boot_error") / F.nullif(F.col("error"), F.lit(0.0)), 2), 4).alias("design_effect"))


def leave_one_day_out(days: DataFrame) -> DataFrame:
    """The gap without each day of side b: totals less the day's own."""
    every = Window.partitionBy(F.lit(1))  # a row a day
    less = days.select("day", "n_b", *[(F.sum(c).over(every) - (F.col(c) if c[-1] == "b" else 0)).alias(f"t_{c}") for c in ("n_a", "x_a", "n_b", "x_b")])
    return less.where("n_b > 0 AND t_n_a > 0 AND t_n_b > 0").select("day", F.round(F.col("t_x_a") / F.col("t_n_a") - F.col("t_x_b") / F.col("t_n_b"), 6).alias("gap"))


def rates(found: DataFrame) -> DataFrame:
    """One-shot rate, trials and days of each development."""
    return found.groupBy("project").agg(F.round(F.avg("one_shot"), 6).alias("rate"), F.count("*").alias("n"), F.countDistinct("day").alias("days"))


def scopes(episodes: DataFrame) -> DataFrame:
    """One-shot rate, mean and number of each development's closed episodes, counted as code, proof edits and attempts.

    The first two need a code record; the last is counted in any case.
    """
    closed = episodes.where("is_closed")
    coded = F.col("len_code") > 0
    out = []
    for name, length, good in (("code", "len_code", coded), ("proof", "len_proof", coded & (F.col("len_proof") > 0)), ("attempt", "len_attempt", F.col("len_attempt") > 0)):
        out += [F.count_if(good).alias(f"n_{name}"), F.round(F.avg(F.when(good, (F.col(length) == 1).cast("int"))), 6).alias(f"one_shot_{name}"), F.round(F.avg(F.when(good, F.col(length))), 6).alias(f"mean_{name}")]
    return closed.groupBy("project").agg(*out)


def filtered_rates(episodes: DataFrame) -> DataFrame:
    """One-shot rates with and without the filter on proof-bearing episodes, and how many it drops."""
    good = episodes.where("is_closed").where(F.col("len_attempt") > 0)
    one = (F.col("len_attempt") == 1).cast("int")
    return good.groupBy("project").agg(F.round(F.avg(one), 6).alias("rate_all"), F.count("*").alias("n_all"), F.round(F.avg(F.when(F.col("proof_bearing"), one)), 6).alias("rate_proof"), F.count_if("proof_bearing").alias("n_proof"), F.count_if(~F.col("proof_bearing")).alias("dropped"))


def examples(episodes: DataFrame) -> DataFrame:
    """Closed episodes of a development that touch no proof."""
    return episodes.where(~F.col("project").isin(*SYNTHETIC)).where("is_closed AND coalesce(len_proof, 0) = 0").select("corpus_id", "episode_no", "project", "len_raw")


def compare(found: DataFrame, hist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Head to head: the test of the two sides' rates, and the tail fits of their pooled lengths (``side``)."""
    return two_proportion_test(by_day(found)), fit(hist, ["side"])
