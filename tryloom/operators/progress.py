"""What an edit after a failure achieved, why outcomes change, and how predictions fared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tryloom.operators.diffs import KEY, error_loci, files, hunks, map_line, path_sets, theory_key
from tryloom.operators.ordered import with_previous
from tryloom.schemas import LOCI


def earliest(loci: Column) -> Column:
    """The theory of the least line (ties: the first listed), and its least line."""
    least = F.array_min(F.transform(loci, lambda x: x["line"]))
    theory = F.get(F.filter(loci, lambda x: x["line"] == least), F.lit(0))["theory"]
    return F.when(F.size(loci) > 0, F.struct(theory.alias("theory"), least.alias("line")))


def transitions(attempts: DataFrame) -> DataFrame:
    """Each attempt after a non-success with its ``progress`` class, by lines corrected for the edit's drift."""
    ranges = hunks(files(attempts)).where("old_start IS NOT NULL").select(*KEY, F.struct(theory_key(F.col("path_new")).alias("theory"), "old_start", "old_len", "new_start", "new_len").alias("h"))
    per = ranges.groupBy(*KEY).agg(F.array_sort(F.collect_list("h")).alias("_hunks"))
    rows = attempts.withColumn("_loci", error_loci(F.col("error_loci"), F.col("error_head")))
    rows = with_previous(rows, ["outcome", "_loci", "error_head"], "_p").join(per, KEY, "left").where("_p IS NOT NULL AND NOT (_p.outcome <=> 'ok')")
    rows = rows.withColumn("_old", earliest(F.col("_p._loci")))
    theory, line = F.col("_old.theory"), F.col("_old.line")
    rows = rows.withColumn("_hs", F.filter("_hunks", lambda h: h["theory"] == theory))
    rows = rows.withColumns({"_m": map_line(F.col("_hs"), line), "_new": F.array_min(F.transform(F.filter("_loci", lambda x: x["theory"] == theory), lambda x: x["line"]))})
    new, m = F.col("_new"), F.col("_m")
    inside = F.exists("_hs", lambda h: (h["new_start"] <= new) & (new < h["new_start"] + h["new_len"]))
    differs = F.coalesce("_p.error_head", F.lit("")) != F.coalesce("error_head", F.lit(""))
    kind = (
        F.when(F.col("_old").isNull() | F.col("_hunks").isNull(), "unclassifiable")
        .when(F.size("_hs") == 0, "edit in a different theory")
        .when((F.col("outcome") == "ok") & m.isNull(), "ok, edit covered the failing line")
        .when(F.col("outcome") == "ok", "ok, failing line untouched")
        .when(new.isNull(), "error left the theory")
        .when(m.isNull() & inside & differs, "still failing in region, different error")
        .when(m.isNull() & inside, "still failing in region, same error")
        .when(m.isNull(), "edited the failing line, error moved off it")
        .when(new > m, "error advanced past the edit")
        .when(new == m, "same drift-corrected line")
        .otherwise("error retreated")
    )
    return rows.select(*KEY, kind.alias("progress"))


def tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("progress").agg(F.count("*").alias("n"))


def changed_keys(a: Column, b: Column) -> Column:
    """Keys of two maps whose values differ, sorted; none if either map is null or empty."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    differ = F.filter(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), differ).otherwise(F.array().cast("array<string>"))


def flips(attempts: DataFrame) -> DataFrame:
    """Each change of outcome with its ``causes``: edited theories (four at most), budgets, other files, and budgets not recorded."""
    rows = with_previous(attempts, ["outcome", "limits"], "_p").where("_p IS NOT NULL AND NOT (_p.outcome <=> outcome)").join(path_sets(attempts.where("trim(diff) <> ''")), KEY, "left")
    a, b = F.col("_p.limits"), F.col("limits")
    names = F.array_sort(F.transform("pre", theory_key))
    show = lambda m, k: F.coalesce(F.element_at(m, k).cast("string"), F.lit("None"))
    budgets = F.transform(changed_keys(a, b), lambda k: F.concat(F.lit("LIMIT "), k, F.lit(" "), show(a, k), F.lit("->"), show(b, k)))
    count = lambda x: F.coalesce(x, F.lit("None"))
    others = F.transform(F.coalesce("other_changed", F.array().cast("array<array<string>>")), lambda o: F.concat(F.lit("non-source: "), o[0], F.lit(" +"), count(F.get(o, F.lit(1))), F.lit("/-"), count(F.get(o, F.lit(2)))))
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))
    causes = F.concat(
        one(F.col("pre").isNotNull(), F.concat(F.lit("sources: "), F.array_join(F.slice(names, 1, 4), ", "))),
        budgets,
        others,
        one(a.isNull() | b.isNull(), F.lit("limits not recorded for one side")),
    )
    diagnosis = F.substring_index(F.element_at("note_fields", "diagnosis"), "\n", 1)
    return rows.select(*KEY, F.col("_p.outcome").alias("before"), "outcome", causes.alias("causes"), diagnosis.alias("diagnosis"))


def flip_totals(found: DataFrame) -> DataFrame:
    """Changes of outcome, those with a budget change, and those without a cause."""
    return found.agg(F.count("*").alias("changes"), F.count_if(F.exists("causes", lambda c: F.startswith(c, F.lit("LIMIT")))).alias("budget"), F.count_if(F.size("causes") == 0).alias("unexplained"))


def prediction_marks(attempts: DataFrame) -> DataFrame:
    """Noted attempts with ``mark``: hit, surprise or none, and whether the note is post hoc."""
    noted = attempts.where("note IS NOT NULL AND note <> ''")
    pred = F.col("note_predicted")
    mark = F.when(pred.isNull(), "none").when(pred == F.col("outcome"), "hit").otherwise("surprise")
    return noted.select(*KEY, "outcome", "note_predicted", mark.alias("mark"), F.coalesce(F.col("note_pre_build") == F.lit(False), F.lit(False)).alias("post_hoc"))


def prediction_score(attempts: DataFrame) -> DataFrame:
    marks = prediction_marks(attempts)
    return marks.agg(F.count("*").alias("notes"), F.count_if(F.col("mark") != "none").alias("scored"), F.count_if(F.col("mark") == "hit").alias("hits"), F.count_if(F.col("mark") == "surprise").alias("surprises"), F.count_if("post_hoc").alias("post_hoc"))


__all__ = ["LOCI", "changed_keys", "earliest", "flip_totals", "flips", "prediction_marks", "prediction_score", "tally", "transitions"]
