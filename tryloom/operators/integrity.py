"""Whether stored diffs are whole: verdicts, repairs and replays against recorded trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tryloom.operators.diffs import KEY, bound, files, hunks, normalised, short_hunks
from tryloom.operators.episodes import base_trees
from tryloom.operators.ordered import with_last, with_previous

#: Verdict -> group (fixed values).
GROUPS = {
    "sound": "clean", "empty-consistent": "clean", "empty-recoverable": "exact", "truncated": "exact", "divergent": "exact",
    "empty-lost-objects": "unrecoverable", "empty-blind": "unrecoverable", "damaged": "unrecoverable", "stripped?": "heuristic", "unverified": "unjudged",
}


def with_regenerated(attempts: DataFrame, trees: DataFrame, tree_diffs: DataFrame, known: DataFrame) -> DataFrame:
    """``attempts`` with ``base`` and ``regen``: the diff of base and tree, null unless both objects are in ``known``."""
    rows = base_trees(attempts, trees)
    ids = known.select("tree").distinct()
    alive = rows.join(ids.select(F.col("tree").alias("base")), "base", "left_semi").join(ids, "tree", "left_semi").select(*KEY, "base", "tree")
    made = alive.join(tree_diffs.select(F.col("base"), F.col("tree"), F.col("diff").alias("regen")), ["base", "tree"], "left").select(*KEY, "regen")
    return rows.join(made, KEY, "left")


def blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"\S")


def verdicts(attempts: DataFrame) -> DataFrame:
    """``attempts`` (with ``base`` and ``regen``) with ``verdict``, ``repair`` and ``detail``. Empty diffs are judged first, then by the regenerated text, then alone."""
    stored = F.coalesce("diff", F.lit(""))
    short = short_hunks(files(attempts)).groupBy(*KEY).agg(F.count("*").alias("_short"), F.bool_and(F.col("old_missing") == F.col("new_missing")).alias("_even"), F.max("old_missing").alias("_lines"))
    rows = with_previous(attempts, ["outcome"], "_p").join(short, KEY, "left")
    regen, a, b = F.col("regen"), normalised(stored), normalised(F.col("regen"))
    flip = F.col("_p").isNotNull() & ~F.col("_p.outcome").eqNullSafe(F.col("outcome")) & ~(F.coalesce(F.col("_p.outcome") == "timeout", F.lit(False)) | (F.col("outcome") == "timeout"))
    none = F.coalesce("_short", F.lit(0))
    verdict = (
        F.when(blank(stored) & regen.isNotNull() & ~blank(regen), "empty-recoverable")
        .when(blank(stored) & regen.isNull() & F.col("base").isNotNull() & F.col("tree").isNotNull() & (F.col("base") != F.col("tree")), "empty-lost-objects")
        .when(blank(stored) & flip, "empty-blind")
        .when(blank(stored), "empty-consistent")
        .when(regen.isNotNull() & (a == b), "sound")
        .when(regen.isNotNull() & F.startswith(b, a), "truncated")
        .when(regen.isNotNull(), "divergent")
        .when(none == 0, "unverified")
        .when((none == 1) & F.col("_even"), "stripped?")
        .otherwise("damaged")
    )
    rows = rows.withColumn("verdict", verdict)
    v = F.col("verdict")
    repair = F.when(v.isin("empty-recoverable", "divergent"), regen).when(v == "truncated", F.concat(stored, F.substring(b, F.length(a) + 1, F.length(b))))
    detail = F.when(v == "truncated", F.concat((F.length(b) - F.length(a)).cast("string"), F.lit(" lost from the tail"))).when(v == "stripped?", F.concat(F.col("_lines").cast("string"), F.lit(" context lines missing")))
    return rows.withColumns({"repair": repair, "detail": detail, "missing_lines": F.when(v == "stripped?", F.col("_lines"))}).drop("_p", "_short", "_even", "_lines")


def tally(judged: DataFrame) -> DataFrame:
    """Verdicts with their group, the most common first."""
    group = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    return judged.groupBy("verdict").agg(F.count("*").alias("n")).withColumn("group", group[F.col("verdict")]).orderBy(F.desc("n"), "verdict")


def blind_by_day(judged: DataFrame, since: str) -> DataFrame:
    """Blind empties before and from a day on."""
    return judged.where("verdict = 'empty-blind'").groupBy((F.substring(F.col("ts").cast("string"), 1, 10) >= since).alias("since")).agg(F.count("*").alias("n"))


def defects(judged: DataFrame, shown: int = 40) -> DataFrame:
    """The first ``shown`` defective records in order, with how many there are."""
    bad = judged.where(~F.col("verdict").isin("sound", "empty-consistent"))
    total = bad.agg(F.count("*").alias("defects"))
    return bad.orderBy(*KEY).limit(shown).select(*KEY, "verdict").join(F.broadcast(total), how="cross")  # one row


def repaired(judged: DataFrame, heuristic: bool = False) -> DataFrame:
    """Records with exact repairs written in and ``diff_repaired`` stamped; heuristic ones get blank context lines."""
    guess = F.col("verdict") == "stripped?"
    text = F.col("repair")
    if heuristic:
        text = F.when(guess, F.concat("diff", F.repeat(F.lit(" \n"), F.coalesce("missing_lines", F.lit(0))))).otherwise(text)
    stamp = F.when(text.isNotNull(), F.col("verdict")).otherwise(F.col("diff_repaired") if "diff_repaired" in judged.columns else F.lit(None).cast("string"))
    return judged.withColumns({"_new": F.coalesce(text, F.col("diff")), "diff_repaired": stamp, "changed": text.isNotNull()}).withColumn("length_before", F.length(F.coalesce("diff", F.lit("")))).withColumn("diff", F.col("_new")).drop("_new", "repair", "detail", "missing_lines")


def dry_run(judged: DataFrame, heuristic: bool = False) -> DataFrame:
    """What a repair would change: keys, verdict and the lengths before and after."""
    return repaired(judged, heuristic).where("changed").select(*KEY, "verdict", "length_before", F.length("diff").alias("length_after"))


def replayed(attempts: DataFrame, entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each patched file applied to its base blob: ``verdict`` ok, bad or skipped.

    ``attempts`` has ``base``; ``entries`` has ``tree``, ``path``, ``blob_id``; ``blobs`` has ``blob_id``, ``content``
    (text). A new text is the old one's lines outside the hunks with the hunks' new lines between; the id of
    a blob is the hash of its header and bytes.
    """
    found = files(attempts)
    parts = hunks(found).groupBy(*KEY, "file_no").agg(F.array_sort(F.collect_list(F.struct("old_start", "old_len", "lines"))).alias("hs"))
    rows = found.select(*KEY, "file_no", "path_old", "path_new").join(parts, [*KEY, "file_no"]).join(attempts.select(*KEY, "base", "tree"), KEY)
    old = entries.select(F.col("tree").alias("base"), F.col("path").alias("path_old"), F.col("blob_id").alias("old_id"))
    new = entries.select("tree", F.col("path").alias("path_new"), F.col("blob_id").alias("new_id"))
    both = rows.join(old, ["base", "path_old"], "left").join(new, ["tree", "path_new"], "left").join(blobs.select(F.col("blob_id").alias("old_id"), "content"), "old_id", "left")
    put = lambda h: F.transform(F.filter(h["lines"], lambda ln: ~F.startswith(ln, F.lit("-"))), lambda ln: F.substring(ln, 2, 1 << 30))
    first = lambda h: h["old_start"] + F.when(h["old_len"] == 0, 1).otherwise(0)
    after = lambda h: F.coalesce(first(h) + h["old_len"], F.lit(1))

    def assembled(x: Column) -> Column:
        # Each hunk copies the old lines since the hunk before it, so the file is copied once.
        old = lambda begin, end: F.slice(x["text"], begin, F.greatest(end - begin, F.lit(0)))
        parts = F.transform(x["hs"], lambda h, i: F.concat(old(after(F.when(i > 0, F.get(x["hs"], i - 1))), first(h)), put(h)))
        return F.concat(F.flatten(parts), old(after(F.element_at(x["hs"], -1)), F.size(x["text"]) + 1))

    made = bound(F.struct("hs", F.split(F.coalesce("content", F.lit("")), "\n", -1).alias("text")), assembled)
    body = F.array_join(made, "\n")
    known = F.col("content").isNotNull() & F.col("new_id").isNotNull()
    return both.withColumn("made_id", blob_id(body)).select(*KEY, "file_no", "path_new", F.when(~known, "skipped").when(F.col("made_id") == F.col("new_id"), "ok").otherwise("bad").alias("verdict"))


def blob_id(text: Column) -> Column:
    data = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def materialised(attempts: DataFrame, build_id: str, entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """All files of one record's tree."""
    tree = attempts.where(F.col("build_id") == build_id).select("tree").distinct()
    return entries.join(tree, "tree", "left_semi").join(blobs, "blob_id").select("path", "content")


def backfilled(legacy: DataFrame, chain: DataFrame, trees: DataFrame, tree_diffs: DataFrame) -> DataFrame:
    """Diff-less records joined to a chain of snapshots (``build_id``, ``tree``) by build id.

    The base is the last matched tree before unless the head moved since then; unmatched records keep a null diff.
    """
    rows = legacy.drop("tree", "diff").join(chain, "build_id", "left")
    matched = F.when(F.col("tree").isNotNull(), F.struct("tree", "git_head"))
    rows = with_last(rows, matched, "_last").join(trees, "git_head", "left")
    moved = F.col("_last").isNull() | ~F.col("_last.git_head").eqNullSafe(F.col("git_head"))
    based = rows.withColumn("base", F.when(F.col("tree").isNotNull(), F.when(moved, F.col("head_tree")).otherwise(F.col("_last.tree"))))
    return based.join(tree_diffs, ["base", "tree"], "left").withColumn("backfilled", F.col("diff").isNotNull()).drop("_last")
