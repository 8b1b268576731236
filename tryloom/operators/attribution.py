"""Which development an episode belongs to: facts fitted from the corpus, then labels.

A fitted attribution is four small tables: ``dirs`` (``dir``), ``labels``
(``dir``, ``label``), ``targets`` (``target``, ``dir``; a null directory is a
declared exclusion) and ``aliases`` (``short``, ``label``). They have a row for
each directory or target of a project. Joins against them are left to Spark,
which broadcasts what measures small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tryloom.functions.argv import build_options, load_dirs, targets
from tryloom.functions.scalars import root_sessions
from tryloom.operators.components import components
from tryloom.operators.diffs import KEY, file_verdicts, files, kinds, lines, parent, theory_dirs, theory_moves
from tryloom.operators.episodes import EPISODE
from tryloom.sources.shared import landed

#: How many times as often a target must go with one directory as with any other (a fixed value).
DOMINANCE = 3
_PATH = r"([^\s\"']*/)?([A-Za-z0-9_.\-]+\.thy)"
_BY_LINE = r"\bline \d+ of ([A-Za-z][A-Za-z0-9_]*)"


@dataclass
class Attribution:
    dirs: DataFrame
    labels: DataFrame
    targets: DataFrame
    aliases: DataFrame
    collisions: DataFrame


def last_part(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def touched(attempts: DataFrame) -> DataFrame:
    """``command`` and ``dirs``, the directories of a diff's theories, with how many records have both: ``n``."""
    return attempts.select("command", theory_dirs(F.col("diff")).alias("dirs")).where(F.size("dirs") > 0).groupBy("command", "dirs").agg(F.count("*").alias("n"))


def commands(attempts: DataFrame) -> DataFrame:
    """Distinct commands and how many records have each: what they say is worked out once for each."""
    return landed(attempts.where("command IS NOT NULL").groupBy("command").agg(F.count("*").alias("n")), "commands")


def marked(attempts: DataFrame) -> DataFrame:
    """``files`` that moved, and those that declare targets, with their bodies."""
    root = last_part(F.col("path_new")).isin("ROOT", "ROOTS")
    return files(attempts).where(root | (F.col("path_old") != F.col("path_new"))).select(*KEY, "file_no", "path_old", "path_new", "suffix", F.when(root, F.col("body")).alias("body"))


def session_dirs(touched: DataFrame) -> DataFrame:
    """Directories that hold a theory in some diff."""
    return touched.select(F.explode("dirs").alias("dir")).distinct()


def last_moves(found: DataFrame) -> DataFrame:
    """``theory_moves``, the last one between two directories."""
    return theory_moves(found).groupBy("old_dir", "new_dir").agg(F.max(F.struct(*KEY, "file_no")).alias("at")).select("old_dir", "new_dir", "at.*")


def collisions(dirs: DataFrame) -> DataFrame:
    """Directories that share their last part with another."""
    short = last_part(F.col("dir"))
    return dirs.withColumn("_n", F.count("*").over(Window.partitionBy(short))).where("_n > 1").drop("_n")


def move_aliases(moves: DataFrame) -> DataFrame:
    """``short`` and ``label``: directories that theories moved between, named after the last move's destination."""
    part = components(moves.select(F.col("old_dir").alias("a"), F.col("new_dir").alias("b"))).withColumnRenamed("node", "dir")
    last = moves.join(part, moves["new_dir"] == part["dir"]).groupBy("part").agg(F.max_by("new_dir", F.struct("corpus_id", "seq", "file_no")).alias("dest"))
    named = part.join(last, "part").select(last_part(F.col("dir")).alias("short"), last_part(F.col("dest")).alias("label"))
    return named.where("short <> label").groupBy("short").agg(F.min("label").alias("label"))


def declared_targets(found: DataFrame, dirs: DataFrame) -> DataFrame:
    """``target`` and ``dir`` by ROOT files: a later record overrides an earlier one."""
    roots = found.where(last_part(F.col("path_new")).isin("ROOT", "ROOTS")).withColumn("dir", parent(F.col("path_new"))).join(dirs, "dir")
    shown = F.array_join(F.transform(F.filter(lines(F.col("body")), lambda ln: ln.rlike(r"^[ +]") & ~F.startswith(ln, F.lit("+++"))), lambda ln: F.substring(ln, 2, 1 << 30)), "\n")
    named = roots.where(F.contains("body", F.lit("session"))).select("dir", *KEY, "file_no", F.posexplode(root_sessions(shown)).alias("at", "target"))
    return named.groupBy("target").agg(F.max_by("dir", F.struct("corpus_id", "seq", "file_no", "at")).alias("dir"))


def co_occurring_targets(touched: DataFrame, dirs: DataFrame) -> DataFrame:
    """``target`` and ``dir`` where one directory goes with a target far more often than any other.

    Only records that touch exactly one directory count; a tie never passes.
    """
    known = touched.where("command IS NOT NULL").select("command", "dirs", "n", F.explode("dirs").alias("dir")).join(dirs, "dir", "left_semi")
    single = known.groupBy("command", "dirs", "n").agg(F.count("*").alias("_n"), F.min("dir").alias("dir")).where("_n = 1")
    counts = single.select("dir", "n", F.explode(targets(F.col("command"))).alias("target")).groupBy("target", "dir").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("target").orderBy(F.desc("n"), "dir")
    ranked = counts.withColumns({"rank": F.row_number().over(order), "runner": F.coalesce(F.lead("n").over(order), F.lit(0))})
    return ranked.where((F.col("rank") == 1) & (F.col("n") >= F.greatest(F.lit(1), F.col("runner") * DOMINANCE))).select("target", "dir")


def load_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``aliases`` and ``targets`` of an overrides file; a target of null is a declared exclusion.

    A missing file and an unknown key are errors; keys that begin with an underscore are notes.
    """
    text = spark.read.text(path, wholetext=True)
    keys = text.select(F.explode(F.json_object_keys("value")).alias("k")).where(~F.startswith("k", F.lit("_")) & ~F.col("k").isin("aliases", "targets"))
    unknown = [r["k"] for r in keys.limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown keys in overrides: {sorted(unknown)}")
    pairs = lambda name: text.select(F.explode(F.from_json(F.get_json_object("value", f"$.{name}"), "map<string,string>")).alias("k", "v"))
    return pairs("aliases").toDF("short", "label"), pairs("targets").toDF("target", "dir")


def fit(attempts: DataFrame, overrides: tuple[DataFrame, DataFrame] | None = None) -> Attribution:
    """The tables of an attribution. ``attempts`` are read twice: for what records touch, and for moves and declarations."""
    pairs = landed(touched(attempts), "touched")
    found = landed(marked(attempts), "marked")
    first = landed(session_dirs(pairs), "dirs")
    clash = landed(collisions(first), "collisions")
    moves = landed(last_moves(found), "moves")
    dirs = landed(first.unionByName(moves.select(F.explode(F.array("old_dir", "new_dir")).alias("dir"))).distinct(), "dirs")
    aliases = move_aliases(moves)
    declared = landed(declared_targets(found, dirs), "declared")
    named = declared.unionByName(co_occurring_targets(pairs, dirs).join(declared, "target", "left_anti"))
    if overrides:
        aliases = overrides[0].unionByName(aliases.join(overrides[0], "short", "left_anti"))
        named = overrides[1].unionByName(named.join(overrides[1], "target", "left_anti"))
    aliases = landed(aliases, "aliases")
    # The tables have a row a directory or target: written, so that what joins them knows how small they are.
    return Attribution(dirs, landed(labels(dirs, clash, aliases), "labels"), landed(named, "targets"), aliases, clash)


def labels(dirs: DataFrame, clash: DataFrame, aliases: DataFrame) -> DataFrame:
    """``dir`` and ``label``: the last part, or the whole path if that collides, then its alias."""
    short = dirs.join(clash.withColumn("_c", F.lit(True)), "dir", "left").select("dir", F.when(F.col("_c"), F.col("dir")).otherwise(last_part(F.col("dir"))).alias("short"))
    return short.join(aliases, "short", "left").select("dir", F.coalesce("label", "short").alias("label"))


def suffixes(path: Column) -> Column:
    """A directory path and all that is left of it without its first parts."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def prefixes(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def locus_labels(loci: DataFrame, at: Attribution) -> DataFrame:
    """``loci`` (with ``theory``) and ``label``: by a known directory that its path ends in, else by its qualifier.

    Of several directories the longest, then the first in order. A path that ends in none has no label.
    """
    path = F.regexp_replace(F.regexp_extract("theory", _PATH, 1), "/+$", "")
    names = loci.select("theory").where("theory <> ''").distinct().withColumn("_path", path)
    tails = names.where("_path <> ''").select("theory", F.explode(suffixes(F.col("_path"))).alias("dir")).join(at.labels, "dir")
    best = tails.groupBy("theory").agg(F.min_by("label", F.struct(-F.length("dir"), F.col("dir"))).alias("label"))
    qualified = names.where("_path = '' AND contains(theory, '.')").select("theory", F.substring_index("theory", ".", 1).alias("target"))
    # A name has a path or none, so it is in one of the two.
    by_name = qualified.join(at.targets, "target").join(at.labels, "dir").select("theory", "label")
    return loci.join(landed(best.unionByName(by_name), "names"), "theory", "left")


def _outside(known: DataFrame, at: Attribution) -> DataFrame:
    """Those of ``commands`` whose load directories reach no known directory. Commands without any are not outside.

    A load directory reaches a session directory if some end of it is a beginning of that, or that of it.
    """
    loads = known.select("command", F.explode(load_dirs(F.col("command"))).alias("load"))
    tails = loads.select("load").distinct().select("load", F.explode(suffixes(F.col("load"))).alias("tail"))
    begins = at.dirs.select(F.explode(prefixes(F.col("dir"))).alias("tail")).distinct()
    one = tails.join(begins, "tail", "left_semi").select("load")
    whole = tails.select("load", F.explode(prefixes(F.col("tail"))).alias("dir")).join(at.dirs, "dir", "left_semi").select("load")
    reached = one.unionByName(whole).distinct().withColumn("_in", F.lit(True))
    return landed(loads.join(reached, "load", "left").groupBy("command").agg(F.bool_or(F.coalesce("_in", F.lit(False))).alias("_in")).where("NOT _in").select("command"), "outside")


def loaded_outside(attempts: DataFrame, at: Attribution) -> DataFrame:
    """Keys of records whose command is one of ``_outside``."""
    return attempts.select(*KEY, "command").join(_outside(commands(attempts), at), "command", "left_semi").select(*KEY)


def command_labels(known: DataFrame, at: Attribution) -> DataFrame:
    """``command`` and ``label``: the one label its load directories name, else its one mapped target's; not if loaded from outside."""
    inside = known.select("command").join(_outside(known, at), "command", "left_anti")
    one = lambda rows: rows.groupBy("command").agg(F.collect_set("label").alias("_l")).where(F.size("_l") == 1).select("command", F.col("_l")[0].alias("label"))
    named = one(inside.select("command", F.explode(load_dirs(F.col("command"))).alias("dir")).join(at.labels, "dir"))
    mapped = inside.select("command", F.explode(targets(F.col("command"))).alias("target")).join(at.targets.where("dir IS NOT NULL"), "target").select("command", "dir").distinct()
    single = mapped.groupBy("command").agg(F.count("*").alias("_n"), F.min("dir").alias("dir")).where("_n = 1").join(at.labels, "dir").select("command", "label")
    return landed(named.unionByName(single.join(named, "command", "left_anti")), "command-labels")


def project(attempts: DataFrame, at: Attribution) -> DataFrame:
    """One row an episode: ``project`` and the ``route`` that gave it.

    Directories of code files come first, then those of errors, then, if no
    code file lies outside, the command's.
    """
    places = F.transform(F.filter(kinds(F.col("diff")), lambda f: f["code"]), lambda f: parent(f["path_new"]))
    code = attempts.select(*EPISODE, F.explode(places).alias("dir")).join(at.labels, "dir", "left").select(*EPISODE, F.col("label").alias("code"), F.col("label").isNull().alias("other"))
    named = attempts.select(*EPISODE, F.explode(F.array_append(F.transform(F.coalesce("error_loci", F.array().cast("array<array<string>>")), lambda x: F.get(x, F.lit(0))), F.coalesce("error_head", F.lit("")))).alias("theory"))
    error = locus_labels(named.where("theory <> ''"), at).where("label IS NOT NULL").select(*EPISODE, F.col("label").alias("error"))
    command = attempts.select(*EPISODE, "command").join(command_labels(commands(attempts), at), "command").select(*EPISODE, F.col("label").alias("command"))
    # One grouping of all that is known: of labels only the first and the last, which tell one from several.
    rows = attempts.select(*EPISODE)
    for part in (code, error, command):
        rows = rows.unionByName(part, allowMissingColumns=True)
    sides = ("code", "error", "command")
    every = rows.groupBy(*EPISODE).agg(*[f(c).alias(n + c) for c in sides for f, n in ((F.min, "_"), (F.max, "_last_"))], F.bool_or("other").alias("_other"))
    some = lambda c: F.col(f"_{c}").isNotNull()
    other = F.coalesce("_other", F.lit(False))
    route = F.when(some("code"), "diff").when(some("error"), "error").when(some("command") & ~other, "command").otherwise("none")
    one = lambda c: F.when(F.col(f"_{c}") == F.col(f"_last_{c}"), F.col(f"_{c}")).otherwise("mixed")
    name = F.when(route == "diff", one("code")).when(route == "error", one("error")).when(route == "command", one("command")).when(other, "tooling").otherwise("none")
    return every.select(*EPISODE, name.alias("project"), route.alias("route"))


def proof_bearing(attempts: DataFrame, at: Attribution) -> DataFrame:
    """One row an episode: whether it worked on proofs.

    That takes code in a theory, an error that a directory is known for, any locus, a timeout, or a head naming a theory's line.
    """
    theory = file_verdicts(files(attempts)).where("suffix = '.thy' AND verdict = 'code'").select(*KEY).distinct().withColumn("_thy", F.lit(True))
    heads = attempts.where("error_head IS NOT NULL").select(*KEY, F.col("error_head").alias("theory"))
    known = locus_labels(heads, at).where("label IS NOT NULL").select(*KEY).distinct().withColumn("_dir", F.lit(True))
    rows = attempts.join(theory, KEY, "left").join(known, KEY, "left")
    flag = F.coalesce("_thy", F.lit(False)) | F.coalesce("_dir", F.lit(False)) | F.coalesce(F.size("error_loci") > 0, F.lit(False)) | (F.col("outcome") == "timeout") | F.coalesce(F.col("error_head").rlike(_BY_LINE), F.lit(False))
    return rows.groupBy(*EPISODE).agg(F.bool_or(flag).alias("proof_bearing"))


def target_usage(attempts: DataFrame, at: Attribution) -> DataFrame:
    """Build targets with how often each is named and what the map says of it."""
    known = commands(attempts)
    used = known.join(_outside(known, at).withColumn("_out", F.lit(True)), "command", "left").select("n", "_out", F.explode(targets(F.col("command"))).alias("target"))
    counts = used.groupBy("target").agg(F.sum("n").alias("n"), F.bool_and(F.coalesce("_out", F.lit(False))).alias("_outside"))
    rows = counts.join(at.targets.withColumn("_known", F.lit(True)), "target", "left")
    verdict = F.when(F.col("_known") & F.col("dir").isNotNull(), "mapped").when(F.col("_known"), "excluded").when(F.col("_outside"), "outside").otherwise("not derived")
    return rows.select("target", "n", "dir", verdict.alias("verdict"))


def routes(projects: DataFrame) -> DataFrame:
    """How many episodes each route carried."""
    return projects.groupBy("route").agg(F.count("*").alias("episodes"))


def residue(attempts: DataFrame, projects: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: episodes labelled none and tooling, targets without a directory that those name, and a status."""
    left = landed(projects.where("project IN ('none', 'tooling')").select(*EPISODE, "project"), "left")
    counts = left.agg(F.count_if(F.col("project") == "none").alias("none"), F.count_if(F.col("project") == "tooling").alias("tooling"))
    named = commands(attempts).select("command", F.explode(targets(F.col("command"))).alias("target"))
    told = landed(named.join(usage.where("verdict = 'not derived'"), "target", "left_semi"), "told")
    hit = attempts.select(*EPISODE, "command").join(told.select("command").distinct(), "command", "left_semi").join(left, EPISODE, "left_semi").select("command").distinct()
    bites = told.join(hit, "command", "left_semi").agg(F.countDistinct("target").alias("unmapped"))
    return counts.join(F.broadcast(bites), how="cross").withColumn("status", F.when(F.col("unmapped") > 0, "failing").otherwise("ok"))  # one row with one row


def children_without_heap(attempts: DataFrame, parents: DataFrame) -> DataFrame:
    """``session`` (the first that a command names) and ``children``: sessions that extend it and find no heap stored.

    ``parents`` has ``child`` and ``parent``. None are listed where the command stores all heaps, or also
    builds any child, which stores the heap in passing. Commands without a session have no row.
    """
    below = parents.where("child <> parent").groupBy(F.col("parent").alias("session")).agg(F.array_sort(F.collect_set("child")).alias("_below"))
    read = attempts.select(*KEY, build_options(F.col("command")).alias("o")).where(F.size("o.sessions") > 0)
    rows = read.select(*KEY, F.col("o.sessions")[0].alias("session"), F.slice("o.sessions", 2, F.greatest(F.size("o.sessions") - 1, F.lit(0))).alias("_also"), F.array_contains("o.flags", "b").alias("_all")).join(below, "session", "left")
    none = F.array().cast("array<string>")
    listed = F.when(F.col("_all") | F.arrays_overlap("_also", F.coalesce("_below", none)), none).otherwise(F.coalesce("_below", none))
    return rows.select(*KEY, "session", listed.alias("children"))
