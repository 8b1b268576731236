"""Attempts of ten shapes, so that the branches of diffs and attribution are reached, with queries over them.

The shape of an attempt is its event's number modulo ten: a deletion, two
hunks, two files, a prose cartouche, a nested comment, prose whose beginning the
hunk does not show, a move, a ROOT declaration, no diff, and a hunk whose
header stands in prose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.functions.scalars import root_parents
from tryloom.operators import attribution, diffs, episodes, integrity
from tryloom.plans import mapping
from tryloom.plans.queries import query
from tryloom.schemas import conform
from tryloom.sources.corpus import pool
from tryloom.sources.shared import landed

_DIR = "concat('t/s', user_id % 6)"
_NEXT = "concat('t/s', (user_id + 1) % 6)"
_THY = f"concat({_DIR}, '/T', event_id % 4, '.thy')"
#: A second directory of the same name, for some attempts.
_OTHER = "concat(CASE WHEN user_id % 6 = 0 THEN 'u/s0' ELSE concat('t/s', user_id % 6) END, '/T', event_id % 4, '.thy')"
_ROOT = f"concat({_DIR}, '/ROOT')"


def _file(old: str, new: str, *lines: str) -> str:
    parts = ["'diff --git a/'", old, "' b/'", new, "chr(10)", "'--- a/'", old, "chr(10)", "'+++ b/'", new, "chr(10)"]
    for line in lines:
        parts += [line, "chr(10)"]
    return "concat(" + ", ".join(parts) + ")"


_O, _C = "concat(chr(92), '<open>')", "concat(chr(92), '<close>')"
_DIFF = f"""CASE event_id % 10
 WHEN 0 THEN {_file(_THY, _THY, "'@@ -3,2 +3,1 @@'", "' lemma a'", "concat('-lemma l', event_id, ': True')")}
 WHEN 1 THEN {_file(_OTHER, _OTHER, "'@@ -1,1 +1,2 @@'", "' x'", "concat('+lemma  p', event_id)", "'@@ -9,1 +10,2 @@'", "' y'", "concat('+lemma q', event_id, ' ')")}
 WHEN 2 THEN concat({_file(_THY, _THY, "'@@ -1,1 +1,2 @@'", "' x'", "concat('+lemma m', event_id)")}, {_file(f"concat({_DIR}, '/R.md')", f"concat({_DIR}, '/R.md')", "'@@ -1,1 +1,2 @@'", "' x'", "'+words'")})
 WHEN 3 THEN {_file(_THY, _THY, "'@@ -1,1 +1,3 @@'", f"concat(' section ', {_O}, 'A', {_C})", f"concat('+text ', {_O}, 'some words ', event_id)", f"concat('+more', {_C})")}
 WHEN 4 THEN {_file(_THY, _THY, "'@@ -1,1 +1,2 @@'", "' x'", "concat('+(* a (* b *) c', event_id, ' *)')")}
 WHEN 5 THEN {_file(_THY, _THY, "'@@ -4,2 +4,3 @@'", "' words'", "concat('+still words ', event_id)", f"concat(' tail of it', {_C})")}
 WHEN 6 THEN {_file(f"concat({_DIR}, '/M.thy')", f"concat({_NEXT}, '/M.thy')", "'@@ -1,1 +1,2 @@'", "' x'", "concat('+lemma v', event_id)")}
 WHEN 7 THEN {_file(_ROOT, _ROOT, "'@@ -1,1 +1,2 @@'", "' (* *)'", "concat('+session S', event_id % 3, ' = HOL +')")}
 WHEN 8 THEN ''
 ELSE {_file(_THY, _THY, f"concat('@@ -1,1 +1,2 @@ text ', {_O}, 'intro')", "' words'", "concat('+prose ', event_id)")} END"""
_COMMAND = f"""CASE event_id % 5
 WHEN 0 THEN array('isabelle', 'build', '-d', {_DIR}, concat('S', event_id % 3))
 WHEN 1 THEN array('isabelle', 'build', 'X')
 WHEN 2 THEN array('isabelle', 'build', '-d', 'scratch/x', 'O')
 WHEN 3 THEN array('isabelle', 'build', '-d', 't', 'N')
 ELSE array('isabelle', 'build', concat('C', user_id % 6)) END"""
_COLUMNS = mapping.ATTEMPT_COLUMNS[: mapping.ATTEMPT_COLUMNS.index("CASE WHEN event_id % 5 = 0 THEN '' ELSE")] + f"{_DIFF} AS diff, CAST(NULL AS STRING) AS error_head, CAST(NULL AS STRING) AS note"
_ROWS = f"WITH attempts AS (SELECT CAST(ROW_NUMBER() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS BIGINT) AS seq, {_COLUMNS.replace('AS STRING', 'AS VARCHAR')} FROM events), v AS (SELECT *, event_id % 10 AS k, concat('t/s', user_id % 6) AS dir, concat('t/s', user_id % 6, '/T', event_id % 4, '.thy') AS thy, concat(CASE WHEN user_id % 6 = 0 THEN 'u/s0' ELSE concat('t/s', user_id % 6) END) AS other FROM attempts)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(mapping.numbered(spark, sf_dir))


def _shaped(rows: DataFrame) -> DataFrame:
    return conform(rows.sparkSession.sql(f"SELECT {_COLUMNS}, {_COMMAND} AS command, seq FROM {{events}}", events=rows))


_CODE = """SELECT corpus_id, seq, 0 AS file_no, CASE k WHEN 1 THEN concat(other, '/T', event_id % 4, '.thy') WHEN 6 THEN concat('t/s', (user_id + 1) % 6, '/M.thy') WHEN 7 THEN concat(dir, '/ROOT') ELSE thy END AS path_new,
 CASE WHEN k IN (0, 1, 2, 6, 7) THEN 'code' ELSE 'doc' END AS verdict,
 CASE k WHEN 0 THEN concat('-lemma l', event_id, ': True') WHEN 1 THEN concat('+lemma p', event_id, '|+lemma q', event_id) WHEN 2 THEN concat('+lemma m', event_id) WHEN 6 THEN concat('+lemma v', event_id) WHEN 7 THEN concat('+session S', event_id % 3, ' = HOL +') ELSE '' END AS evidence FROM v WHERE k <> 8"""


@query("varied_verdicts", _ROWS + f" {_CODE} UNION ALL SELECT corpus_id, seq, 1, concat(dir, '/R.md'), 'doc', '' FROM v WHERE k = 2")
def varied_verdicts(spark, sf_dir):
    found = diffs.file_verdicts(diffs.files(attempts(spark, sf_dir)))
    return found.select("corpus_id", "seq", "file_no", "path_new", "verdict", F.array_join("evidence", "|").alias("evidence"))


@query("varied_stat", _ROWS + """, f AS (SELECT corpus_id, seq, 0 AS file_no, CASE WHEN k = 0 THEN 0 WHEN k IN (1, 3) THEN 2 ELSE 1 END AS a, CASE WHEN k = 0 THEN 1 ELSE 0 END AS d FROM v WHERE k <> 8 UNION ALL SELECT corpus_id, seq, 1, 1, 0 FROM v WHERE k = 2)
 SELECT corpus_id, seq, file_no, sum(a)::BIGINT AS added, sum(d)::BIGINT AS deleted FROM f GROUP BY GROUPING SETS ((corpus_id, seq, file_no), (corpus_id, seq))""")
def varied_stat(spark, sf_dir):
    return diffs.stat(diffs.files(attempts(spark, sf_dir))).select("corpus_id", "seq", "file_no", "added", "deleted")


@query("varied_hunks", _ROWS + """ SELECT corpus_id, seq, i AS hunk_no, CASE WHEN k = 9 THEN concat('text ', chr(92), '<open>intro') ELSE '' END AS ctx,
 (CASE WHEN k = 0 THEN 3 WHEN k = 5 THEN 4 WHEN i = 1 THEN 9 ELSE 1 END)::INT AS old_start, (CASE WHEN k IN (0, 5) THEN 2 ELSE 1 END)::INT AS old_len, (CASE WHEN k = 0 THEN 3 WHEN k = 5 THEN 4 WHEN i = 1 THEN 10 ELSE 1 END)::INT AS new_start, (CASE WHEN k = 0 THEN 1 WHEN k IN (3, 5) THEN 3 ELSE 2 END)::INT AS new_len
 FROM v, (VALUES (0), (1)) t(i) WHERE k <> 8 AND (i = 0 OR k = 1)""")
def varied_hunks(spark, sf_dir):
    return diffs.hunks(diffs.files(attempts(spark, sf_dir)).where("file_no = 0")).select("corpus_id", "seq", "hunk_no", "ctx", "old_start", "old_len", "new_start", "new_len")


@query("varied_moves", _ROWS + " SELECT DISTINCT dir AS old_dir, concat('t/s', (user_id + 1) % 6) AS new_dir FROM v WHERE k = 6")
def varied_moves(spark, sf_dir):
    return diffs.theory_moves(diffs.files(attempts(spark, sf_dir))).select("old_dir", "new_dir").distinct()


_FACTS = _ROWS + """, m AS (SELECT corpus_id, seq, dir AS a, concat('t/s', (user_id + 1) % 6) AS b FROM v WHERE k = 6),
 touched AS (SELECT corpus_id, seq, CASE k WHEN 1 THEN other WHEN 6 THEN concat('t/s', (user_id + 1) % 6) ELSE dir END AS dir FROM v WHERE k NOT IN (7, 8)),
 dirs AS (SELECT dir FROM touched UNION SELECT a FROM m UNION SELECT b FROM m),
 seen AS (SELECT DISTINCT dir FROM touched), clash AS (SELECT dir FROM seen WHERE regexp_extract(dir, '[^/]*$') IN (SELECT regexp_extract(dir, '[^/]*$') FROM seen GROUP BY 1 HAVING count(*) > 1)),
 latest AS (SELECT arg_max(b, (corpus_id, seq)) AS b FROM m), moved AS (SELECT a AS d FROM m UNION SELECT b FROM m),
 labels AS (SELECT d.dir, CASE WHEN d.dir IN (SELECT dir FROM clash) THEN d.dir WHEN d.dir IN (SELECT d FROM moved) AND d.dir <> l.b THEN regexp_extract(l.b, '[^/]*$') ELSE regexp_extract(d.dir, '[^/]*$') END AS label FROM dirs d, latest l)"""


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, attribution.Attribution]:
    rows = _shaped(landed(mapping.numbered(spark, sf_dir).select(*mapping.NUMBERED), "attempts"))
    excluded = spark.range(1).select(F.lit("X").alias("target"), F.lit(None).cast("string").alias("dir"))
    return rows, attribution.fit(rows, (spark.range(0).select(F.lit("").alias("short"), F.lit("").alias("label")), excluded))


@query("varied_labels", _FACTS + " SELECT dir, label FROM labels")
def varied_labels(spark, sf_dir):
    return _fitted(spark, sf_dir)[1].labels.select("dir", "label")


_TARGETS = _FACTS + """, cmd AS (SELECT corpus_id, seq, CASE event_id % 5 WHEN 0 THEN concat('S', event_id % 3) WHEN 1 THEN 'X' WHEN 2 THEN 'O' WHEN 3 THEN 'N' ELSE concat('C', user_id % 6) END AS target FROM v),
 declared AS (SELECT concat('S', event_id % 3) AS target, arg_max(dir, (corpus_id, seq)) AS dir FROM v WHERE k = 7 AND dir IN (SELECT dir FROM dirs) GROUP BY 1),
 co AS (SELECT target, dir, count(*) AS n FROM touched JOIN cmd USING (corpus_id, seq) GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER w AS r, coalesce(lead(n) OVER w, 0) AS nx FROM co WINDOW w AS (PARTITION BY target ORDER BY n DESC, dir)),
 named AS (SELECT 'X' AS target, NULL AS dir UNION ALL SELECT * FROM declared UNION ALL SELECT target, dir FROM rk WHERE r = 1 AND n >= greatest(1, 3 * nx) AND target NOT IN (SELECT target FROM declared) AND target <> 'X')"""


@query("varied_targets", _TARGETS + " SELECT target, dir FROM named")
def varied_targets(spark, sf_dir):
    return _fitted(spark, sf_dir)[1].targets.select("target", "dir")


@query("varied_usage", _TARGETS + " SELECT c.target, count(*) AS n, CASE WHEN n.target IS NOT NULL AND n.dir IS NOT NULL THEN 'mapped' WHEN n.target IS NOT NULL THEN 'excluded' WHEN c.target = 'O' THEN 'outside' ELSE 'not derived' END AS verdict FROM cmd c LEFT JOIN named n ON n.target = c.target GROUP BY 1, n.target, n.dir")
def varied_usage(spark, sf_dir):
    rows, at = _fitted(spark, sf_dir)
    return attribution.target_usage(rows, at).select("target", "n", "verdict")


@query("heap_children", "SELECT event_id, concat('S', user_id % 6) AS session, CASE WHEN event_id % 4 = 0 OR (event_id % 4 = 1 AND user_id % 6 < 3) THEN '' ELSE CASE user_id % 6 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2,S3' WHEN 2 THEN 'S4,S5' ELSE '' END END AS children FROM events")
def heap_children(spark, sf_dir):
    events = mapping._read(spark, sf_dir, "events")
    stanza = F.expr("concat('(* session Z = Y + *)', chr(10), 'session S', user_id % 6, ' (main) in \"x\" = \"S', CAST(FLOOR((user_id % 6) / 2) AS INT), '\" +', chr(10), '  theories A')")
    parents = events.select(F.inline(root_parents(stanza))).distinct()
    command = F.expr("CASE event_id % 4 WHEN 0 THEN array('isabelle', 'build', '-bv', concat('S', user_id % 6)) WHEN 1 THEN array('isabelle', 'build', '-d', 't', concat('S', user_id % 6), concat('S', CASE user_id % 6 WHEN 0 THEN 1 ELSE 2 * (user_id % 6) END)) ELSE array('isabelle', 'build', '-o', 'a=1', concat('S', user_id % 6)) END")
    rows = events.select(F.lit("c").alias("corpus_id"), F.col("event_id").alias("seq"), command.alias("command"))
    found = attribution.children_without_heap(rows, parents)
    return found.select(F.col("seq").alias("event_id"), "session", F.array_join("children", ",").alias("children"))


@query("pooled_attempts", f"WITH attempts AS ({mapping.ATTEMPTS}) SELECT row_number() OVER (ORDER BY user_id % 4, seq) - 1 AS seq, instance_id, build_id FROM attempts")
def pooled_attempts(spark, sf_dir):
    rows = mapping.attempts(spark, sf_dir)
    return pool([rows.where(F.col("corpus_id") == f"c{i}") for i in range(4)]).select("seq", "instance_id", "build_id")


_REGENERATED = f"""WITH attempts AS ({mapping.ATTEMPTS}), p AS (SELECT *, lag(tree) OVER w AS pt, lag(git_head) OVER w AS ph FROM attempts WINDOW w AS (PARTITION BY corpus_id ORDER BY seq)),
 b AS (SELECT *, CASE WHEN pt IS NULL OR ph IS DISTINCT FROM git_head THEN concat('r', CAST(FLOOR(event_id / 50) AS INT)) ELSE pt END AS base FROM p)"""


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping._read(spark, sf_dir, "events").select(F.expr("concat('h', CAST(FLOOR(event_id / 50) AS INT))").alias("git_head"), F.expr("concat('r', CAST(FLOOR(event_id / 50) AS INT))").alias("head_tree")).distinct()


@query("regenerated_diffs", _REGENERATED + " SELECT corpus_id, seq, base, CASE WHEN base LIKE 't%' AND substr(base, 2)::BIGINT % 3 > 0 AND (event_id - event_id % 2) % 7 > 0 AND (event_id - event_id % 2) % 3 > 0 THEN concat(base, '>', tree) END AS regen FROM b")
def regenerated_diffs(spark, sf_dir):
    """Trees whose number is divisible by three are lost, those by seven have no diff; a diff here names its two trees."""
    rows = mapping.attempts(spark, sf_dir)
    known = rows.select("tree").distinct().where("CAST(substr(tree, 2) AS BIGINT) % 3 > 0")
    pairs = episodes.base_trees(rows, _trees(spark, sf_dir)).where("CAST(substr(tree, 2) AS BIGINT) % 7 > 0").select("base", "tree").distinct().withColumn("diff", F.concat("base", F.lit(">"), "tree"))
    return integrity.with_regenerated(rows, _trees(spark, sf_dir), pairs, known).select("corpus_id", "seq", "base", "regen")


@query("backfilled_diffs", f"""WITH attempts AS ({mapping.ATTEMPTS}), m AS (SELECT corpus_id, seq, git_head, CASE WHEN event_id % 4 > 0 THEN tree END AS tree FROM attempts),
 l AS (SELECT *, last_value(CASE WHEN tree IS NOT NULL THEN tree END IGNORE NULLS) OVER w AS lt, last_value(CASE WHEN tree IS NOT NULL THEN git_head END IGNORE NULLS) OVER w AS lh FROM m WINDOW w AS (PARTITION BY corpus_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT corpus_id, seq, tree, CASE WHEN tree IS NULL THEN NULL WHEN lt IS NULL OR lh IS DISTINCT FROM git_head THEN concat('r', substr(git_head, 2)) ELSE lt END AS base, tree IS NOT NULL AS backfilled FROM l""")
def backfilled_diffs(spark, sf_dir):
    rows = mapping.attempts(spark, sf_dir)
    chain = rows.where("event_id % 4 > 0").select("build_id", "tree")
    made = integrity.backfilled(rows, chain, _trees(spark, sf_dir), rows.limit(0).select(F.col("tree").alias("base"), "tree", F.lit("").alias("diff")))
    return made.select("corpus_id", "seq", "tree", "base", F.col("tree").isNotNull().alias("backfilled"))


__all__ = ["attempts"]
