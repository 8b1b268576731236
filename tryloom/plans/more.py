"""Queries over sinks, source sizes, writer's arithmetic, materialised trees, comparisons, notes of kills and damaged diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.functions import scalars
from tryloom.operators import attribution, episodes, integrity, lengths, logs, size
from tryloom.plans import mapping, queries
from tryloom.plans.queries import _ATTEMPTS, _EPISODES, _FIT, _SIDES, query
from tryloom.plans.varied import _trees
from tryloom.schemas import FIELDS, conform
from tryloom.sources import corpus
from tryloom.sources.shared import landed, own_path, settled


@query("written_histogram", _EPISODES + " SELECT len_code AS length, count(*) AS trajectories FROM e WHERE is_closed AND len_code > 0 GROUP BY 1")
def written_histogram(spark, sf_dir):
    """The length histogram as both sinks have written it."""
    hist = landed(episodes.histogram(episodes.summary(queries._classified(spark, sf_dir))), "lengths")  # a row a length, for both
    csv, json = own_path(spark, "histogram"), own_path(spark, "histogram")
    corpus.write_histogram(hist, csv)
    corpus.write_histogram(hist, json, "json")
    schema = "length long, trajectories long"
    return spark.read.schema(schema).option("header", True).csv(csv).join(spark.read.schema(schema).json(json), ["length", "trajectories"])


@query("source_tree_bytes", "SELECT true AS some_files, sum(coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS bytes, sum(coalesce(octet_length(encode(text)), 0) + 1) FILTER (WHERE source LIKE 'src1%')::BIGINT AS tracked_bytes FROM documents")
def source_tree_bytes(spark, sf_dir):
    """Texts as files of a tree by source, and how much of it lies in tracked files."""
    path = own_path(spark, "tree")
    mapping._read(spark, sf_dir, "documents").select("text", "source").write.partitionBy("source").text(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path")
    tracked = size.source_bytes(spark, path, listed.where("path LIKE '%source=src1%'"), "*.txt").select(F.col("bytes").alias("tracked_bytes"))
    return size.source_bytes(spark, path, glob="*.txt").join(F.broadcast(tracked), how="cross").select((F.col("files") > 0).alias("some_files"), "bytes", "tracked_bytes")  # one row with one row


_WRITER = {"battery_factor": "CASE user_id % 5 WHEN 0 THEN 2.0 WHEN 1 THEN 0.0 END", "load_factor": "CASE WHEN event_id % 3 = 0 THEN 1.5 END", "head_tree": "concat('t', event_id - event_id % 4)", "note_mtime": "event_id % 100", "now": "100 + event_id % 7"}
_WRITTEN = _ATTEMPTS + ", w AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _WRITER.items()) + " FROM a)"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.attempts(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _WRITER.items()})
    return rows.withColumns({c: F.col(c).cast("double") for c in ("battery_factor", "load_factor", "note_mtime", "now")})


@query("derived_columns", _WRITTEN + " SELECT event_id, round(elapsed_s / coalesce(nullif(battery_factor::DOUBLE, 0), 1), 1) AS elapsed_s_ac, tree <> head_tree AS head_dirty, (now - note_mtime)::DOUBLE AS note_age_s, note_mtime <= now - elapsed_s AS note_pre_build FROM w")
def derived_columns(spark, sf_dir):
    return episodes.derived(_written(spark, sf_dir)).select("event_id", "elapsed_s_ac", "head_dirty", "note_age_s", "note_pre_build")


@query("effective_budgets", _WRITTEN + " SELECT event_id, wall_timeout * coalesce(battery_factor::DOUBLE, 1) * coalesce(load_factor::DOUBLE, 1) AS budget FROM w")
def effective_budgets(spark, sf_dir):
    return _written(spark, sf_dir).select("event_id", scalars.budget(F.col("wall_timeout"), F.col("battery_factor"), F.col("load_factor")).alias("budget"))


@query("truncated_heads", _ATTEMPTS + " SELECT event_id, CASE WHEN length(error_head) > 60 THEN concat(left(error_head, 59), '…') ELSE error_head END AS head FROM a")
def truncated_heads(spark, sf_dir):
    return mapping.attempts(spark, sf_dir).select("event_id", scalars.truncated(F.col("error_head"), 60).alias("head"))


@query("materialised_tree", f"WITH attempts AS ({mapping.ATTEMPTS}) SELECT concat('f', event_id) AS path, length(text) AS chars, sha256(text) AS content_sha256 FROM events JOIN documents ON doc_id = event_id % 200 WHERE text IS NOT NULL AND concat('t', 2 * (event_id % 50)) IN (SELECT tree FROM attempts WHERE build_id = 'b41')")
def materialised_tree(spark, sf_dir):
    entries = mapping._read(spark, sf_dir, "events").select(F.expr("concat('t', 2 * (event_id % 50))").alias("tree"), F.expr("concat('f', event_id)").alias("path"), F.expr("concat('d', event_id % 200)").alias("blob_id"))
    blobs = mapping._read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr("concat('d', doc_id)").alias("blob_id"), F.col("text").alias("content"))
    found = integrity.materialised(mapping.attempts(spark, sf_dir), "b41", entries, blobs)
    return found.select("path", F.length("content").cast("long").alias("chars"), F.sha2("content", 256).alias("content_sha256"))


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = settled(queries._episodes(spark, sf_dir))  # a row an episode, read four times
    sided = lengths.choose_groups(counted.where("is_closed AND len_attempt > 0"))
    hist = sided.groupBy("side", F.col("len_attempt").alias("length")).agg(F.count("*").alias("trajectories"))
    return lengths.compare(lengths.choose_groups(lengths.trials(counted)), hist)


@query("head_to_head", _SIDES + """, t AS (SELECT sum(n_a)::DOUBLE AS n_a, sum(x_a)::DOUBLE AS x_a, sum(n_b)::DOUBLE AS n_b, sum(x_b)::DOUBLE AS x_b FROM dy), r AS (SELECT *, x_a / n_a AS ra, x_b / n_b AS rb FROM t), sx AS (SELECT *, sqrt(ra * (1 - ra) / n_a + rb * (1 - rb) / n_b) AS se FROM r)
SELECT n_a, n_b, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(ra - rb, 6) AS gap, round(ra - rb - 1.96 * se, 6) AS low, round(ra - rb + 1.96 * se, 6) AS high FROM sx""")
def head_to_head(spark, sf_dir):
    return _compared(spark, sf_dir)[0].select("n_a", "n_b", "rate_a", "rate_b", "gap", "low", "high")


@query("head_to_head_tails", _EPISODES + ", e0 AS (SELECT * FROM e WHERE is_closed AND len_attempt > 0), big AS (SELECT arg_min(project, (-n, project)) AS a FROM (SELECT project, count(*) AS n FROM e0 GROUP BY 1)), es AS (SELECT e0.* REPLACE (CASE WHEN project = a THEN 'a' ELSE 'b' END AS project) FROM e0, big)" + _FIT.replace("FROM e WHERE", "FROM es WHERE").replace("SELECT project, n_tail::BIGINT", "SELECT project AS side, n_tail::BIGINT"))
def head_to_head_tails(spark, sf_dir):
    return _compared(spark, sf_dir)[1]


def _lines(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The mapped build log with other texts."""
    return mapping.build_log(spark, sf_dir, text)


def _log(text: str) -> str:
    return f"WITH log AS (SELECT l.build_id, l.line_no, l.t_s, x AS text, l_suppkey, l_partkey, l_linenumber FROM ({mapping.BUILD_LOG}) l JOIN (SELECT *, row_number() OVER ({mapping._LINE_ORDER}) AS k, {text} AS x FROM lineitem) i ON i.l_orderkey = l.build_id AND i.k = l.line_no)"


_SUMMED = """CASE WHEN l_linenumber % 4 = 0 AND l_orderkey % 2 = 0 THEN concat('Timing S (4 threads, ', l_suppkey % 100, '.5s elapsed time, ', l_partkey % 100, '.25s cpu time, 1.0s GC time)')
 WHEN l_linenumber % 4 = 1 THEN concat('0:0', l_suppkey % 10, ':', 10 + l_partkey % 50, ' elapsed time') WHEN l_linenumber % 4 = 2 THEN 'S: theory S.T 100%' ELSE 'x' END"""


@query("success_summaries", _log(_SUMMED) + """ SELECT build_id, count(*) FILTER (WHERE text LIKE '%100%') AS theories,
 coalesce(arg_max(l_suppkey % 100 + 0.5, line_no) FILTER (WHERE text LIKE 'Timing%'), arg_max(l_suppkey % 10 * 60 + 10 + l_partkey % 50, line_no) FILTER (WHERE text LIKE '%elapsed time' AND text LIKE '0:%'))::DOUBLE AS elapsed_s,
 (arg_max(l_partkey % 100 + 0.25, line_no) FILTER (WHERE text LIKE 'Timing%'))::DOUBLE AS cpu_s FROM log GROUP BY 1""")
def success_summaries(spark, sf_dir):
    return logs.success_summary(_lines(spark, sf_dir, _SUMMED))


_STUCK = """CASE l_linenumber WHEN 1 THEN 'Session X/Y' WHEN 2 THEN concat('Building D', l_suppkey % 3, ' ...') WHEN 3 THEN 'Running R ...'
 ELSE CASE WHEN l_returnflag = 'N' THEN concat('D: command "by" running for 15.0s (line ', 10 + l_orderkey % 3, ' of theory "D', l_orderkey % 3, '.T")') ELSE 'x' END END"""
_KILLED = "o_orderkey AS build_id, CASE o_orderkey % 3 WHEN 0 THEN 'wall' WHEN 1 THEN 'activity' ELSE 'loop_progress' END AS reason, CAST(30 AS DOUBLE) AS at_s, (o_orderkey % 10) / CAST(10 AS DOUBLE) AS duty, CAST(o_orderkey % 7 AS DOUBLE) AS cpu_s"


@query("kill_notes", _log(_STUCK) + f""", k AS (SELECT {_KILLED} FROM orders),
 ss AS (SELECT build_id, regexp_extract(text, '^[A-Z][a-z]+ ([A-Z0-9]+) ', 1) AS name, min(line_no) AS fst, arg_min(round(t_s, 1), line_no) AS begun, arg_min(text LIKE 'Building%', line_no) AS dep FROM log WHERE text LIKE '% ...' GROUP BY 1, 2),
 sb AS (SELECT build_id, string_agg(name, ', ' ORDER BY fst) FILTER (WHERE dep) AS deps, list(name) FILTER (WHERE dep) AS dl, arg_min(name, fst) AS first_name, arg_min(begun, fst)::DOUBLE AS begun FROM ss GROUP BY 1),
 lk AS (SELECT build_id, arg_max(regexp_extract(text, 'theory "([^"]+)"', 1), line_no) AS theory, arg_max(regexp_extract(text, 'line ([0-9]+) of', 1), line_no) AS line FROM log WHERE text LIKE '%running for%' GROUP BY 1),
 j AS (SELECT k.*, theory, line, deps, dl, first_name, begun, split_part(theory, '.', 1) AS own FROM k LEFT JOIN sb ON sb.build_id = k.build_id LEFT JOIN lk ON lk.build_id = k.build_id)
 SELECT build_id, CASE reason WHEN 'loop_progress' THEN 'LOOP' WHEN 'wall' THEN 'TIMEOUT' ELSE 'STUCK' END AS class, theory, line, CASE WHEN theory IS NOT NULL THEN 'by' END AS command, CASE WHEN theory IS NOT NULL THEN 15.0::DOUBLE END AS seconds,
 CASE WHEN theory IS NULL THEN '' ELSE concat(CASE WHEN reason = 'wall' THEN 'last at ' ELSE 'stuck at ' END, theory, ' line ', line) END AS locus,
 concat_ws('; ', CASE WHEN coalesce(list_contains(dl, own), false) THEN concat('stuck in dependency ', own) WHEN deps IS NOT NULL THEN concat('rebuilt first: ', deps) END,
  CASE WHEN begun >= 10 THEN concat(begun, 's before ', first_name, ' started') END,
  CASE WHEN duty < 0.05 THEN concat('no CPU in the last 15s, ', cpu_s, 's of CPU in 30s') WHEN duty < 0.9 THEN concat('contended: ', round(duty, 2), ' of a core') END) AS notes FROM j""")
def kill_notes(spark, sf_dir):
    killed = spark.sql(f"SELECT {_KILLED} FROM {{orders}}", orders=mapping._read(spark, sf_dir, "orders"))
    found = logs.explained(logs.events(_lines(spark, sf_dir, _STUCK)), killed.select("build_id", "reason", "at_s"), duty=killed.select("build_id", "duty", "cpu_s"))
    return found.select("build_id", "class", "theory", "line", "command", "seconds", "locus", F.array_join("notes", "; ").alias("notes"))


@query("backfilled_texts", f"""WITH attempts AS ({mapping.ATTEMPTS}), m AS (SELECT corpus_id, seq, git_head, CASE WHEN event_id % 4 > 0 THEN tree END AS tree FROM attempts),
 l AS (SELECT *, last_value(tree IGNORE NULLS) OVER w AS lt, last_value(CASE WHEN tree IS NOT NULL THEN git_head END IGNORE NULLS) OVER w AS lh FROM m WINDOW w AS (PARTITION BY corpus_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 b AS (SELECT *, CASE WHEN tree IS NULL THEN NULL WHEN lt IS NULL OR lh IS DISTINCT FROM git_head THEN concat('r', substr(git_head, 2)) ELSE lt END AS base FROM l)
 SELECT corpus_id, seq, base, tree, CASE WHEN substr(tree, 2)::BIGINT % 3 > 0 THEN concat(base, '>', tree) END AS diff, coalesce(substr(tree, 2)::BIGINT % 3 > 0, false) AS backfilled FROM b""")
def backfilled_texts(spark, sf_dir):
    """Diff-less records with the diffs of the trees that are left: two of three."""
    rows = mapping.attempts(spark, sf_dir)
    chain = rows.where("event_id % 4 > 0").select("build_id", "tree")
    none = rows.limit(0).select(F.col("tree").alias("base"), "tree", F.lit("").alias("diff"))
    pairs = integrity.backfilled(rows, chain, _trees(spark, sf_dir), none).where("CAST(substr(tree, 2) AS BIGINT) % 3 > 0").select("base", "tree").distinct()
    made = integrity.backfilled(rows, chain, _trees(spark, sf_dir), pairs.withColumn("diff", F.concat("base", F.lit(">"), "tree")))
    return made.select("corpus_id", "seq", "base", "tree", "diff", "backfilled")


_SHORT = "concat('diff --git a/p.thy b/p.thy', chr(10), '--- a/p.thy', chr(10), '+++ b/p.thy', chr(10), CASE event_id % 4 WHEN 0 THEN concat('@@ -1,2 +1,3 @@', chr(10), ' a', chr(10), ' b', chr(10), '+c', chr(10)) WHEN 1 THEN concat('@@ -1,3 +1,4 @@', chr(10), ' a', chr(10), '+c', chr(10)) WHEN 2 THEN concat('@@ -1,2 +1,3 @@', chr(10), ' a', chr(10), ' b', chr(10)) ELSE concat('@@ -1,2 +1,2 @@', chr(10), ' a', chr(10), '@@ -9,2 +9,2 @@', chr(10), ' b', chr(10)) END)"


@query("unverifiable_diffs", _ATTEMPTS + f" SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'unverified' WHEN 1 THEN 'stripped?' ELSE 'damaged' END AS verdict, CASE WHEN event_id % 4 = 1 THEN '2 context lines missing' END AS detail, event_id % 4 = 1 AS changed, length({_SHORT}) + CASE WHEN event_id % 4 = 1 THEN 4 ELSE 0 END AS chars FROM a")
def unverifiable_diffs(spark, sf_dir):
    """Diffs whose objects are gone, judged by their hunks alone, and the heuristic repair."""
    rows = mapping.attempts(spark, sf_dir).withColumns({"diff": F.expr(_SHORT), "base": F.col("tree"), "regen": F.lit(None).cast("string")})
    judged = integrity.verdicts(rows)
    fixed = integrity.repaired(judged, heuristic=True).select("event_id", "changed", F.length("diff").cast("long").alias("chars"))
    return judged.select("event_id", "verdict", "detail").join(fixed, "event_id")


_HELD = [c for c in FIELDS if c in ("build_id", "instance_id", "outcome", "timeout_reason", "elapsed_s", "power", "error_head", "git_head", "tree", "diff", "note")]
_SIZES = _ATTEMPTS + ", t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, sum({f'coalesce(length(to_json({c})::VARCHAR), 4)' if c in _HELD else '4'})::BIGINT AS chars FROM a" for c in FIELDS) + ")"


@query("record_bytes", _SIZES + " SELECT field, chars FROM t")
def record_bytes(spark, sf_dir):
    """Every field of a record."""
    return size.field_bytes(conform(mapping.attempts(spark, sf_dir)).select(*FIELDS))


@query("largest_record_fields", _SIZES + ", r AS (SELECT *, row_number() OVER (ORDER BY chars DESC, field) AS n FROM t) SELECT field, chars FROM r WHERE n <= 5 UNION ALL SELECT '(others)', sum(chars)::BIGINT FROM r WHERE n > 5")
def largest_record_fields(spark, sf_dir):
    return size.largest_fields(size.field_bytes(conform(mapping.attempts(spark, sf_dir)).select(*FIELDS)))


_OUTSIDE = "CASE event_id % 4 WHEN 0 THEN concat('diff --git a/tools/b.py b/tools/b.py', chr(10), '--- a/tools/b.py', chr(10), '+++ b/tools/b.py', chr(10), '@@ -1,1 +1,2 @@', chr(10), ' x', chr(10), '+y', event_id, chr(10)) WHEN 1 THEN concat('diff --git a/t/s', user_id % 6, '/A.thy b/t/s', user_id % 6, '/A.thy', chr(10), '--- a/t/s', user_id % 6, '/A.thy', chr(10), '+++ b/t/s', user_id % 6, '/A.thy', chr(10), '@@ -1,1 +1,2 @@', chr(10), ' x', chr(10), '+lemma l', event_id, chr(10)) ELSE '' END"


def _outside(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, attribution.Attribution]:
    """Attempts that are episodes of their own: a tool's code, a theory, a target that nothing maps, and nothing at all."""
    rows = mapping._read(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("e"), "event_id").alias("corpus_id"), F.lit(0).cast("long").alias("seq"), F.lit("fail").alias("outcome"))
    kept = landed(episodes.segment(rows), "attempts")  # read several times: texts are worked out when read
    made = conform(kept.withColumns({"build_id": F.concat(F.lit("b"), "event_id"), "diff": F.expr(_OUTSIDE), "command": F.expr("CASE WHEN event_id % 4 = 2 THEN array('isabelle', 'build', 'Z') END")}).drop("event_id", "user_id"))
    return made, attribution.fit(made)


@query("tooling_episodes", "SELECT CASE event_id % 4 WHEN 0 THEN 'tooling' WHEN 1 THEN concat('s', user_id % 6) ELSE 'none' END AS project, CASE event_id % 4 WHEN 1 THEN 'diff' ELSE 'none' END AS route, count(*) AS episodes FROM events GROUP BY 1, 2")
def tooling_episodes(spark, sf_dir):
    rows, at = _outside(spark, sf_dir)
    return attribution.project(rows, at).groupBy("project", "route").agg(F.count("*").alias("episodes"))


@query("failing_residue", "SELECT count(*) FILTER (WHERE event_id % 4 > 1) AS none, count(*) FILTER (WHERE event_id % 4 = 0) AS tooling, 1::BIGINT AS unmapped, 'failing' AS status FROM events")
def failing_residue(spark, sf_dir):
    rows, at = _outside(spark, sf_dir)
    return attribution.residue(rows, attribution.project(rows, at), attribution.target_usage(rows, at))


__all__ = ["record_bytes"]
