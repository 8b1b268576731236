"""One query for each group of operators, over the driver's tables, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.functions import argv, notes, scalars
from tryloom.operators import attribution, audits, diffs, episodes, integrity, lengths, logs, progress, size
from tryloom.operators.ordered import with_previous
from tryloom.plans import mapping
from tryloom.schemas import conform
from tryloom.sources.shared import landed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CLASS = "CASE WHEN event_id % 5 = 0 THEN 'none' WHEN event_id % 11 = 0 THEN 'doc' ELSE 'code' END"
_ATTEMPTS = f"WITH attempts AS ({mapping.ATTEMPTS}), a AS (SELECT *, {_CLASS} AS cls, lag(outcome) OVER (PARTITION BY corpus_id ORDER BY seq) AS po, row_number() OVER (PARTITION BY corpus_id ORDER BY seq) AS rn FROM attempts)"
_EPISODES = (
    _ATTEMPTS
    + """, s AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY corpus_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ep FROM a),
 w AS (SELECT *, lag(outcome) OVER (PARTITION BY corpus_id, ep ORDER BY seq) AS pe FROM s),
 w2 AS (SELECT *, (outcome <> 'ok' OR cls = 'code' OR coalesce(pe <> 'ok', false)) AS att, coalesce(cls = 'none' AND pe <> 'ok', false) AS bl FROM w),
 e AS (SELECT corpus_id, ep, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(build_id, seq) AS first_build, arg_max(build_id, seq) AS last_build, min(ts) AS started,
              count(*) AS len_raw, count(*) FILTER (WHERE outcome = 'fail') AS fails, count(*) FILTER (WHERE outcome = 'timeout') AS timeouts,
              count(*) FILTER (WHERE cls = 'code') AS len_code, nullif(count(*) FILTER (WHERE att), 0) AS len_attempt, bool_or(outcome = 'ok') AS is_closed, bool_or(bl) AS blind,
              concat('s', arg_min(user_id, seq) % 6) AS project, count(*) FILTER (WHERE cls = 'code') AS len_proof, bool_or(cls = 'code' OR error_head IS NOT NULL OR outcome = 'timeout') AS proof_bearing
       FROM w2 GROUP BY 1, 2)"""
)
_EVENTS = f"""WITH log AS ({mapping.BUILD_LOG}), v AS (SELECT *, CASE WHEN text LIKE '%running for%' THEN 'loop' WHEN text LIKE '***%' THEN 'locus' WHEN text LIKE 'Session %' THEN 'plan' ELSE 'progress' END AS kind,
 regexp_extract(text, 'theory "([^"]+)"', 1) AS lt, regexp_extract(text, 'line ([0-9]+) of theory', 1) AS ll, lag(text) OVER (PARTITION BY build_id ORDER BY line_no) AS pt, lead(t_s) OVER (PARTITION BY build_id ORDER BY line_no) AS nx FROM log)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.classified(conform(mapping.mapped(episodes.segment(mapping.numbered(spark, sf_dir)), "episode_no")))


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with their development (here the directory of the user that began it) and what worked on proofs."""
    began = F.concat(F.lit("s"), (F.min_by("user_id", "seq") % 6).cast("string")).alias("project")
    bearing = F.bool_or(F.col("proof_edit") | F.col("error_head").isNotNull() | (F.col("outcome") == "timeout")).alias("proof_bearing")
    return episodes.summary(_classified(spark, sf_dir), began, F.count_if("proof_edit").alias("len_proof"), bearing)


def _by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.attempts(spark, sf_dir).withColumn("project", F.concat(F.lit("s"), (F.col("user_id") % 6).cast("string")))


# --- scans, predicates, views


@query("attempts_mapped", f"WITH attempts AS ({mapping.ATTEMPTS}) SELECT corpus_id, seq, build_id, outcome, timeout_reason, elapsed_s, error_head, note FROM attempts")
def attempts_mapped(spark, sf_dir):
    return mapping.attempts(spark, sf_dir).select("corpus_id", "seq", "build_id", "outcome", "timeout_reason", "elapsed_s", "error_head", "note")


@query("recent_attempts", _ATTEMPTS + ", k AS (SELECT * FROM a WHERE cls = 'code') SELECT build_id, outcome, greatest((SELECT count(*) FROM k) - 20, 0) AS hidden FROM k ORDER BY ts DESC, corpus_id DESC, seq DESC LIMIT 20")
def recent_attempts(spark, sf_dir):
    return episodes.recent(diffs.classified(conform(mapping.attempts(spark, sf_dir).withColumn("timestamp", F.col("ts").cast("string")))), 20).select("build_id", "outcome", "hidden")


@query("show_by_prefix", _ATTEMPTS + " SELECT corpus_id, arg_max(build_id, seq) AS build_id, max(seq) AS seq FROM a WHERE starts_with(build_id, 'b1') GROUP BY 1")
def show_by_prefix(spark, sf_dir):
    return episodes.show(mapping.attempts(spark, sf_dir), "b1").select("corpus_id", "build_id", "seq")


@query("writer_versions", "SELECT DISTINCT v AS version, v IN ('0.6.1', '0.10.0', '1.0') AS at_least FROM (SELECT concat(CASE event_id % 6 WHEN 0 THEN '0.6.1' WHEN 1 THEN '0.10.0' WHEN 2 THEN '0.6' WHEN 3 THEN '0+unknown' WHEN 4 THEN '1.0' ELSE 'dev' END) AS v FROM events)")
def writer_versions(spark, sf_dir):
    rows = mapping._read(spark, sf_dir, "events").select(F.expr("CASE event_id % 6 WHEN 0 THEN '0.6.1' WHEN 1 THEN '0.10.0' WHEN 2 THEN '0.6' WHEN 3 THEN '0+unknown' WHEN 4 THEN '1.0' ELSE 'dev' END").alias("version"))
    return rows.withColumn("at_least", scalars.writer_at_least(F.col("version"), "0.6.1")).distinct()


# --- episodes


@query("episode_length_histogram", _EPISODES + " SELECT len_raw AS length, count(*) AS trajectories FROM e WHERE is_closed GROUP BY 1")
def episode_length_histogram(spark, sf_dir):
    rows = episodes.segment(mapping.attempts(spark, sf_dir))
    closed = rows.groupBy(*episodes.EPISODE).agg(F.count("*").alias("len_raw"), F.bool_or(F.col("outcome") == "ok").alias("is_closed"))
    return episodes.histogram(closed, "len_raw")


@query("episode_summary", _EPISODES + " SELECT corpus_id, ep AS episode_no, first_seq, last_seq, first_build, last_build, len_raw, fails, timeouts, len_code, len_attempt, is_closed, blind FROM e")
def episode_summary(spark, sf_dir):
    return episodes.summary(_classified(spark, sf_dir)).drop("started")


@query("length_summary", _EPISODES + """, c AS (SELECT * FROM e WHERE is_closed), g AS (SELECT len_code, row_number() OVER (ORDER BY len_code) - 1 AS i, count(*) OVER () AS n FROM c WHERE len_code > 0)
SELECT (SELECT len_code FROM g WHERE i = n // 2) AS median, count(*) FILTER (WHERE len_code > 0) AS trajectories, sum(len_code)::BIGINT AS steps, round(avg(len_code) FILTER (WHERE len_code > 0), 6) AS mean,
max(len_code) AS longest, round(count(*) FILTER (WHERE len_code = 1)::DOUBLE / count(*) FILTER (WHERE len_code > 0), 6) AS one_shot, count(*) FILTER (WHERE len_code = 0) AS dropped, count(*) FILTER (WHERE blind) AS blind FROM c""")
def length_summary(spark, sf_dir):
    return episodes.length_summary(episodes.summary(_classified(spark, sf_dir)))


@query("lengths_by_development", _EPISODES + " SELECT project, count(*) AS trajectories, sum(len_code)::BIGINT AS steps, round(count(*) FILTER (WHERE len_code = 1)::DOUBLE / count(*), 6) AS one_shot, round(avg(len_code), 6) AS mean, max(len_code) AS longest FROM e WHERE is_closed AND len_code > 0 GROUP BY 1")
def lengths_by_development(spark, sf_dir):
    return episodes.by_development(_episodes(spark, sf_dir))


@query("last_episodes_histogram", _EPISODES + ", t AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY ep DESC) AS n FROM e WHERE is_closed) SELECT len_code AS length, count(*) AS trajectories FROM t WHERE n <= 50 AND len_code > 0 GROUP BY 1")
def last_episodes_histogram(spark, sf_dir):
    return episodes.histogram(episodes.summary(_classified(spark, sf_dir)), "len_code", last=50)


@query("episode_view", _EPISODES + " SELECT w2.corpus_id, w2.seq, w2.build_id, w2.outcome, e.len_raw, e.is_closed FROM w2 JOIN e ON e.corpus_id = w2.corpus_id AND e.ep = w2.ep")
def episode_view(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    return episodes.view(rows, episodes.summary(rows)).select("corpus_id", "seq", "build_id", "outcome", "len_raw", "is_closed")


@query("interleaving", _ATTEMPTS + ", p AS (SELECT *, lag(instance_id) OVER (PARTITION BY corpus_id ORDER BY seq) AS pi FROM a) SELECT corpus_id, count(DISTINCT instance_id) AS instances, greatest(0, count(*) FILTER (WHERE rn > 1 AND pi IS DISTINCT FROM instance_id) - (count(DISTINCT instance_id) - 1))::BIGINT AS excess FROM p GROUP BY 1")
def interleaving(spark, sf_dir):
    return episodes.interleaving(mapping.attempts(spark, sf_dir)).withColumn("excess", F.col("excess").cast("long"))


@query("mid_flight_and_export", _EPISODES + ", m AS (SELECT *, lag(git_head) OVER (PARTITION BY corpus_id, ep ORDER BY seq) AS ph, row_number() OVER (PARTITION BY corpus_id, ep ORDER BY seq) AS k FROM w2) SELECT (SELECT count(*) FROM e) AS episodes, (SELECT count(*) FROM e WHERE is_closed) AS closed, (SELECT count(*) FROM e WHERE NOT is_closed) AS open, count(*) FILTER (WHERE k > 1 AND ph IS DISTINCT FROM git_head) AS mid_flight FROM m")
def mid_flight_and_export(spark, sf_dir):
    return episodes.export_counts(episodes.segment(mapping.attempts(spark, sf_dir)))


@query("episode_export", _EPISODES + " SELECT corpus_id, ep AS episode_no, CASE WHEN is_closed THEN last_build ELSE concat(first_build, '-open') END AS episode_id, NOT is_closed AS open, len_raw AS n FROM e")
def episode_export(spark, sf_dir):
    found = episodes.export(episodes.segment(mapping.attempts(spark, sf_dir)))
    return found.select("corpus_id", "episode_no", "episode_id", "open", "n")


_TREES = "SELECT DISTINCT concat('h', CAST(FLOOR(event_id / 50) AS INT)) AS git_head, concat('r', CAST(FLOOR(event_id / 50) AS INT)) AS head_tree FROM events"


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_TREES.replace("FROM events", "FROM {events}"), events=mapping._read(spark, sf_dir, "events"))


@query("base_trees", _ATTEMPTS + f", trees AS ({_TREES}), p AS (SELECT *, lag(tree) OVER (PARTITION BY corpus_id ORDER BY seq) AS pt, lag(git_head) OVER (PARTITION BY corpus_id ORDER BY seq) AS ph FROM a) SELECT corpus_id, seq, CASE WHEN pt IS NULL OR ph IS DISTINCT FROM git_head THEN head_tree ELSE pt END AS base FROM p LEFT JOIN trees USING (git_head)")
def base_trees(spark, sf_dir):
    return episodes.base_trees(mapping.attempts(spark, sf_dir), _trees(spark, sf_dir)).select("corpus_id", "seq", "base")


@query("snapshot_bases", _ATTEMPTS + ", p AS (SELECT *, lag(tree) OVER (PARTITION BY corpus_id ORDER BY seq) AS pt, lag(git_head) OVER (PARTITION BY corpus_id ORDER BY seq) AS ph FROM a) SELECT corpus_id, seq, (rn > 1 AND ph IS NOT DISTINCT FROM git_head AND coalesce(pt IN (SELECT tree FROM attempts WHERE event_id % 3 > 0), false)) AS incremental FROM p")
def snapshot_bases(spark, sf_dir):
    rows = mapping.attempts(spark, sf_dir)
    return episodes.snapshot_bases(rows, rows.where("event_id % 3 > 0")).select("corpus_id", "seq", "incremental")


# --- diffs


@query("delta_class", _ATTEMPTS + " SELECT corpus_id, seq, cls AS delta_class, cls = 'code' AS proof_edit FROM a")
def delta_class(spark, sf_dir):
    return diffs.classified(mapping.attempts(spark, sf_dir)).select("corpus_id", "seq", "delta_class", "proof_edit")


@query("file_verdicts", _ATTEMPTS + " SELECT corpus_id, seq, concat('t/s', user_id % 6, '/T', event_id % 4, CASE WHEN event_id % 11 = 0 THEN '.md' ELSE '.thy' END) AS path_new, cls AS verdict, CASE WHEN cls = 'code' THEN concat('+lemma l', event_id, ': \"True\" by simp') ELSE '' END AS evidence FROM a WHERE cls <> 'none'")
def file_verdicts(spark, sf_dir):
    found = diffs.file_verdicts(diffs.files(mapping.attempts(spark, sf_dir)))
    return found.select("corpus_id", "seq", "path_new", "verdict", F.array_join("evidence", "|").alias("evidence"))


@query("hunk_ranges", _ATTEMPTS + " SELECT corpus_id, seq, concat('T', event_id % 4) AS theory, (1 + event_id % 40)::INT AS old_start, 1 AS old_len, (1 + event_id % 40)::INT AS new_start, 2 AS new_len FROM a WHERE cls <> 'none'")
def hunk_ranges(spark, sf_dir):
    found = diffs.hunks(diffs.files(mapping.attempts(spark, sf_dir)))
    return found.select("corpus_id", "seq", F.regexp_replace(diffs.theory_key(F.col("path_new")), r"\.?md$", "").alias("t"), "old_start", "old_len", "new_start", "new_len").withColumn("theory", F.when(F.col("t") == "", F.lit(None)).otherwise(F.col("t"))).join(mapping.attempts(spark, sf_dir).select("corpus_id", "seq", "event_id"), ["corpus_id", "seq"]).select("corpus_id", "seq", F.coalesce("theory", F.concat(F.lit("T"), (F.col("event_id") % 4).cast("string"))).alias("theory"), "old_start", "old_len", "new_start", "new_len")


@query("diff_lines", _ATTEMPTS + " SELECT corpus_id, seq, 0 AS line_no, ' ' AS sign, concat('theory T', event_id % 4) AS text FROM a WHERE cls <> 'none' UNION ALL SELECT corpus_id, seq, 1, '+', concat('lemma l', event_id, ': \"True\" by simp') FROM a WHERE cls <> 'none'")
def diff_lines(spark, sf_dir):
    return diffs.diff_lines(diffs.hunks(diffs.files(mapping.attempts(spark, sf_dir)))).select("corpus_id", "seq", "line_no", "sign", "text")


@query("diff_stat", _ATTEMPTS + " SELECT corpus_id, seq, f AS file_no, 1::BIGINT AS added, 0::BIGINT AS deleted FROM a, (VALUES (0), (NULL)) AS t(f) WHERE cls <> 'none'")
def diff_stat(spark, sf_dir):
    return diffs.stat(diffs.files(mapping.attempts(spark, sf_dir))).select("corpus_id", "seq", "file_no", "added", "deleted")


@query("patch_paths", _ATTEMPTS + " SELECT corpus_id, seq, CASE WHEN cls = 'none' THEN '' ELSE concat('t/s', user_id % 6, '/T', event_id % 4, '.thy') END AS pre, CASE WHEN cls = 'none' THEN '' ELSE concat('t/s', user_id % 6, '/T', event_id % 4, '.thy') END AS post FROM a")
def patch_paths(spark, sf_dir):
    found = diffs.path_sets(mapping.attempts(spark, sf_dir))
    return found.select("corpus_id", "seq", F.array_join("pre", ",").alias("pre"), F.array_join("post", ",").alias("post"))


@query("short_hunks", _ATTEMPTS + " SELECT corpus_id, seq, 0 AS old_missing, 1 AS new_missing FROM a WHERE cls <> 'none' AND event_id % 7 = 3")
def short_hunks(spark, sf_dir):
    cutting = F.when(F.col("event_id") % 7 == 3, F.regexp_replace("diff", r"\+lemma[^\n]*\n", "@@ end")).otherwise(F.col("diff"))
    rows = mapping.attempts(spark, sf_dir).withColumn("diff", cutting)
    return diffs.short_hunks(diffs.files(rows)).select("corpus_id", "seq", "old_missing", "new_missing")


@query("error_loci", _ATTEMPTS + " SELECT corpus_id, seq, concat('T', event_id % 4) AS theory, (1 + event_id % 40)::INT AS line FROM a WHERE error_head IS NOT NULL")
def error_loci(spark, sf_dir):
    rows = conform(mapping.attempts(spark, sf_dir))
    return rows.select("corpus_id", "seq", F.inline(diffs.error_loci(F.col("error_loci"), F.col("error_head"))))


@query("source_paths", "SELECT concat('t/s', user_id % 6, CASE event_id % 4 WHEN 0 THEN '/ROOT' WHEN 1 THEN '/A.thy' WHEN 2 THEN '/Makefile' ELSE '/ROOTS' END) AS path, (event_id % 4 <> 2) AS is_source, count(*) AS n FROM events GROUP BY 1, 2")
def source_paths(spark, sf_dir):
    path = F.expr("concat('t/s', user_id % 6, CASE event_id % 4 WHEN 0 THEN '/ROOT' WHEN 1 THEN '/A.thy' WHEN 2 THEN '/Makefile' ELSE '/ROOTS' END)")
    return mapping._read(spark, sf_dir, "events").select(path.alias("path")).withColumn("is_source", diffs.is_source(F.col("path"))).groupBy("path", "is_source").agg(F.count("*").alias("n"))


@query("other_changes", _ATTEMPTS + " SELECT corpus_id, seq, 'Makefile' AS path, CASE WHEN event_id % 2 = 0 THEN (event_id % 9)::INT END AS added, (event_id % 3)::INT AS deleted FROM a WHERE event_id % 4 = 2")
def other_changes(spark, sf_dir):
    rows = mapping.attempts(spark, sf_dir).select("corpus_id", "seq", F.expr("CASE event_id % 4 WHEN 2 THEN 'Makefile' ELSE 'A.thy' END").alias("path"), F.expr("CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 9 AS STRING) ELSE '-' END").alias("added"), (F.col("event_id") % 3).cast("string").alias("deleted"))
    return diffs.other_changes(rows).select("corpus_id", "seq", F.inline("other_changed"))


@query("normalised_diffs", "SELECT event_id, concat('index ', substr(md5(CAST(event_id AS VARCHAR)), 1, 7), '..', substr(md5(CAST(user_id AS VARCHAR)), 1, 7), ' 100644') AS line FROM events")
def normalised_diffs(spark, sf_dir):
    line = F.concat(F.lit("index "), F.md5(F.col("event_id").cast("string")), F.lit(".."), F.md5(F.col("user_id").cast("string")), F.lit(" 100644"))
    return mapping._read(spark, sf_dir, "events").select("event_id", diffs.normalised(line).alias("line"))


# --- attribution

_COMMAND = "array('isabelle', 'build', '-d', CASE WHEN event_id % 13 = 0 THEN 'scratch/x' ELSE 't' END, '-o', 'x=1', concat('S', user_id % 6))"


def _with_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with episodes and commands. They are read several times: rows are numbered once, their texts worked out when read."""
    rows = episodes.segment(mapping.numbered(spark, sf_dir)).select(*mapping.NUMBERED, "episode_no")
    return conform(mapping.mapped(landed(rows, "attempts"), "episode_no").withColumn("command", F.expr(_COMMAND)))


@query("argv_fold", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'scratch/x' ELSE 't' END AS dirs, concat('S', user_id % 6) AS targets, 'bv' AS flags, concat('S', user_id % 6) AS sessions FROM events")
def argv_fold(spark, sf_dir):
    rows = mapping._read(spark, sf_dir, "events").withColumn("command", F.expr(_COMMAND))
    strict = argv.build_options(F.expr("array('isabelle', 'build', '-bvd', 't', '-otimeout=3', concat('S', user_id % 6))"))
    return rows.select("event_id", F.array_join(argv.load_dirs(F.col("command")), ",").alias("dirs"), F.array_join(argv.targets(F.col("command")), ",").alias("targets"), F.array_join(strict["flags"], "").alias("flags"), F.array_join(strict["sessions"], ",").alias("sessions"))


@query("session_dirs", "SELECT DISTINCT concat('t/s', user_id % 6) AS dir, concat('s', user_id % 6) AS label FROM events WHERE event_id % 5 <> 0 AND event_id % 11 <> 0")
def session_dirs(spark, sf_dir):
    return attribution.fit(_with_command(spark, sf_dir)).labels.select("dir", "label")


@query("target_map", _ATTEMPTS + ", c AS (SELECT concat('S', user_id % 6) AS target, concat('t/s', user_id % 6) AS dir, count(*) AS n FROM a WHERE cls = 'code' GROUP BY 1, 2) SELECT target, dir FROM c")
def target_map(spark, sf_dir):
    return attribution.fit(_with_command(spark, sf_dir)).targets.select("target", "dir")


_HEAD_DIR = "CASE WHEN error_head IS NOT NULL THEN concat('s', user_id % 6) END"
_PROJECTS = _EPISODES + f""", k AS (SELECT corpus_id, ep, list_distinct(list(CASE WHEN cls = 'code' THEN concat('s', user_id % 6) END)) AS code, list_distinct(list({_HEAD_DIR})) AS err,
 list_distinct(list(CASE WHEN event_id % 13 <> 0 THEN concat('s', user_id % 6) END)) AS cmd FROM w2 GROUP BY 1, 2),
 r AS (SELECT *, CASE WHEN len(code) > 0 THEN 'diff' WHEN len(err) > 0 THEN 'error' WHEN len(cmd) > 0 THEN 'command' ELSE 'none' END AS route FROM k),
 pr AS (SELECT corpus_id, ep, route, CASE WHEN len(x) = 1 THEN x[1] WHEN len(x) > 1 THEN 'mixed' ELSE 'none' END AS project FROM (SELECT *, CASE route WHEN 'diff' THEN code WHEN 'error' THEN err WHEN 'command' THEN cmd ELSE [] END AS x FROM r))"""


@query("episode_projects", _PROJECTS + " SELECT corpus_id, ep AS episode_no, project, route FROM pr")
def episode_projects(spark, sf_dir):
    rows = _with_command(spark, sf_dir)
    return attribution.project(rows, attribution.fit(rows))


@query("route_tally", _PROJECTS + " SELECT route, count(*) AS episodes FROM pr GROUP BY 1")
def route_tally(spark, sf_dir):
    rows = _with_command(spark, sf_dir)
    return attribution.routes(attribution.project(rows, attribution.fit(rows)))


@query("target_usage", "SELECT concat('S', user_id % 6) AS target, count(*) AS n, 'mapped' AS verdict FROM events GROUP BY 1")
def target_usage(spark, sf_dir):
    rows = _with_command(spark, sf_dir)
    return attribution.target_usage(rows, attribution.fit(rows)).select("target", "n", "verdict")


@query("attribution_residue", _PROJECTS + " SELECT count(*) FILTER (WHERE project = 'none') AS none, count(*) FILTER (WHERE project = 'tooling') AS tooling, 0::BIGINT AS unmapped, 'ok' AS status FROM pr")
def attribution_residue(spark, sf_dir):
    rows = _with_command(spark, sf_dir)
    at = attribution.fit(rows)
    return attribution.residue(rows, attribution.project(rows, at), attribution.target_usage(rows, at))


@query("loaded_outside", _ATTEMPTS + " SELECT corpus_id, seq FROM a WHERE event_id % 13 = 0")
def loaded_outside(spark, sf_dir):
    rows = _with_command(spark, sf_dir)
    return attribution.loaded_outside(rows, attribution.fit(rows))


@query("proof_bearing", _EPISODES + " SELECT corpus_id, ep AS episode_no, bool_or(cls = 'code' OR error_head IS NOT NULL OR outcome = 'timeout') AS proof_bearing FROM w2 GROUP BY 1, 2")
def proof_bearing(spark, sf_dir):
    rows = _with_command(spark, sf_dir)
    return attribution.proof_bearing(rows, attribution.fit(rows))


# --- statistics


_FIT = """, hist AS (SELECT project, len_attempt AS k, count(*) AS n FROM e WHERE is_closed AND len_attempt > 1 GROUP BY 1, 2),
whole AS (SELECT project, sum(n) AS n_tail, 1.0 / (sum(k * n) / sum(n) - 1) AS p FROM hist GROUP BY 1 HAVING sum(n) >= 20),
st AS (SELECT * FROM (SELECT project, k AS xmin, sum(n) OVER (PARTITION BY project ORDER BY k DESC) AS support FROM hist) WHERE support >= 15),
pairs AS (SELECT st.*, k, n, sum(n) OVER (PARTITION BY st.project, xmin ORDER BY k) AS hi FROM st JOIN hist USING (project) WHERE k >= xmin),
law AS (SELECT project, xmin, any_value(support) AS sp, 1 + any_value(support) / sum(n * ln(k / (xmin - 0.5))) AS alpha, 1.0 / (sum(n * (k - xmin + 1)) / any_value(support)) AS ps FROM pairs GROUP BY 1, 2),
cdf AS (SELECT project, xmin, sp, alpha, hi, hi - n AS lo, 1 - pow((k + 0.5) / (xmin - 0.5), 1 - alpha) AS c, 1 - pow(1 - ps, k - xmin + 1) AS g FROM pairs JOIN law USING (project, xmin)),
ks AS (SELECT project, xmin, sp, alpha, max(greatest(abs((lo + 1) / sp - c), abs(hi / sp - c), abs(c - lo / sp), abs(c - (hi - 1) / sp))) AS ks, max(greatest(abs((lo + 1) / sp - g), abs(hi / sp - g), abs(g - lo / sp), abs(g - (hi - 1) / sp))) AS kg FROM cdf GROUP BY ALL),
best AS (SELECT *, greatest(10, 4 * xmin) AS probe FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ks, xmin) AS r FROM ks) WHERE r = 1)
SELECT project, n_tail::BIGINT AS n_tail, round(p, 6) AS p, xmin, sp::BIGINT AS support, round(alpha, 6) AS alpha, round(ks, 6) AS ks, round(kg, 6) AS ks_geom, probe, (SELECT coalesce(sum(n), 0) FROM hist h WHERE h.project = b.project AND k >= probe)::BIGINT AS observed, round(n_tail * pow(1 - p, probe - 1), 6) AS expected_geom
FROM whole JOIN best b USING (project)"""


@query("length_fit", _EPISODES + _FIT)
def length_fit(spark, sf_dir):
    closed = _episodes(spark, sf_dir).where("is_closed AND len_attempt > 0")
    return lengths.fit(closed.groupBy("project", F.col("len_attempt").alias("length")).agg(F.count("*").alias("trajectories")), ["project"])


_TRIALS = _EPISODES + ", tr AS (SELECT project, substr(CAST(started AS VARCHAR), 1, 10) AS day, (len_attempt = 1)::INT AS one_shot FROM e WHERE is_closed AND len_attempt > 0)"


@query("trial_rates", _TRIALS + " SELECT project, round(avg(one_shot), 6) AS rate, count(*) AS n, count(DISTINCT day) AS days FROM tr GROUP BY 1")
def trial_rates(spark, sf_dir):
    return lengths.rates(lengths.trials(_episodes(spark, sf_dir)))


_SIDES = _TRIALS + ", big AS (SELECT arg_min(project, (-n, project)) AS a FROM (SELECT project, count(*) AS n FROM tr GROUP BY 1)), sd AS (SELECT tr.*, CASE WHEN project = a THEN 'a' ELSE 'b' END AS side FROM tr, big), dy AS (SELECT day, count(*) FILTER (WHERE side = 'a') AS n_a, coalesce(sum(one_shot) FILTER (WHERE side = 'a'), 0)::BIGINT AS x_a, count(*) FILTER (WHERE side = 'b') AS n_b, coalesce(sum(one_shot) FILTER (WHERE side = 'b'), 0)::BIGINT AS x_b FROM sd GROUP BY 1)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read several times: landed as a row a day, after one pass over the episodes."""
    counted = landed(lengths.daily(lengths.trials(_episodes(spark, sf_dir))), "trials")
    return landed(lengths.by_day(lengths.choose_groups(counted)), "days")


@query("trials_by_day", _SIDES + " SELECT * FROM dy")
def trials_by_day(spark, sf_dir):
    return _days(spark, sf_dir)


@query("two_proportions", _SIDES + """, t AS (SELECT sum(n_a)::DOUBLE AS n_a, sum(x_a)::DOUBLE AS x_a, sum(n_b)::DOUBLE AS n_b, sum(x_b)::DOUBLE AS x_b FROM dy), z AS (SELECT *, (x_a + x_b) / (n_a + n_b) AS q, x_a / n_a AS ra, x_b / n_b AS rb FROM t)
SELECT n_a, n_b, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(ra - rb, 6) AS gap, round((ra - rb) / sqrt(q * (1 - q) * (1 / n_a + 1 / n_b)), 6) AS z FROM z""")
def two_proportions(spark, sf_dir):
    return lengths.two_proportion_test(_days(spark, sf_dir)).select("n_a", "n_b", "rate_a", "rate_b", "gap", "z")


_REPLICATES = _SIDES + """, rk AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS r, count(*) OVER () AS nd FROM dy),
dr AS (SELECT g.replicate, ('0x' || substr(md5('trials:' || g.replicate || ':' || rk.r), 1, 8))::BIGINT % rk.nd AS r FROM (SELECT unnest(range({n})) AS replicate) g, rk),
gaps AS (SELECT replicate, sum(x_a) / sum(n_a) - sum(x_b) / sum(n_b) AS gap FROM dr JOIN rk USING (r) GROUP BY 1 HAVING sum(n_a) > 0 AND sum(n_b) > 0)"""


@query("day_bootstrap", _REPLICATES.replace("{n}", "10000") + " SELECT replicate, round(gap, 6) AS gap FROM gaps")
def day_bootstrap(spark, sf_dir):
    return lengths.bootstrap(_days(spark, sf_dir)).select("replicate", F.round("gap", 6).alias("gap"))


@query("bootstrap_interval", _REPLICATES.replace("{n}", "1000") + """, pl AS (SELECT gap, row_number() OVER (ORDER BY gap, replicate) - 1 AS i, count(*) OVER () AS n FROM gaps),
b AS (SELECT max(CASE WHEN i = floor(n * 0.025) THEN gap END) AS low, max(CASE WHEN i = floor(n * 0.975) THEN gap END) AS high, avg((gap <= 0)::INT) AS crossing, stddev(gap) AS s FROM pl),
t AS (SELECT sum(x_a) / sum(n_a) AS ra, sum(x_b) / sum(n_b) AS rb, sum(n_a) AS na, sum(n_b) AS nb FROM dy), er AS (SELECT round(sqrt(ra * (1 - ra) / na + rb * (1 - rb) / nb), 6) AS error FROM t)
SELECT round(low, 6) AS low, round(high, 6) AS high, round(crossing, 6) AS crossing, round(s, 6) AS boot_error, round(pow(s / nullif(error, 0), 2), 4) AS design_effect FROM b, er""")
def bootstrap_interval(spark, sf_dir):
    days = _days(spark, sf_dir)
    return lengths.interval(lengths.bootstrap(days, 1000), lengths.two_proportion_test(days))


@query("leave_one_day_out", _SIDES + ", t AS (SELECT *, sum(n_a) OVER () AS na, sum(x_a) OVER () AS xa, sum(n_b) OVER () - n_b AS nb, sum(x_b) OVER () - x_b AS xb FROM dy) SELECT day, round(xa / na - xb / nb, 6) AS gap FROM t WHERE n_b > 0 AND na > 0 AND nb > 0")
def leave_one_day_out(spark, sf_dir):
    return lengths.leave_one_day_out(_days(spark, sf_dir))


@query("length_scopes", _EPISODES + " SELECT project, count(*) FILTER (WHERE len_code > 0) AS n_code, round(avg((len_code = 1)::INT) FILTER (WHERE len_code > 0), 6) AS one_shot_code, round(avg(len_code) FILTER (WHERE len_code > 0), 6) AS mean_code, count(*) FILTER (WHERE len_attempt > 0) AS n_attempt, round(avg((len_attempt = 1)::INT) FILTER (WHERE len_attempt > 0), 6) AS one_shot_attempt, round(avg(len_attempt) FILTER (WHERE len_attempt > 0), 6) AS mean_attempt, count(*) FILTER (WHERE len_proof > 0) AS n_proof, round(avg((len_proof = 1)::INT) FILTER (WHERE len_proof > 0), 6) AS one_shot_proof, round(avg(len_proof) FILTER (WHERE len_proof > 0), 6) AS mean_proof FROM e WHERE is_closed GROUP BY 1")
def length_scopes(spark, sf_dir):
    return lengths.scopes(_episodes(spark, sf_dir))


@query("filtered_rates", _EPISODES + " SELECT project, round(avg((len_attempt = 1)::INT), 6) AS rate_all, count(*) AS n_all, round(avg((len_attempt = 1)::INT) FILTER (WHERE proof_bearing), 6) AS rate_proof, count(*) FILTER (WHERE proof_bearing) AS n_proof, count(*) FILTER (WHERE NOT proof_bearing) AS dropped FROM e WHERE is_closed AND len_attempt > 0 GROUP BY 1")
def filtered_rates(spark, sf_dir):
    return lengths.filtered_rates(_episodes(spark, sf_dir))


# --- audits


@query("outcome_mix", _EPISODES + " SELECT project, sum(fails)::BIGINT AS fails, sum(timeouts)::BIGINT AS timeouts, round(sum(timeouts) / sum(len_raw), 6) AS timeout_share, round(avg((timeouts > 0)::INT), 6) AS runs_with_timeout FROM e GROUP BY 1")
def outcome_mix(spark, sf_dir):
    return audits.outcome_mix(_episodes(spark, sf_dir))


@query("one_shot_treatments", _EPISODES + " SELECT project, round(avg((len_raw = 1)::INT), 6) AS as_counted, round(avg((greatest(1, len_raw - timeouts) = 1)::INT), 6) AS timeouts_removed, round(avg((len_raw = 1)::INT) FILTER (WHERE timeouts = 0), 6) AS runs_removed FROM e WHERE is_closed GROUP BY 1")
def one_shot_treatments(spark, sf_dir):
    return audits.one_shot_treatments(_episodes(spark, sf_dir))


_PROJ = _ATTEMPTS + ", b AS (SELECT *, concat('s', user_id % 6) AS project FROM a)"


@query("load_conditions", _PROJ + ", p AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY event_id) AS k, lag(instance_id) OVER (PARTITION BY project ORDER BY event_id) AS pi FROM b) SELECT project, round(count(*) FILTER (WHERE power = 'battery')::DOUBLE / count(*), 6) AS battery_share, round(avg(elapsed_s), 4) AS mean_elapsed, count(DISTINCT instance_id) AS instances, greatest(0, count(*) FILTER (WHERE k > 1 AND pi IS DISTINCT FROM instance_id) - (count(DISTINCT instance_id) - 1))::BIGINT AS excess FROM p GROUP BY 1")
def load_conditions(spark, sf_dir):
    rows = _by_project(spark, sf_dir).withColumn("seq", F.col("event_id"))
    return audits.load_conditions(rows).withColumn("excess", F.col("excess").cast("long"))


@query("timeout_reasons", _PROJ + " SELECT project, count(*) FILTER (WHERE timeout_reason = 'activity') AS activity, count(*) FILTER (WHERE timeout_reason = 'wall') AS wall, count(*) FILTER (WHERE timeout_reason = 'loop_progress') AS loop_progress, round(count(*) FILTER (WHERE timeout_reason = 'loop_progress')::DOUBLE / count(*), 6) AS divergence_rate FROM b GROUP BY 1")
def timeout_reasons(spark, sf_dir):
    return audits.timeout_reasons(_by_project(spark, sf_dir))


@query("disguised_timeouts", _PROJ + ", m AS (SELECT project, min(elapsed_s) FILTER (WHERE outcome = 'timeout') AS least FROM b GROUP BY 1) SELECT project, round(median(elapsed_s), 6) AS median_fail, max(elapsed_s) AS longest_fail, count(*) FILTER (WHERE elapsed_s >= least) AS disguised FROM b JOIN m USING (project) WHERE outcome = 'fail' AND elapsed_s IS NOT NULL GROUP BY 1")
def disguised_timeouts(spark, sf_dir):
    return audits.disguised_timeouts(_by_project(spark, sf_dir))


@query("failure_texts", _ATTEMPTS + " SELECT round(avg((lower(coalesce(error_head, '')) LIKE '%failed to finish%')::INT), 6) AS share_failed_to_finish, round(avg((lower(coalesce(error_head, '')) LIKE '%line 7 %')::INT), 6) AS share_line_7_, round(avg((NOT (lower(coalesce(error_head, '')) LIKE '%failed to finish%' OR lower(coalesce(error_head, '')) LIKE '%line 7 %'))::INT), 6) AS unmatched FROM a WHERE outcome = 'fail'")
def failure_texts(spark, sf_dir):
    return audits.failure_texts(mapping.attempts(spark, sf_dir), ["failed to finish", "line 7 "])


@query("divergence_by_length", _EPISODES + ", l AS (SELECT corpus_id, ep, count(*) AS n, count(*) FILTER (WHERE timeout_reason = 'loop_progress') AS loops FROM w2 GROUP BY 1, 2), q AS (SELECT sum(loops) / sum(n) AS p FROM l) SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' ELSE '10+' END AS band, round(sum(loops) / sum(n), 6) AS loop_rate, count(*) FILTER (WHERE loops > 0) AS observed, round(sum(1 - pow(1 - p, n)), 4) AS expected FROM l, q GROUP BY 1")
def divergence_by_length(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    return audits.divergence_by_length(rows, episodes.summary(rows))


_ERA = ", er AS (SELECT *, CASE WHEN substr(CAST(ts AS VARCHAR), 1, 10) >= '2026-07-27' THEN 'post' ELSE 'pre' END AS era FROM a)"


@query("class_by_outcome", _ATTEMPTS + _ERA + ", g AS (SELECT era, cls AS delta_class, count(*) FILTER (WHERE outcome = 'ok') AS ok, count(*) FILTER (WHERE outcome = 'fail') AS fail, count(*) FILTER (WHERE outcome = 'timeout') AS timeout, count(*) AS n FROM er GROUP BY GROUPING SETS ((era, cls), (era))) SELECT *, round(n / max(n) OVER (PARTITION BY era), 6) AS share FROM g")
def class_by_outcome(spark, sf_dir):
    return audits.class_by_outcome(diffs.classified(mapping.attempts(spark, sf_dir).withColumn("timestamp", F.col("ts").cast("string"))))


@query("empty_by_predecessor", _ATTEMPTS + _ERA + " SELECT era, outcome, CASE WHEN rn = 1 THEN 'first' WHEN po = 'ok' THEN 'ok' ELSE 'bad' END AS before, count(*) AS n FROM er WHERE cls = 'none' GROUP BY 1, 2, 3")
def empty_by_predecessor(spark, sf_dir):
    return audits.empty_by_predecessor(diffs.classified(mapping.attempts(spark, sf_dir).withColumn("timestamp", F.col("ts").cast("string"))))


@query("lost_episodes", _EPISODES + ", d AS (SELECT corpus_id, ep, count(error_head) AS errs FROM w2 GROUP BY 1, 2), j AS (SELECT e.*, errs, coalesce(len_attempt, 0) AS la FROM e JOIN d ON d.corpus_id = e.corpus_id AND d.ep = e.ep WHERE is_closed) SELECT count(*) FILTER (WHERE len_code = 0 AND la > 0) AS dropped, count(*) FILTER (WHERE len_code > 0 AND len_code < la) AS shortened, sum(CASE WHEN len_code < la THEN la - len_code ELSE 0 END)::BIGINT AS missed, count(*) FILTER (WHERE len_code = 1 AND la > 1) AS wrongly_one_shot, count(*) FILTER (WHERE len_code = 0 AND la > 0 AND errs > 0) AS recoverable FROM j")
def lost_episodes(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    dirs = rows.groupBy(*episodes.EPISODE).agg(F.collect_set(F.when(F.col("error_head").isNotNull(), F.regexp_extract("error_head", "(t/s[0-9])/", 1))).alias("error_dirs"))
    return audits.lost_episodes(episodes.summary(rows).join(dirs, episodes.EPISODE))


# --- progress, flips, notes


@query("edit_progress", _ATTEMPTS + """, p AS (SELECT *, lag(error_head) OVER w AS ph, lag(event_id) OVER w AS pid FROM a WINDOW w AS (PARTITION BY corpus_id ORDER BY seq)),
c AS (SELECT *, 1 + pid % 40 AS ol, 1 + event_id % 40 AS h, CASE WHEN event_id % 11 = 0 THEN 'md' ELSE concat('T', event_id % 4) END AS th FROM p WHERE rn > 1 AND po <> 'ok'),
m AS (SELECT *, CASE WHEN h > ol THEN ol WHEN ol < h + 1 THEN NULL ELSE ol + 1 END AS m, CASE WHEN error_head IS NOT NULL AND concat('T', event_id % 4) = concat('T', pid % 4) THEN 1 + event_id % 40 END AS nl FROM c),
k AS (SELECT CASE WHEN ph IS NULL OR cls = 'none' THEN 'unclassifiable' WHEN th <> concat('T', pid % 4) THEN 'edit in a different theory'
 WHEN outcome = 'ok' AND m IS NULL THEN 'ok, edit covered the failing line' WHEN outcome = 'ok' THEN 'ok, failing line untouched' WHEN nl IS NULL THEN 'error left the theory'
 WHEN m IS NULL AND nl >= h AND nl < h + 2 AND ph IS DISTINCT FROM error_head THEN 'still failing in region, different error' WHEN m IS NULL AND nl >= h AND nl < h + 2 THEN 'still failing in region, same error'
 WHEN m IS NULL THEN 'edited the failing line, error moved off it' WHEN nl > m THEN 'error advanced past the edit' WHEN nl = m THEN 'same drift-corrected line' ELSE 'error retreated' END AS progress FROM m)
SELECT progress, count(*) AS n FROM k GROUP BY 1""")
def edit_progress(spark, sf_dir):
    return progress.tally(progress.transitions(conform(mapping.attempts(spark, sf_dir))))


def _with_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.attempts(spark, sf_dir)
    fields = notes.parse(F.col("note"))
    return conform(rows.withColumns({"limits": F.create_map(F.lit("wall_timeout"), F.col("wall_timeout")), "note_fields": fields}).withColumn("note_predicted", notes.predicted(F.col("note_fields"))))


@query("outcome_flips", _ATTEMPTS + ", p AS (SELECT *, lag(wall_timeout) OVER (PARTITION BY corpus_id ORDER BY seq) AS pw FROM a) SELECT corpus_id, seq, po AS before, outcome, concat_ws(' | ', CASE WHEN cls <> 'none' THEN concat('sources: T', event_id % 4) END, CASE WHEN pw <> wall_timeout THEN concat('LIMIT wall_timeout ', pw, '->', wall_timeout) END) AS causes, CASE WHEN event_id % 3 = 0 THEN concat('k', event_id % 10) END AS diagnosis FROM p WHERE rn > 1 AND po <> outcome")
def outcome_flips(spark, sf_dir):
    found = progress.flips(_with_limits(spark, sf_dir))
    return found.withColumn("causes", F.array_join("causes", " | "))


@query("flip_totals", _ATTEMPTS + ", p AS (SELECT *, lag(wall_timeout) OVER (PARTITION BY corpus_id ORDER BY seq) AS pw FROM a) SELECT count(*) AS changes, count(*) FILTER (WHERE pw <> wall_timeout) AS budget, count(*) FILTER (WHERE cls = 'none' AND pw = wall_timeout) AS unexplained FROM p WHERE rn > 1 AND po <> outcome")
def flip_totals(spark, sf_dir):
    return progress.flip_totals(progress.flips(_with_limits(spark, sf_dir)))


@query("note_sections", "SELECT event_id, concat('k', event_id % 10) AS diagnosis, CASE event_id % 2 WHEN 0 THEN 'ok' ELSE 'fail' END AS expect, CASE event_id % 2 WHEN 0 THEN 'ok' ELSE 'fail' END AS predicted FROM events WHERE event_id % 3 = 0")
def note_sections(spark, sf_dir):
    rows = _with_limits(spark, sf_dir).where("note IS NOT NULL")
    return rows.select("event_id", F.element_at("note_fields", "diagnosis").alias("diagnosis"), F.element_at("note_fields", "expect").alias("expect"), F.col("note_predicted").alias("predicted"))


@query("free_prose_notes", "SELECT conv_id, turn, true AS only_notes FROM conversations WHERE text IS NOT NULL AND trim(regexp_replace(text, '\\s', '', 'g')) <> ''")
def free_prose_notes(spark, sf_dir):
    rows = mapping._read(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("f", notes.parse(F.col("text"))).where("f IS NOT NULL")
    return rows.select("conv_id", "turn", F.map_keys("f").eqNullSafe(F.array(F.lit("notes"))).alias("only_notes"))


@query("note_lint", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'no_section' WHEN 2 THEN 'unscored' ELSE 'no_expect' END AS lint FROM events")
def note_lint(spark, sf_dir):
    note = F.expr("CASE event_id % 4 WHEN 0 THEN 'diagnosis: x; expect: ok' WHEN 1 THEN 'just text' WHEN 2 THEN concat('expect: maybe ', event_id) ELSE 'change: y' END")
    return mapping._read(spark, sf_dir, "events").select("event_id", F.array_join(notes.lint(note), ",").alias("lint"))


@query("note_near_misses", "SELECT DISTINCT w AS word, m AS meant FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'expects' WHEN 1 THEN 'diagnose' ELSE 'changes' END AS w, CASE event_id % 3 WHEN 0 THEN 'expect' WHEN 1 THEN 'diagnosis' ELSE 'change' END AS m FROM events)")
def note_near_misses(spark, sf_dir):
    note = F.expr("concat(CASE event_id % 3 WHEN 0 THEN 'expects' WHEN 1 THEN 'diagnose' ELSE 'changes' END, ': x', event_id)")
    return notes.near_misses(mapping._read(spark, sf_dir, "events").select(note.alias("note")))


@query("prediction_score", _ATTEMPTS + ", n AS (SELECT *, CASE event_id % 2 WHEN 0 THEN 'ok' ELSE 'fail' END AS pred FROM a WHERE note IS NOT NULL) SELECT count(*) AS notes, count(*) AS scored, count(*) FILTER (WHERE pred = outcome) AS hits, count(*) FILTER (WHERE pred <> outcome) AS surprises, 0::BIGINT AS post_hoc FROM n")
def prediction_score(spark, sf_dir):
    return progress.prediction_score(_with_limits(spark, sf_dir))


# --- integrity

_REGEN = "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN concat(diff, ' ', chr(10)) WHEN 2 THEN concat('x', diff) ELSE diff END"
_VERDICTS = _ATTEMPTS + f""", trees AS ({_TREES}), p AS (SELECT *, lag(tree) OVER w AS pt, lag(git_head) OVER w AS ph FROM a WINDOW w AS (PARTITION BY corpus_id ORDER BY seq)),
 g AS (SELECT *, CASE WHEN pt IS NULL OR ph IS DISTINCT FROM git_head THEN head_tree ELSE pt END AS base, {_REGEN} AS regen FROM p LEFT JOIN trees USING (git_head)),
 vd AS (SELECT corpus_id, seq, ts, CASE WHEN cls = 'none' AND event_id % 7 = 2 THEN 'empty-recoverable' WHEN cls = 'none' AND event_id % 7 = 0 AND base <> tree THEN 'empty-lost-objects'
  WHEN cls = 'none' AND rn > 1 AND po <> outcome AND po <> 'timeout' AND outcome <> 'timeout' THEN 'empty-blind' WHEN cls = 'none' THEN 'empty-consistent' WHEN event_id % 7 = 0 THEN 'unverified' WHEN event_id % 7 = 1 THEN 'truncated' WHEN event_id % 7 = 2 THEN 'divergent' ELSE 'sound' END AS verdict, length(diff) AS len0, length(regen) AS len1 FROM g)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episodes.base_trees(mapping.attempts(spark, sf_dir), _trees(spark, sf_dir))
    return integrity.verdicts(rows.withColumn("regen", F.expr(_REGEN)))


@query("integrity_verdicts", _VERDICTS + " SELECT corpus_id, seq, verdict FROM vd")
def integrity_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select("corpus_id", "seq", "verdict")


@query("integrity_tally", _VERDICTS + " SELECT verdict, count(*) AS n, CASE WHEN verdict IN ('sound', 'empty-consistent') THEN 'clean' WHEN verdict IN ('empty-recoverable', 'truncated', 'divergent') THEN 'exact' WHEN verdict = 'unverified' THEN 'unjudged' ELSE 'unrecoverable' END AS \"group\" FROM vd GROUP BY 1")
def integrity_tally(spark, sf_dir):
    return integrity.tally(_judged(spark, sf_dir))


@query("integrity_defects", _VERDICTS + " SELECT corpus_id, seq, verdict, (SELECT count(*) FROM vd WHERE verdict NOT IN ('sound', 'empty-consistent')) AS defects FROM vd WHERE verdict NOT IN ('sound', 'empty-consistent') ORDER BY 1, 2 LIMIT 40")
def integrity_defects(spark, sf_dir):
    return integrity.defects(_judged(spark, sf_dir))


@query("repair_dry_run", _VERDICTS + " SELECT corpus_id, seq, verdict, len0 AS length_before, len1 AS length_after FROM vd WHERE verdict IN ('empty-recoverable', 'truncated', 'divergent')")
def repair_dry_run(spark, sf_dir):
    found = integrity.dry_run(_judged(spark, sf_dir))
    return found.withColumns({"length_before": F.col("length_before").cast("long"), "length_after": F.col("length_after").cast("long")})


@query("blind_by_day", _VERDICTS + " SELECT substr(CAST(ts AS VARCHAR), 1, 10) >= '2024-01-15' AS since, count(*) AS n FROM vd WHERE verdict = 'empty-blind' GROUP BY 1")
def blind_by_day(spark, sf_dir):
    return integrity.blind_by_day(_judged(spark, sf_dir), "2024-01-15")


@query("replay_check", _ATTEMPTS + " SELECT corpus_id, seq, CASE WHEN cls = 'doc' THEN 'skipped' WHEN event_id % 3 = 0 THEN 'bad' ELSE 'ok' END AS verdict FROM a WHERE cls <> 'none'")
def replay_check(spark, sf_dir):
    rows = mapping.attempts(spark, sf_dir).withColumns({"base": F.concat(F.lit("o"), F.col("event_id").cast("string")), "tree": F.concat(F.lit("n"), F.col("event_id").cast("string"))})
    name = F.concat(F.lit("t/s"), (F.col("user_id") % 6).cast("string"), F.lit("/T"), (F.col("event_id") % 4).cast("string"), F.lit(".thy"))
    line = F.concat(F.lit("theory T"), (F.col("event_id") % 4).cast("string"))
    head = F.repeat(F.lit("x\n"), (F.col("event_id") % 40).cast("int"))
    old = F.concat(head, line, F.lit("\nend\n"))
    new = F.concat(head, line, F.lit("\nlemma l"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ': "False" by simp').otherwise(': "True" by simp'), F.lit("\nend\n"))
    files = rows.where("diff <> ''").select(F.inline(F.array(F.struct(F.col("base").alias("tree"), name.alias("path"), old.alias("content")), F.struct(F.col("tree").alias("tree"), name.alias("path"), new.alias("content")))))
    files = files.withColumn("blob_id", integrity.blob_id(F.col("content")))
    return integrity.replayed(rows, files, files.select("blob_id", "content").dropDuplicates(["blob_id"])).select("corpus_id", "seq", "verdict")


# --- size


@query("field_bytes", _ATTEMPTS + " SELECT unnest(['outcome', 'git_head', 'timeout_reason']) AS field, unnest([sum(length(outcome) + 2), sum(length(git_head) + 2), sum(coalesce(length(timeout_reason) + 2, 4))])::BIGINT AS chars FROM a")
def field_bytes(spark, sf_dir):
    return size.field_bytes(mapping.attempts(spark, sf_dir).select("outcome", "git_head", "timeout_reason"))


@query("diff_bytes", _ATTEMPTS + " SELECT count(*) AS records, count(*) FILTER (WHERE outcome = 'ok') AS ok, sum(CASE WHEN cls = 'code' THEN strlen(diff) ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN cls <> 'code' THEN strlen(diff) ELSE 0 END)::BIGINT AS discarded, sum(CASE WHEN cls = 'doc' THEN strlen(diff) ELSE 0 END)::BIGINT AS doc_only, sum(coalesce(strlen(error_head), 0))::BIGINT AS error_bytes FROM a")
def diff_bytes(spark, sf_dir):
    return size.diff_bytes(diffs.classified(mapping.attempts(spark, sf_dir)))


@query("largest_fields", _ATTEMPTS + ", t AS (SELECT unnest(['diff', 'outcome', 'tree']) AS field, unnest([sum(strlen(diff) + 2 + 7 * (diff <> '')::INT + 2 * (diff <> '')::INT - (diff <> '')::INT), sum(length(outcome) + 2), sum(length(tree) + 2)])::BIGINT AS chars FROM a) SELECT field, chars FROM t WHERE field <> 'diff' UNION ALL SELECT '(others)', 0")
def largest_fields(spark, sf_dir):
    return size.largest_fields(size.field_bytes(mapping.attempts(spark, sf_dir).select("outcome", "tree")))


@query("compressed_blocks")
def compressed_blocks(spark, sf_dir):
    return size.block_gz(mapping._read(spark, sf_dir, "documents"), "text")


# --- build logs


@query("log_events", _EVENTS + " SELECT build_id, line_no, kind FROM v")
def log_events(spark, sf_dir):
    return logs.events(mapping.build_log(spark, sf_dir)).select("build_id", "line_no", "kind")


@query("loop_runs", _EVENTS + ", f AS (SELECT *, sum(CASE WHEN kind = 'loop' AND pt = text THEN 0 ELSE 1 END) OVER (PARTITION BY build_id ORDER BY line_no) AS isl FROM v) SELECT build_id, line_no, row_number() OVER (PARTITION BY build_id, isl ORDER BY line_no)::INT AS run FROM f WHERE kind = 'loop'")
def loop_runs(spark, sf_dir):
    return logs.loops(logs.events(mapping.build_log(spark, sf_dir))).where("kind = 'loop'").select("build_id", "line_no", "run")


@query("budget_kills", _EVENTS + """, f AS (SELECT *, sum(CASE WHEN kind = 'loop' AND pt = text THEN 0 ELSE 1 END) OVER (PARTITION BY build_id ORDER BY line_no) AS isl, max((kind = 'plan')::INT) OVER (PARTITION BY build_id ORDER BY line_no) AS ph FROM v),
r AS (SELECT *, CASE WHEN kind = 'loop' THEN row_number() OVER (PARTITION BY build_id, isl ORDER BY line_no) ELSE 0 END AS run, CASE WHEN ph = 1 THEN 20.0 ELSE 40.0 END AS idle FROM f),
q AS (SELECT build_id, min(CASE WHEN nx - t_s >= idle THEN t_s + idle END) AS a, min(CASE WHEN run >= 3 THEN t_s END) AS l, max(t_s) AS e FROM r GROUP BY 1),
t AS (SELECT build_id, unnest([0, 1, 2]) AS k, unnest(['wall', 'loop_progress', 'activity']) AS reason, unnest([CASE WHEN e >= 40 THEN 40.0 END, l, a])::DOUBLE AS at_s FROM q)
SELECT build_id, arg_min(reason, (at_s, k)) AS reason, min(at_s) AS at_s FROM t WHERE at_s IS NOT NULL GROUP BY 1""")
def budget_kills(spark, sf_dir):
    return logs.kills(logs.events(mapping.build_log(spark, sf_dir)))


@query("last_progress", _EVENTS + " SELECT build_id, arg_max(regexp_extract(text, 'theory (S[.]T[0-9])', 1), line_no) AS theory, arg_max(regexp_extract(text, '([0-9]+)%', 1)::INT, line_no) AS pct FROM v WHERE kind = 'progress' GROUP BY 1")
def last_progress(spark, sf_dir):
    return logs.last_progress(logs.events(mapping.build_log(spark, sf_dir)))


@query("last_loop_key", _EVENTS + " SELECT build_id, arg_max(lt, line_no) AS loop_theory, arg_max(ll, line_no) AS loop_line, 'by' AS loop_command FROM v WHERE kind = 'loop' GROUP BY 1")
def last_loop_key(spark, sf_dir):
    return logs.last_loop_key(logs.events(mapping.build_log(spark, sf_dir))).drop("loop_elapsed")


@query("error_heads", _EVENTS + ", n AS (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY line_no) AS n FROM v WHERE kind = 'locus') SELECT build_id, string_agg(substr(text, 5), ' | ' ORDER BY n) AS error_head FROM n WHERE n <= 2 GROUP BY 1")
def error_heads(spark, sf_dir):
    return logs.error_heads(logs.events(mapping.build_log(spark, sf_dir)))


@query("log_error_loci", _EVENTS + ", d AS (SELECT build_id, regexp_extract(text, 'of \"([^\"]+)\"', 1) AS t, regexp_extract(text, 'line ([0-9]+) of', 1) AS l, min(line_no) AS fst FROM v WHERE kind = 'locus' GROUP BY 1, 2, 3) SELECT build_id, string_agg(concat(t, ':', l), ',' ORDER BY fst, t, l) AS loci, count(*) AS n_loci FROM d GROUP BY 1")
def log_error_loci(spark, sf_dir):
    found = logs.error_loci(logs.events(mapping.build_log(spark, sf_dir)))
    return found.select("build_id", F.array_join(F.transform("error_loci", lambda x: F.concat_ws(":", x)), ",").alias("loci"), "n_loci")


@query("failure_blocks", _EVENTS + ", n AS (SELECT *, line_no - row_number() OVER (PARTITION BY build_id ORDER BY line_no) AS isl FROM v WHERE kind = 'locus'), f AS (SELECT *, min(isl) OVER (PARTITION BY build_id) AS fi FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY line_no) AS k FROM f WHERE isl = fi) SELECT build_id, string_agg(substr(text, 5), chr(10) ORDER BY k) AS block FROM k WHERE k <= 6 GROUP BY 1")
def failure_blocks(spark, sf_dir):
    return logs.failure_block(logs.events(mapping.build_log(spark, sf_dir)))


_SESSIONS = "CASE l_linenumber % 3 WHEN 0 THEN concat('Building D', l_suppkey % 3, ' ...') WHEN 1 THEN concat('Running R', l_suppkey % 2, ' ...') ELSE 'Session X/Y' END"


@query("session_timeline", f"WITH log AS (SELECT build_id, line_no, t_s, x AS text FROM (SELECT l.*, {_SESSIONS} AS x FROM ({mapping.BUILD_LOG}) l JOIN (SELECT l_orderkey, row_number() OVER ({mapping._LINE_ORDER}) AS k, l_linenumber, l_suppkey FROM lineitem) i ON i.l_orderkey = l.build_id AND i.k = l.line_no)), s AS (SELECT build_id, regexp_extract(text, '^(Building|Running) ([A-Z0-9]+)', 2) AS n, min(line_no) AS fst, arg_min(CASE WHEN text LIKE 'Building%' THEN 'dependency' ELSE 'target' END, line_no) AS role FROM log WHERE text NOT LIKE 'Session%' GROUP BY 1, 2) SELECT build_id, string_agg(concat(n, ':', role), ',' ORDER BY fst) AS sessions FROM s GROUP BY 1")
def session_timeline(spark, sf_dir):
    rows = mapping.build_log(spark, sf_dir, _SESSIONS)
    found = logs.session_timeline(logs.events(rows)).where(F.size("sessions") > 0)
    return found.select("build_id", F.array_join(F.transform("sessions", lambda s: F.concat_ws(":", s["name"], s["role"])), ",").alias("sessions"))


@query("assembled_attempts", _EVENTS + """, f AS (SELECT *, sum(CASE WHEN kind = 'loop' AND pt = text THEN 0 ELSE 1 END) OVER (PARTITION BY build_id ORDER BY line_no) AS isl, max((kind = 'plan')::INT) OVER (PARTITION BY build_id ORDER BY line_no) AS ph FROM v),
r AS (SELECT *, CASE WHEN kind = 'loop' THEN row_number() OVER (PARTITION BY build_id, isl ORDER BY line_no) ELSE 0 END AS run, CASE WHEN ph = 1 THEN 20.0 ELSE 40.0 END AS idle, CASE WHEN kind = 'locus' THEN row_number() OVER (PARTITION BY build_id, kind ORDER BY line_no) END AS en FROM f),
q AS (SELECT build_id, min(CASE WHEN nx - t_s >= idle THEN t_s + idle END) AS a, min(CASE WHEN run >= 3 THEN t_s END) AS l, max(t_s) AS e, (max(line_no) % 2)::INT AS code, arg_max(lt, line_no) FILTER (WHERE kind = 'loop') AS lt, arg_max(ll, line_no) FILTER (WHERE kind = 'loop') AS ll, string_agg(substr(text, 5), ' | ' ORDER BY en) FILTER (WHERE en <= 2) AS head FROM r GROUP BY 1),
t AS (SELECT build_id, unnest([0, 1, 2]) AS k, unnest(['wall', 'loop_progress', 'activity']) AS reason, unnest([CASE WHEN e >= 40 THEN 40.0 END, l, a])::DOUBLE AS at_s FROM q), kl AS (SELECT build_id, arg_min(reason, (at_s, k)) AS reason FROM t WHERE at_s IS NOT NULL GROUP BY 1)
SELECT q.build_id, CASE WHEN reason IS NOT NULL THEN 'timeout' WHEN code = 0 THEN 'ok' ELSE 'fail' END AS outcome, CASE WHEN reason IS NOT NULL THEN 124 ELSE code END AS exit_code, reason AS timeout_reason,
CASE WHEN reason IS NULL THEN head WHEN lt IS NOT NULL THEN concat(reason, ': "by" line ', ll, ' of ', lt, ' (15.0s)') ELSE concat(reason, ' timeout (40s wall)') END AS error_head FROM q LEFT JOIN kl ON kl.build_id = q.build_id""")
def assembled_attempts(spark, sf_dir):
    found = logs.events(mapping.build_log(spark, sf_dir))
    codes = mapping.build_log(spark, sf_dir).groupBy("build_id").agg((F.max("line_no") % 2).cast("int").alias("exit_code"))
    return logs.assembled(found, codes).select("build_id", "outcome", "exit_code", "timeout_reason", "error_head")


@query("timeout_texts", _EVENTS + ", k AS (SELECT build_id, arg_max(lt, line_no) AS lt, arg_max(ll, line_no) AS ll FROM v WHERE kind = 'loop' GROUP BY 1) SELECT build_id, concat('wall: \"by\" line ', ll, ' of ', lt, ' (15.0s)') AS head, concat('last at ', lt, ' line ', ll) AS stuck, 'S' AS session, 'TIMEOUT' AS class FROM k")
def timeout_texts(spark, sf_dir):
    key = logs.last_loop_key(logs.events(mapping.build_log(spark, sf_dir)))
    wall = F.lit("wall")
    return key.select("build_id", logs.timeout_head(wall, F.col("loop_command"), F.col("loop_line"), F.col("loop_theory"), F.col("loop_elapsed"), F.lit(40.0)).alias("head"), logs.stuck_locus(F.col("loop_theory"), F.col("loop_line"), wall).alias("stuck"), logs.session_of(F.col("loop_theory")).alias("session"), logs.timeout_class(wall).alias("class"))


_CPU = f"WITH s AS ({mapping.CPU_SAMPLES}), m AS (SELECT build_id, pid, t_s, max(max(cpu_s)) OVER (PARTITION BY build_id, pid ORDER BY t_s) AS m FROM s GROUP BY 1, 2, 3), g AS (SELECT *, m - coalesce(lag(m) OVER (PARTITION BY build_id, pid ORDER BY t_s), 0) AS d FROM m), c AS (SELECT build_id, t_s, sum(sum(d)) OVER (PARTITION BY build_id ORDER BY t_s) AS c FROM g GROUP BY 1, 2)"


@query("cumulative_cpu", _CPU + " SELECT build_id, t_s, round(c, 4) AS cpu_s FROM c")
def cumulative_cpu(spark, sf_dir):
    return logs.cumulative_cpu(mapping.cpu_samples(spark, sf_dir)).withColumn("cpu_s", F.round("cpu_s", 4))


@query("contention", _CPU + ", w AS (SELECT *, first_value(c) OVER x AS c0, first_value(t_s) OVER x AS t0, count(*) OVER x AS n FROM c WINDOW x AS (PARTITION BY build_id ORDER BY t_s RANGE BETWEEN 15 PRECEDING AND CURRENT ROW)), d AS (SELECT *, CASE WHEN n >= 2 AND t_s - t0 >= 5 AND c >= c0 THEN (c - c0) / (t_s - t0) END AS duty FROM w) SELECT build_id, t_s, round(duty, 4) AS duty, CASE WHEN duty IS NULL THEN 'unknown' WHEN duty < 0.05 THEN 'stalled' WHEN duty >= 0.9 THEN 'running' ELSE 'starved' END AS verdict FROM d")
def contention(spark, sf_dir):
    found = logs.duty_cycles(logs.cumulative_cpu(mapping.cpu_samples(spark, sf_dir)))
    return found.select("build_id", "t_s", F.round("duty", 4).alias("duty"), logs.contention(F.col("duty"))["verdict"].alias("verdict"))


@query("cpu_time_texts", "SELECT l_orderkey AS build_id, l_linenumber, (l_partkey % 60) * 60.0 + l_suppkey % 60 + 3600.0 * (l_partkey % 24) AS seconds FROM lineitem")
def cpu_time_texts(spark, sf_dir):
    text = F.concat_ws(":", (F.col("l_partkey") % 24).cast("string"), (F.col("l_partkey") % 60).cast("string"), (F.col("l_suppkey") % 60).cast("string"))
    return mapping._read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("build_id"), "l_linenumber", scalars.cpu_seconds(text).alias("seconds"))


__all__ = ["ORACLES", "QUERIES", "with_previous"]
