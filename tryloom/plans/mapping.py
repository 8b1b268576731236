"""The driver's tables seen as attempts, build logs and CPU samples.

Each has an SQL form that runs alike on Spark and DuckDB, for the oracles, and
a DataFrame form that numbers rows without one task holding a whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.operators.ordered import number_rows

_PATH = "concat('t/s', user_id % 6, '/T', event_id % 4, CASE WHEN event_id % 11 = 0 THEN '.md' ELSE '.thy' END)"

OUTCOME = "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'ok' WHEN 'signup' THEN 'timeout' ELSE 'fail' END"

#: Columns of an attempt but for ``seq``, from ``events``.
ATTEMPT_COLUMNS = f"""
concat('c', user_id % 4) AS corpus_id, event_id, ts, user_id, concat('i', user_id % 3) AS instance_id, concat('b', event_id) AS build_id,
{OUTCOME} AS outcome,
CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'loop_progress' WHEN 1 THEN 'wall' ELSE 'activity' END END AS timeout_reason,
ROUND(value, 1) AS elapsed_s,
CASE WHEN user_id % 5 = 0 THEN 'battery' ELSE 'ac' END AS power,
concat('h', CAST(FLOOR(event_id / 50) AS INT)) AS git_head,
concat('t', event_id - event_id % 2) AS tree,
CAST(CASE WHEN event_id % 9 = 0 THEN 20 ELSE 40 END AS DOUBLE) AS wall_timeout,
CASE WHEN event_id % 5 = 0 THEN '' ELSE
  concat('diff --git a/', {_PATH}, ' b/', {_PATH}, chr(10),
         '--- a/t/s', user_id % 6, '/T', event_id % 4, '.thy', chr(10),
         '+++ b/t/s', user_id % 6, '/T', event_id % 4, '.thy', chr(10),
         '@@ -', 1 + event_id % 40, ',1 +', 1 + event_id % 40, ',2 @@', chr(10),
         ' theory T', event_id % 4, chr(10), '+lemma l', event_id, ': "True" by simp', chr(10)) END AS diff,
CASE WHEN event_type IN ('error', 'view') THEN
  concat('Failed to finish proof | At command "by" (line ', 1 + event_id % 40, ' of "~/p/t/s', user_id % 6, '/T', event_id % 4, '.thy")') END AS error_head,
CASE WHEN event_id % 3 = 0 THEN concat('diagnosis: k', event_id % 10, '; expect: ', CASE event_id % 2 WHEN 0 THEN 'ok' ELSE 'fail' END) END AS note
"""

ATTEMPTS = f"SELECT CAST(ROW_NUMBER() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS BIGINT) AS seq, {ATTEMPT_COLUMNS} FROM events"

_LINE_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_LINE_TEXT = """CASE WHEN l_linenumber = 1 THEN concat('Session Unsorted/S', l_suppkey % 5)
            WHEN l_returnflag = 'N' THEN concat('S: command "by" running for 15.0s (line ', 10 + l_orderkey % 3, ' of theory "S.T', l_orderkey % 4, '")')
            WHEN l_returnflag = 'R' THEN concat('S: theory S.T', l_partkey % 4, ' ', l_partkey % 100, '%')
            ELSE concat('*** At command "by" (line ', l_partkey % 50, ' of "~/p/t/s', l_suppkey % 6, '/T', l_partkey % 4, '.thy")') END"""
BUILD_LOG = f"""
SELECT l_orderkey AS build_id, CAST(ROW_NUMBER() OVER ({_LINE_ORDER}) AS BIGINT) AS line_no,
       SUM(l_quantity) OVER ({_LINE_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t_s,
       {_LINE_TEXT} AS text
FROM lineitem
"""

CPU_SAMPLES = """
SELECT l_orderkey AS build_id, CAST(l_linenumber * 5 AS DOUBLE) AS t_s, l_suppkey % 3 AS pid, ROUND(l_linenumber * 2.0 + l_tax * 100, 2) AS cpu_s FROM lineitem
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What ``mapped`` reads.
NUMBERED = ("event_id", "ts", "user_id", "event_type", "value", "seq")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``corpus_id``, ``outcome`` and ``seq``: narrow rows, so that these are what is shuffled."""
    rows = _read(spark, sf_dir, "events").withColumns({"corpus_id": F.expr("concat('c', user_id % 4)"), "outcome": F.expr(OUTCOME)})
    return number_rows(rows, ["corpus_id"], F.to_date("ts"), ["ts", "event_id"])


def mapped(rows: DataFrame, *more: str) -> DataFrame:
    """The columns of attempts, of ``numbered`` rows."""
    return rows.sparkSession.sql(f"SELECT {', '.join([ATTEMPT_COLUMNS, 'seq', *more])} FROM {{events}}", events=rows)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(numbered(spark, sf_dir))


def build_log(spark: SparkSession, sf_dir: str, text: str = _LINE_TEXT) -> DataFrame:
    """``text`` is worked out in the pass that numbers the lines."""
    return spark.sql(BUILD_LOG.replace(_LINE_TEXT, text).replace("FROM lineitem", "FROM {lineitem}"), lineitem=_read(spark, sf_dir, "lineitem"))


def cpu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CPU_SAMPLES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_read(spark, sf_dir, "lineitem"))
