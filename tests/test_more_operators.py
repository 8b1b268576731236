"""Line modes, streams, heaps and texts of kills, on small cases."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_operators import attempts, one_hunk, value
from tryloom.functions import scalars
from tryloom.operators import attribution, diffs, integrity, logs, ordered
from tryloom.sources import corpus

BEGIN = datetime(2026, 1, 1)


def test_long_hunks_are_walked_by_blocks(spark):
    """State is carried over blocks of lines; a token far back still counts."""
    body = ["+text \\<open>", *[f"+word {i}" for i in range(300)], "+ \\<close>", *[f"+lemma l{i}" for i in range(100)]]
    found = diffs.file_verdicts(diffs.files(attempts(spark, [{"diff": one_hunk("A.thy", body)}]))).first()
    assert found["verdict"] == "code" and list(found["evidence"]) == [f"+lemma l{i}" for i in range(100)]


@pytest.mark.parametrize("large", [False, True])
def test_build_log_lines(spark, tmp_path, large):
    (tmp_path / "b7.log").write_text("\x1b[1mone\x1b[0m\r\n\ntwo\nthree")
    rows = corpus.build_log(spark, str(tmp_path / "b7.log"), large).orderBy("line_no").collect()
    assert [(r["build_id"], r["line_no"], r["text"]) for r in rows] == [("b7", 0, "one"), ("b7", 1, ""), ("b7", 2, "two"), ("b7", 3, "three")]


def test_pool_and_rewrite(spark, tmp_path):
    a = attempts(spark, [{"instance_id": "i"}, {"instance_id": "i"}], "a")
    b = attempts(spark, [{"instance_id": "i"}, {"instance_id": "j", "branch": "x"}], "b")
    assert [(r["seq"], r["build_id"], r["instance_id"]) for r in corpus.pool([a, b]).orderBy("seq").collect()] == [(0, "b0", "i"), (1, "b1", "i"), (2, "b0", "i"), (3, "b1", "j")]
    assert corpus.pool([a, b], distinct=True).count() == 3
    corpus.rewrite(a, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        corpus.rewrite(a, str(tmp_path / "out"))


def test_parents_and_heaps(spark):
    text = '(* session No = HOL + *)\nsession A = HOL +\n  theories X\nsession "B-b" (main) in "d" = A +\nsession Root\n session C in e="B-b" + theories'
    assert [tuple(p) for p in value(spark, scalars.root_parents(F.lit(text)))] == [("A", "HOL"), ("B-b", "A"), ("C", "B-b")]
    parents = spark.createDataFrame([("A", "HOL"), ("B", "A"), ("C", "A"), ("A", "A")], "child string, parent string")
    commands = [["isabelle", "build", "A"], ["isabelle", "build", "-b", "A"], ["isabelle", "build", "A", "C"], ["isabelle", "build", "B"], ["isabelle", "build"], None]
    rows = attempts(spark, [{"command": c} for c in commands])
    found = {r["seq"]: (r["session"], r["children"]) for r in attribution.children_without_heap(rows, parents).collect()}
    assert found == {0: ("A", ["B", "C"]), 1: ("A", []), 2: ("A", []), 3: ("B", [])}


def test_timeout_texts(spark):
    key = F.expr("named_struct('loop_theory', 'S.T', 'loop_line', '7', 'loop_command', 'by', 'loop_elapsed', '15.0')")
    none = F.expr("named_struct('loop_theory', CAST(NULL AS STRING), 'loop_line', '', 'loop_command', '', 'loop_elapsed', '')")
    progress, blank = F.expr("named_struct('theory', 'S.U', 'pct', 42)"), F.expr("named_struct('theory', CAST(NULL AS STRING), 'pct', 1)")
    said = lambda reason, k, p, notes=(): value(spark, logs.timeout_text(F.lit(reason), k, F.lit(3), F.lit(40), F.lit(20), p, F.array(*map(F.lit, notes)).cast("array<string>")))
    assert said("loop_progress", key, blank, ["on battery"]) == 'LOOP  S.T: "by" looping on line 7 (3x same line, last 15.0s elapsed)  (on battery)'
    assert said("wall", key, blank) == 'TIMEOUT  40s wall clock exceeded (last: "by" at S.T line 7, 15.0s)'
    assert said("activity", none, progress) == "STUCK  S.U 42%  no output for 20s"


def test_last_value_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 3)
    rows = spark.createDataFrame([("c", i, "v" + str(i) if i in (1, 2, 8) else None) for i in range(12)], "corpus_id string, seq long, x string")
    found = ordered.with_last(rows, F.col("x"), "last").orderBy("seq").collect()
    assert [r["last"] for r in found] == [None, None, "v1"] + ["v2"] * 6 + ["v8"] * 3


def test_backfill(spark):
    legacy = attempts(spark, [{"git_head": h} for h in ("h1", "h1", "h1", "h2")])
    chain = spark.createDataFrame([("b0", "t0"), ("b2", "t2"), ("b3", "t3")], "build_id string, tree string")
    trees = spark.createDataFrame([("h1", "r1"), ("h2", "r2")], "git_head string, head_tree string")
    known = spark.createDataFrame([("r1", "t0", "d0"), ("t0", "t2", "d2")], "base string, tree string, diff string")
    got = {r["seq"]: (r["base"], r["diff"], r["backfilled"]) for r in integrity.backfilled(legacy, chain, trees, known).collect()}
    assert got == {0: ("r1", "d0", True), 1: (None, None, False), 2: ("t0", "d2", True), 3: ("r2", None, False)}


def _stream(spark, tmp_path, rows, schema):
    """A stream over JSON files, one a batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, batch in enumerate(rows):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, batch)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))  # the order they are read in
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def _table(spark, tmp_path, name, df):
    """The rows that a stream gave, as a table in memory."""
    run = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return spark.table(name)


def test_tree_cpu_streams(spark, tmp_path):
    from tryloom.streaming import builds

    stamp = lambda s: (BEGIN + timedelta(seconds=s)).isoformat()
    sample = lambda s, pid, cpu: {"build_id": "b", "pid": pid, "ts": stamp(s), "cpu_s": cpu}
    rows = [[sample(0, 1, 1.0), sample(0, 2, 2.0)], [sample(5, 1, 4.0), sample(10, 2, 1.5)]]
    found = _table(spark, tmp_path, "cpu", builds.tree_cpu(_stream(spark, tmp_path, rows, "build_id string, pid long, ts timestamp, cpu_s double")))
    assert [r["cpu_s"] for r in found.orderBy("ts").collect()] == [3.0, 6.0, 6.0]


def test_rolling_keeps_open_episodes(spark, tmp_path):
    from tryloom.streaming import builds

    row = lambda seq, ep, outcome: {"corpus_id": "c", "episode_no": ep, "seq": seq, "outcome": outcome}
    rows = [[row(0, 0, "fail"), row(1, 0, "ok"), row(2, 1, "fail")], [row(3, 1, "fail")], [row(4, 1, "ok"), row(5, 2, "fail")]]
    out = str(tmp_path / "out")
    run = builds.rolling(_stream(spark, tmp_path, rows, "corpus_id string, episode_no long, seq long, outcome string"), out, str(tmp_path / "cp"))
    run.processAllAvailable()
    run.stop()
    assert [(r["episode_no"], r["last_seq"], r["n"], r["closed"]) for r in builds.rolled(spark, out).orderBy("episode_no").collect()] == [(0, 1, 2, True), (1, 4, 3, True), (2, 5, 1, False)]


def test_watch_drops_finished_builds(spark, tmp_path):
    """Lines behind a build's end open no new one."""
    from tryloom.streaming import builds

    line = lambda n, s, text: {"build_id": "x", "line_no": n, "ts": (BEGIN + timedelta(seconds=s)).isoformat(), "text": text}
    rows = [[line(0, 0, "Session A/B"), line(1, 30, "x")], [line(2, 31, "y"), line(3, 95, "z")]]
    rows.append([line(9, -3600, "long ago")])
    found = _table(spark, tmp_path, "over", builds.watched(_stream(spark, tmp_path, rows, "build_id string, line_no long, ts timestamp, text string")))
    assert [(r["reason"], r["at_s"]) for r in found.collect()] == [("activity", 20.0)]


def test_late_rows_are_counted(spark, tmp_path):
    from tryloom.streaming import builds

    line = lambda build, n, s: {"build_id": build, "line_no": n, "ts": (BEGIN + timedelta(seconds=s)).isoformat(), "text": "Session A/B"}
    rows = [[line("x", 0, 0)], [line("y", 0, 3600)], [line("z", 0, 7200)], [line("w", 0, 0), line("w", 1, 1)]]
    run = builds.watched(_stream(spark, tmp_path, rows, "build_id string, line_no long, ts timestamp, text string")).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    late = builds.late_rows(run)
    run.stop()
    # x and y broke their idle budgets by timers, as no further line came; z is still open
    assert {(r["build_id"], r["reason"], round(r["at_s"])) for r in spark.table("late").collect()} == {("x", "activity", 20), ("y", "activity", 20)}
    assert late == 2
