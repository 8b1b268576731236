"""Steps that are to read or shuffle their input no more often than they need."""

from pyspark.sql import functions as F

from tests.test_operators import attempts, one_hunk
from tryloom.functions import notes
from tryloom.operators import attribution, diffs, episodes, lengths, logs
from tryloom.plans import more, queries, varied

SMALL = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_classes_come_without_a_shuffle(spark):
    rows = attempts(spark, [{"diff": one_hunk("t/a/X.thy", ["+lemma a"])}, {"diff": one_hunk("t/a/X.md", ["+words"])}, {"diff": ""}, {}, {"diff": one_hunk("t/a/ROOT", ["+session S"])}])
    found = diffs.classified(rows)
    assert "Join" not in planned(found) and "Aggregate" not in planned(found)
    assert [(r["delta_class"], r["proof_edit"]) for r in found.orderBy("seq").collect()] == [("code", True), ("doc", False), ("none", False), ("none", False), ("code", False)]


def test_kinds_are_the_verdicts_of_files(spark):
    rows = varied.attempts(spark, SMALL)
    own = rows.select(*diffs.KEY, F.posexplode(diffs.kinds(F.col("diff"))).alias("file_no", "f"))
    want = diffs.file_verdicts(diffs.files(rows)).select(*diffs.KEY, "file_no", "path_new", F.col("verdict") == "code", "proof_edit")
    assert sorted(map(str, map(tuple, own.select(*diffs.KEY, "file_no", "f.*").collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_projects_read_rows_that_are_numbered_once(spark):
    rows = queries._with_command(spark, SMALL)
    at = attribution.fit(rows)
    assert "Window" not in planned(attribution.project(rows, at))
    assert "Window" not in planned(attribution.loaded_outside(rows, at))
    # every command is looked at once, however many records have it
    assert attribution.commands(rows).count() == 12


def test_a_command_outside_is_so_for_each_of_its_records(spark):
    rows = episodes.segment(attempts(spark, [{"diff": one_hunk("t/a/X.thy", ["+lemma a"]), "command": ["build", "A"]}, *[{"command": ["build", "-d", "x", "-d", "y", "S", "S"]}] * 2, {"command": ["build", "-d", "x", "-d", "t", "S"]}]))
    at = attribution.fit(rows)
    assert sorted(r["seq"] for r in attribution.loaded_outside(rows, at).collect()) == [1, 2]
    assert {(r["target"], r["n"], r["verdict"]) for r in attribution.target_usage(rows, at).collect()} == {("A", 1, "mapped"), ("S", 5, "not derived")}


def test_daily_trials_count_as_often_as_trials(spark):
    rows = [("a", "d1", 1), ("a", "d1", 0), ("a", "d2", 1), ("b", "d1", 0), ("b", "d3", 1), ("none", "d1", 1)]
    found = spark.createDataFrame(rows, "project string, day string, one_shot int")
    by = lambda t: sorted(map(tuple, lengths.by_day(lengths.choose_groups(t)).collect()))
    assert by(lengths.daily(found)) == by(found) == [("d1", 2, 1, 1, 0), ("d2", 1, 1, 0, 0), ("d3", 0, 0, 1, 1)]


def test_days_are_read_without_their_episodes(spark):
    assert "Aggregate" not in planned(queries._days(spark, SMALL))


def test_logs_with_other_texts_are_numbered_once(spark):
    rows = more._lines(spark, SMALL, more._STUCK)
    assert "Join" not in planned(rows)
    # sessions, places and theories of a build come from one reading of its lines
    assert "Join" not in planned(logs.session_timeline(logs.events(rows)))


def test_fields_are_of_their_kind(spark):
    lines = ["Building D ...", "Session X/Y", '\x1b[1mD: command "by" running for 15.0s (line 3 of theory "D.T")', "D: theory D.T 40%", '*** At command "by" (line 3 of "a.thy")', "***\toops", "Running R ...", "note: nothing"]
    log = spark.createDataFrame([("b", i, float(i), t) for i, t in enumerate(lines)], "build_id string, line_no long, t_s double, text string")
    found = logs.events(log)
    fields = {r["line_no"]: {k: v for k, v in r.asDict().items() if v is not None and k not in ("build_id", "line_no", "t_s", "text", "kind", "is_phase")} for r in found.collect()}
    assert [fields[i] for i in (0, 2, 3, 5, 7)] == [{"session": "D", "verb": "Building"}, {"loop_theory": "D.T", "loop_line": "3", "loop_command": "by", "loop_elapsed": "15.0"}, {"theory": "D.T", "pct": 40}, {"error": "oops"}, {}]
    got = logs._told(found).first()
    assert [(x["name"], x["role"], x["started_s"]) for x in got["sessions"]] == [("D", "dependency", 0.0), ("R", "target", 6.0)]
    assert (got["loop_theory"], got["loop_line"], got["_stuck"]) == ("D.T", "3", "D.T")


def test_a_note_is_read_once(spark):
    rows = spark.createDataFrame([("change: x, expect: ok",), ("just text",), ("EXPECT: maybe",), ("- Change: y\nmore",), ("",), (None,)], "note string")
    found = rows.select(notes.lint(F.col("note")).alias("l"))
    assert planned(found).count("aggregate(") == 1
    assert [r["l"] for r in found.collect()] == [["stranded"], ["no_section"], ["unscored"], ["no_expect"], ["no_section"], []]
