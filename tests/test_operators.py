"""Small hand-written cases for the rules of the build-attempt operators."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tryloom.functions import argv, notes, scalars
from tryloom.operators import attribution, diffs, episodes, integrity, lengths, logs, progress
from tryloom.schemas import FIELDS, conform
from tryloom.sources import corpus


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def one_hunk(path, body, ctx=""):
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,2 +1,2 @@ {ctx}\n" + "\n".join(body) + "\n"


def attempts(spark, rows, corpus_id="c"):
    full = [{"corpus_id": corpus_id, "seq": i, "build_id": f"b{i}", "outcome": "ok", "diff": "", "ts": f"2026-01-0{1 + i % 9}"} | r for i, r in enumerate(rows)]
    names = {"corpus_id": "string", "seq": "long", "ts": "string"} | FIELDS
    used = [n for n in names if any(n in r for r in full)]
    schema = ", ".join(f"{n} {names[n]}" for n in used)
    return conform(spark.createDataFrame([tuple(r.get(n) for n in used) for r in full], schema))


CASES = [
    ("changed lemma", one_hunk("A.thy", ["-lemma a", "+lemma b"]), "code"),
    ("inside a document block", one_hunk("A.thy", [" text \\<open>", "-one", "+two", " \\<close>"]), "doc"),
    ("both", one_hunk("A.thy", ["-text \\<open>one\\<close>", "+text \\<open>two\\<close>", "+lemma b"]), "code"),
    ("comment only", one_hunk("A.thy", ["-(* a *)", "+(* b *)"]), "doc"),
    ("prose suffix", one_hunk("A.md", ["-a", "+b"]), "doc"),
    ("document folder", one_hunk("x/document/A.thy", ["-lemma a", "+lemma b"]), "doc"),
    ("unknown suffix", one_hunk("Makefile", ["-a", "+b"]), "code"),
    ("blank lines of another file", one_hunk("Makefile", ["-", "+"]), "doc"),
    ("no diff", "", "none"),
    ("moved line", one_hunk("A.thy", ["-lemma a", " x", "+lemma a"]), "doc"),
    ("seeded by the header", one_hunk("A.thy", ["-one", "+two"], "text \\<open>long"), "doc"),
    ("wrong seed recovers", one_hunk("A.thy", ["-one", "+two", " \\<close>"]), "doc"),
    ("guess ends at a command", one_hunk("A.thy", [" lemma x", "-by auto", "+by simp"], "text \\<open>long"), "code"),
    ("word guard", one_hunk("A.thy", ["-context a", "+context b"]), "code"),
]


def test_delta_class(spark):
    rows = diffs.classified(attempts(spark, [{"diff": d} for _, d, _ in CASES])).orderBy("seq").collect()
    assert [(n, r["delta_class"]) for (n, _, _), r in zip(CASES, rows, strict=True)] == [(n, k) for n, _, k in CASES]


def test_segmentation_and_lengths(spark):
    outcomes = ["fail", "fail", "ok", "ok", "fail", "ok", "fail"]
    rows = episodes.segment(attempts(spark, [{"outcome": o} for o in outcomes]))
    found = episodes.summary(diffs.classified(rows)).orderBy("episode_no").collect()
    assert [r["len_raw"] for r in found] == [3, 1, 2, 1]
    assert [r["is_closed"] for r in found] == [True, True, True, False]
    assert [r["len_attempt"] for r in found] == [3, None, 2, 1]  # a lone success without a change is no attempt


def test_order_survives_repartition(spark):
    rows = attempts(spark, [{"outcome": "ok" if i % 3 == 2 else "fail"} for i in range(30)])
    plain = {(r["seq"], r["episode_no"]) for r in episodes.segment(rows).collect()}
    assert plain == {(r["seq"], r["episode_no"]) for r in episodes.segment(rows.repartition(7, "build_id")).collect()}


def test_blocks_carry_over(spark, monkeypatch):
    from tryloom.operators import ordered

    rows = attempts(spark, [{"outcome": "ok" if i % 4 == 0 else "fail"} for i in range(25)])
    plain = {(r["seq"], r["episode_no"]) for r in episodes.segment(rows).collect()}
    monkeypatch.setattr(ordered, "BLOCK", 4)
    assert plain == {(r["seq"], r["episode_no"]) for r in episodes.segment(rows).collect()}
    previous = {r["seq"]: r["prev"] and r["prev"]["build_id"] for r in ordered.with_previous(rows, ["build_id"]).collect()}
    assert previous == {i: f"b{i - 1}" if i else None for i in range(25)}


def test_versions(spark):
    for text, known in (("0.6.1", True), ("0.10.0rc1", True), ("0.6", False), ("0+unknown", False), ("", False), (None, False), ("1", True)):
        assert value(spark, scalars.writer_at_least(F.lit(text).cast("string"), "0.6.1")) is known


def test_erfc(spark):
    from math import erfc

    for x in (0.0, 0.3, 1.0, 2.5, 5.0):
        assert value(spark, scalars.erfc(F.lit(x))) == pytest.approx(erfc(x), rel=2e-7)


def test_cpu_seconds(spark):
    cases = {"01:02": 62.0, "1:01:02.5": 3662.5, "2-01:00:00": 176400.0, "bad": None, "5": None}
    assert {k: value(spark, scalars.cpu_seconds(F.lit(k))) for k in cases} == cases


def test_notes(spark):
    parse = lambda t: value(spark, notes.parse(F.lit(t)))
    assert parse("diagnosis: a; change: b; expect: ok") == {"diagnosis": "a", "change": "b", "expect": "ok"}
    assert parse("diagnosis: v1.2 holds. expect: ok") == {"diagnosis": "v1.2 holds", "expect": "ok"}
    assert parse("first\n- Diagnosis: a\nmore; still") == {"notes": "first", "diagnosis": "a\nmore; still"}
    assert parse("  ") is None
    assert value(spark, notes.predicted(notes.parse(F.lit("expect: **FAIL** maybe")))) == "fail"
    assert value(spark, notes.predicted(notes.parse(F.lit("expect: not ok")))) is None
    assert value(spark, notes.lint(F.lit("change: x, expect: ok"))) == ["stranded"]


def test_argv(spark):
    command = F.array(*map(F.lit, ["isabelle", "build", "-d", "/t/x/", "-o", "-d", "-v", "A", "-j", "4", "B"]))
    assert value(spark, argv.load_dirs(command)) == ["t/x"]
    assert value(spark, argv.targets(command)) == ["A", "B"]
    strict = value(spark, argv.build_options(F.array(*map(F.lit, ["x", "build", "-bv", "-dbase", "-o", "k", "S", "-e"]))))
    assert strict["flags"] == ["b", "v"] and strict["sessions"] == ["S", "-e"]


def test_map_line(spark):
    ranges = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(h, ("old_start", "old_len", "new_start", "new_len"), strict=True)]) for h in ((5, 2, 5, 4), (20, 1, 22, 1))])
    assert [value(spark, diffs.map_line(ranges, F.lit(n))) for n in (4, 5, 6, 7, 19, 20, 21)] == [4, None, None, 9, 21, None, 23]


def test_roots(spark):
    text = 'session A = HOL +\n(* session B = HOL *)\nsession "C-D" in x = A +\n  session\n'
    assert value(spark, scalars.root_sessions(F.lit(text))) == ["A", "C-D"]


def test_attribution_moves_and_outside(spark):
    move = "diff --git a/t/a/X.thy b/t/b/X.thy\nsimilarity index 100%\nrename from t/a/X.thy\nrename to t/b/X.thy\n"
    root = "diff --git a/t/b/ROOT b/t/b/ROOT\n--- a/t/b/ROOT\n+++ b/t/b/ROOT\n@@ -1,0 +1,1 @@\n+session S = HOL +\n"
    rows = [{"diff": one_hunk("t/a/X.thy", ["+lemma a"]), "outcome": "fail"}, {"diff": move}, {"diff": root}, {"command": ["build", "-d", "scratch", "S"], "outcome": "ok"}, {"command": ["build", "-d", "/home/me/t", "S"], "outcome": "ok"}]
    rows = episodes.segment(attempts(spark, rows))
    at = attribution.fit(rows)
    assert {(r["dir"], r["label"]) for r in at.labels.collect()} == {("t/a", "b"), ("t/b", "b")}
    assert {(r["target"], r["dir"]) for r in at.targets.collect()} == {("S", "t/b")}
    assert [r["seq"] for r in attribution.loaded_outside(rows, at).collect()] == [3]
    assert {r["episode_no"]: r["project"] for r in attribution.project(rows, at).collect()} == {0: "b", 1: "b", 2: "none", 3: "b"}


def test_overrides(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"_why": 1, "aliases": {"x": "y"}, "targets": {"S": None}}))
    aliases, targets = attribution.load_overrides(spark, str(path))
    assert [tuple(r) for r in aliases.collect()] == [("x", "y")] and [tuple(r) for r in targets.collect()] == [("S", None)]
    path.write_text('{"alias": {}}')
    with pytest.raises(ValueError):
        attribution.load_overrides(spark, str(path))


def test_integrity_without_objects(spark):
    good = one_hunk("A.thy", ["-a", "+b", " c"])
    rows = [{"diff": good}, {"diff": good[:-3]}, {"diff": good.replace("+b\n", "")}, {"diff": " ", "outcome": "fail"}]
    judged = integrity.verdicts(attempts(spark, rows).withColumns({"base": F.lit(None).cast("string"), "regen": F.lit(None).cast("string")}))
    assert [r["verdict"] for r in judged.orderBy("seq").collect()] == ["unverified", "stripped?", "damaged", "empty-blind"]
    fixed = integrity.repaired(judged, heuristic=True).where("seq = 1").first()
    assert fixed["diff_repaired"] == "stripped?" and fixed["diff"].endswith(" \n")


def test_blob_id(spark):
    assert value(spark, integrity.blob_id(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_limit_changes(spark):
    a = F.create_map(F.lit("w"), F.lit(40.0), F.lit("x"), F.lit(1.0))
    b = F.create_map(F.lit("w"), F.lit(20.0), F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(2.0))
    assert value(spark, progress.changed_keys(a, b)) == ["w", "y"]


def test_fit_against_plain_python(spark):
    from math import log

    sample = [1] * 30 + [2] * 14 + [3] * 9 + [4] * 6 + [5] * 5 + [7] * 3 + [9, 12, 20, 31]
    counts = sorted({k: sample.count(k) for k in sample}.items())
    hist = spark.createDataFrame([("p", k, n) for k, n in counts], "project string, length long, trajectories long")
    got = lengths.fit(hist, ["project"]).first()
    tail = sorted(k for k in sample if k >= 2)
    best = None
    for xmin in sorted(set(tail)):
        part = [k for k in tail if k >= xmin]
        if len(part) < 15:
            break
        alpha = 1 + len(part) / sum(log(k / (xmin - 0.5)) for k in part)
        cdf = lambda k, x=xmin, a=alpha: 1 - ((k + 0.5) / (x - 0.5)) ** (1 - a)
        ks = max(max(abs((i + 1) / len(part) - cdf(k)), abs(cdf(k) - i / len(part))) for i, k in enumerate(part))
        if best is None or ks < best[0]:
            best = (ks, xmin, alpha)
    assert (got["ks"], got["xmin"], got["alpha"]) == (pytest.approx(best[0], abs=1e-6), best[1], pytest.approx(best[2], abs=1e-6))


LOG = [
    (0.0, "Session Unsorted/N"), (1.0, "Running N ..."), (2.0, "N: theory N.A 40%"), (15.0, 'N: command "by" running for 15.0s (line 12 of theory "N.A")'),
    (17.0, 'N: command "by" running for 17.0s (line 12 of theory "N.A")'), (19.0, 'N: command "by" running for 19.0s (line 12 of theory "N.A")'),
]


def log_frame(spark, lines, build="x"):
    return spark.createDataFrame([(build, i, t, s) for i, (t, s) in enumerate(lines)], "build_id string, line_no long, t_s double, text string")


def test_kills(spark):
    kill = lambda lines: next(((r["reason"], r["at_s"]) for r in logs.kills(logs.events(log_frame(spark, lines))).collect()), None)
    assert kill(LOG) == ("loop_progress", 19.0)
    assert kill(LOG[:4] + [(16.0, "N: theory N.B")] + [(t, s) for t, s in LOG[4:]]) is None
    assert kill([(0.0, "Session A/B"), (25.0, "late")]) == ("activity", 20.0)
    assert kill([(0.0, "warming up"), (25.0, "late")]) is None
    assert kill([(float(t), "Running N ...") for t in range(0, 50, 5)]) == ("wall", 40.0)


def test_sessions_and_notes(spark):
    lines = [(0.0, "Session A/B"), (12.0, "Building D ..."), (20.0, "Running N ...")]
    row = logs.session_timeline(logs.events(log_frame(spark, lines))).first()
    assert [(s["name"], s["role"], s["started_s"]) for s in row["sessions"]] == [("D", "dependency", 12.0), ("N", "target", 20.0)]
    empty = logs.session_timeline(logs.events(log_frame(spark, lines[:1]))).first()["sessions"]
    unknown = logs.session_timeline(logs.events(log_frame(spark, [(0.0, "x")]))).first()["sessions"]
    assert empty == [] and unknown is None


def test_cpu(spark):
    samples = spark.createDataFrame([("x", 0.0, 1, 1.0), ("x", 5.0, 1, 4.0), ("x", 5.0, 2, 2.0), ("x", 10.0, 2, 3.0)], "build_id string, t_s double, pid long, cpu_s double")
    cpu = logs.cumulative_cpu(samples)
    assert [(r["t_s"], r["cpu_s"]) for r in cpu.orderBy("t_s").collect()] == [(0.0, 1.0), (5.0, 6.0), (10.0, 7.0)]
    duty = logs.duty_cycles(cpu).orderBy("t_s").select("duty", logs.contention(F.col("duty")).alias("c")).collect()
    assert [d["duty"] for d in duty] == [None, 1.0, 0.6] and [d["c"]["verdict"] for d in duty] == ["unknown", "running", "starved"]


def test_corpus_scan_and_export(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(["", json.dumps({"build_id": "b0", "outcome": "fail", "sessions": []}), " ", json.dumps({"build_id": "b1", "outcome": "ok"}), "{bad", ""]))
    rows = corpus.scan(spark, str(path)).orderBy("seq")
    got = rows.collect()
    assert [(r["seq"], r["build_id"]) for r in got] == [(0, "b0"), (1, "b1"), (2, None)]
    assert got[0]["sessions"] == [] and got[1]["sessions"] is None
    made = episodes.export(episodes.segment(rows.where("outcome IS NOT NULL")))
    corpus.export_episodes(made, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert [(r["episode_id"], r["n"], r["instance_id"]) for r in back.collect()] == [("b1", 2, "unknown")]


def test_stream_agrees_with_batch(spark, tmp_path):
    from tryloom.streaming import builds

    begin = datetime(2026, 1, 1)
    rows = [{"build_id": "x", "line_no": i, "ts": (begin + timedelta(seconds=t)).isoformat(), "text": s} for i, (t, s) in enumerate(LOG)]
    rows += [{"build_id": "y", "line_no": i, "ts": (begin + timedelta(seconds=t)).isoformat(), "text": s} for i, (t, s) in enumerate([(0.0, "Session A/B"), (30.0, "late")])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    lines = corpus.log_stream(spark, str(tmp_path / "in"))
    run = builds.watched(lines).writeStream.format("memory").queryName("kills").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r["build_id"], r["reason"], r["at_s"]) for r in spark.table("kills").collect()} == {("x", "loop_progress", 19.0), ("y", "activity", 20.0)}
