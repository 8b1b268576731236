"""Streams say what the batch rules say of the same rows, however these fall into batches."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tryloom.operators import episodes, logs
from tryloom.streaming import builds, cpu, gate
from tryloom.streaming import episodes as live

BEGIN = datetime(2026, 1, 1)
LINES = "build_id string, line_no long, ts timestamp, text string, final boolean"
WARN = 'S: command "by" running for 15.0s (line {} of theory "S.T")'


def stamp(seconds: float) -> str:
    return (BEGIN + timedelta(seconds=seconds)).isoformat(timespec="microseconds")


def files(tmp_path, name, batches):
    """One JSON file a batch, in their order."""
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    begin = len(os.listdir(folder))
    for i, batch in enumerate(batches, begin):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, batch)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    return str(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def finished(df, tmp_path, name, mode="append"):
    run = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert run.exception() is None
    return run


def random_builds(rng, n=14):
    """Lines of builds that break each of the budgets, or none."""
    rows = []
    for b in range(n):
        at, begin = 0.0, rng.randint(0, 200)
        count = rng.randint(1, 14)
        for i in range(count):
            at += rng.choice([0, 1, 2, 3, 8, 19, 20, 21] if b % 4 != 1 else [0, 1, 2]) if i else 0
            text = WARN.format(7) if b % 4 == 1 and i > 1 else rng.choice(["Session A/B", "Building S ...", WARN.format(7), WARN.format(7), WARN.format(8), "x", "S: theory S.T 40%"])
            rows.append({"build_id": f"b{b}", "line_no": i, "t_s": at, "at": begin + at, "text": text, "final": i == count - 1 and b % 3 > 0})
    return rows


def arrivals(rng, rows, delay=59, batches=5):
    """``rows`` in an order in which none is behind the watermark, cut into batches; some come twice."""
    ordered = sorted((*rows, *rng.sample(rows, len(rows) // 8)), key=lambda r: r["at"] + rng.uniform(0, delay))
    cuts = sorted(rng.sample(range(1, len(ordered)), batches - 1))
    return [ordered[a:b] for a, b in zip([0, *cuts], [*cuts, len(ordered)])]


@pytest.mark.parametrize("seed", [1, 3])
def test_any_split_of_lines_gives_the_kills_of_the_whole_logs(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = random_builds(rng)
    line = lambda r: {"build_id": r["build_id"], "line_no": r["line_no"], "ts": stamp(r["at"]), "text": r["text"], "final": r["final"]}
    batches = [[line(r) for r in batch] for batch in arrivals(rng, rows)]
    batches.append([{"build_id": "end", "line_no": 0, "ts": stamp(5000), "text": "x", "final": True}])
    finished(builds.watched(stream(spark, files(tmp_path, "in", batches), LINES), first=0 if seed == 3 else None), tmp_path, f"kills{seed}")
    got = {(r["build_id"], r["reason"], round(r["at_s"], 6)) for r in spark.table(f"kills{seed}").collect()}
    found = logs.events(spark.createDataFrame([(r["build_id"], r["line_no"], r["t_s"], r["text"]) for r in rows], "build_id string, line_no long, t_s double, text string"))
    open_ones = {r["build_id"] for r in rows} - {r["build_id"] for r in rows if r["final"]}
    begin = {r["build_id"]: r["at"] for r in rows if r["line_no"] == 0}
    ends = spark.createDataFrame([(b, 5000.0 - 60 - begin[b]) for b in sorted(open_ones)], "build_id string, end_s double")
    want = {(r["build_id"], r["reason"], round(r["at_s"], 6)) for r in logs.kills(found, ends).collect()}
    assert got == want and {r for _, r, _ in want} >= {"activity", "loop_progress"}
    assert any(r["build_id"] not in {w[0] for w in want} for r in rows)


def test_a_line_that_comes_a_batch_late_counts(spark, tmp_path):
    line = lambda n, s, text: {"build_id": "b", "line_no": n, "ts": stamp(s), "text": text, "final": n == 4}
    batches = [[line(0, 0, "Session A/B"), line(2, 2, WARN.format(7)), line(3, 3, WARN.format(7))], [line(1, 1, WARN.format(7))], [line(4, 4, "x"), {"build_id": "c", "line_no": 0, "ts": stamp(900), "text": "x", "final": True}]]
    finished(builds.watched(stream(spark, files(tmp_path, "in", batches), LINES)), tmp_path, "late_line")
    assert [(r["build_id"], r["reason"], r["at_s"]) for r in spark.table("late_line").collect()] == [("b", "loop_progress", 3.0)]


def test_duty_of_a_stream_is_that_of_the_samples(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for b in range(4):
        cpu_s, begin = dict.fromkeys(range(3), 0.0), rng.randint(0, 100)
        for i in range(25):
            for pid in cpu_s:
                cpu_s[pid] += rng.choice([0, 0, 0.5, 2, 5]) if rng.random() < 0.9 else -1
                if rng.random() < 0.8:
                    rows.append({"build_id": f"b{b}", "pid": pid, "t_s": i * 4.0, "at": begin + i * 4.0, "cpu_s": round(cpu_s[pid], 3)})
    sample = lambda r: {"build_id": r["build_id"], "pid": r["pid"], "ts": stamp(r["at"]), "cpu_s": r["cpu_s"]}
    batches = [[sample(r) for r in batch] for batch in arrivals(rng, rows, batches=6)]
    batches += [[{"build_id": "end", "pid": 1, "ts": stamp(s), "cpu_s": 0.0}] for s in (3000, 9000)]
    run = finished(cpu.live_duty(stream(spark, files(tmp_path, "in", batches), "build_id string, pid long, ts timestamp, cpu_s double"), keep_s=600), tmp_path, "duty")
    begin = {}
    for r in rows:
        begin[r["build_id"]] = r["at"] - r["t_s"]
    got = {(r["build_id"], round((r["ts"] - BEGIN).total_seconds() - begin[r["build_id"]], 3)): (round(r["cpu_s"], 6), None if r["duty"] is None else round(r["duty"], 6)) for r in spark.table("duty").where("build_id <> 'end'").collect()}
    known = spark.createDataFrame([(r["build_id"], r["pid"], r["t_s"], r["cpu_s"]) for r in rows], "build_id string, pid long, t_s double, cpu_s double")
    want = {(r["build_id"], r["t_s"]): (round(r["cpu_s"], 6), None if r["duty"] is None else round(r["duty"], 6)) for r in logs.duty_cycles(logs.cumulative_cpu(known)).collect()}
    assert got == want and any(d for _, d in want.values())
    # what is left is of the build that ended the stream
    assert sum(op["numRowsTotal"] for op in run.lastProgress["stateOperators"]) <= 4


def test_episodes_after_every_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for c in ("c", "d"):
        for i in range(40):
            rows.append({"corpus_id": c, "seq": i, "build_id": f"{c}{i}", "at": float(i), "outcome": rng.choice(["ok", "fail", "fail", "timeout", None]), "delta_class": rng.choice(["code", "none", "doc"])})
    schema = "corpus_id string, seq long, build_id string, ts timestamp, outcome string, delta_class string"
    row = lambda r: {k: v for k, v in r.items() if k != "at"} | {"ts": stamp(r["at"])}
    batches = [[row(r) for r in batch] for batch in arrivals(rng, rows, delay=6, batches=5)]
    folder = files(tmp_path, "in", batches[:1])
    run = live.live_episodes(stream(spark, folder, schema)).writeStream.format("memory").queryName("eps").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    seen = []
    try:
        for n in range(1, len(batches) + 1):
            run.processAllAvailable()
            seen += batches[n - 1]
            # what stands before the first attempt that is not there yet
            there = {(r["corpus_id"], r["seq"]): r for r in seen}
            prefix = [there[c, i] for c in ("c", "d") for i in range(next(k for k in range(41) if (c, k) not in there))]
            known = spark.createDataFrame([tuple(r[k] if k != "ts" else datetime.fromisoformat(r[k]) for k in ("corpus_id", "seq", "build_id", "ts", "outcome", "delta_class")) for r in prefix], schema)
            want = episodes.summary(episodes.segment(known))
            columns = sorted(want.columns)
            got = live.latest(spark.table("eps")).select(columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.select(columns).collect())), n
            files(tmp_path, "in", batches[n : n + 1])
    finally:
        run.stop()


def test_late_rows_are_counted_by_build_over_restarts(spark, tmp_path):
    """More batches than Spark keeps updates of, a restart in between: each late row is counted once, with its build, and what came in time is watched as if nothing else had come."""
    line = lambda build, n, s: {"build_id": build, "line_no": n, "ts": stamp(s), "text": "Session A/B", "final": False}
    batches = [[line(f"b{i}", 0, 100 * i)] + ([line(f"late{i % 3}", i, 0)] if i % 5 == 4 else []) for i in range(110)]
    path, folder = str(tmp_path / "gate"), files(tmp_path, "in", batches[:60])
    assert gate.late_counts(spark, path).collect() == []
    for part in (batches[60:], []):
        run = gate.gated(stream(spark, folder, LINES), path, str(tmp_path / "cp"), availableNow=True)
        run.awaitTermination(600)
        assert run.exception() is None
        files(tmp_path, "in", part)
    got = {r["build_id"]: r["late"] for r in gate.late_counts(spark, path).collect()}
    late = [r["build_id"] for batch in batches for r in batch if r["build_id"].startswith("late")]
    assert got == {b: late.count(b) for b in set(late)}
    found = spark.read.parquet(f"{path}/rows/*")
    assert found.count() == 110 and found.where("build_id LIKE 'late%'").count() == 0
    schema = "build_id string, line_no long, ts timestamp, text string, final boolean"
    finished(builds.watched(gate.accepted(spark, path, schema)), tmp_path, "behind")
    assert spark.table("behind").count() == 109 and spark.table("behind").where("reason <> 'activity'").count() == 0


def test_the_gate_prepares_rows(spark, tmp_path):
    rows = [[{"build_id": "b", "line_no": i, "ts": stamp(i), "text": "x", "final": False}] for i in range(2)]
    run = gate.gated(stream(spark, files(tmp_path, "in", rows), LINES), str(tmp_path / "g"), str(tmp_path / "cp"), prepare=lambda df: df.withColumn("n", F.length("text")), availableNow=True)
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "g/rows/*")).agg(F.sum("n")).first()[0] == 2
