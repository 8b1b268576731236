"""What goes by blocks says the same as what goes at once."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tryloom.operators import logs, ordered

WARN = 'S: command "by" running for 15.0s (line {} of theory "S.T")'


def plain_kill(lines, end=None, activity=20.0, wall=40.0, threshold=3):
    """The first broken budget of one log, line by line."""
    run, place, phase, last, found = 0, None, False, None, []
    for t, text in lines:
        idle = activity if phase else activity + 20
        if last is not None and t - last >= idle:
            found.append((last + idle, 2, "activity"))
        here = text if "running for" in text else None
        run = 0 if here is None else run + 1 if here == place else 1
        place, last, phase = here, t, phase or text.startswith("Session ")
        if run >= threshold:
            found.append((t, 1, "loop_progress"))
    idle = activity if phase else activity + 20
    if end is not None and end - last >= idle:
        found.append((last + idle, 2, "activity"))
    if max([t for t, _ in lines] + [end or 0]) >= wall:
        found.append((wall, 0, "wall"))
    return min(found, default=None)


@pytest.mark.parametrize("block", [1, 2, 3, 100_000])
@pytest.mark.parametrize("threshold", [1, 3, 4])
def test_kills_by_blocks(spark, monkeypatch, block, threshold):
    monkeypatch.setattr(ordered, "BLOCK", block)
    rng = random.Random(block + threshold)
    rows, want, ends = [], {}, []
    for b in range(60):
        t, lines = 0.0, []
        for _ in range(rng.randint(1, 12)):
            t += rng.choice([0, 1, 2, 5, 19, 20, 21, 41])
            lines.append((t, rng.choice(["Session A/B", WARN.format(7), WARN.format(7), WARN.format(7), WARN.format(8), "x"])))
        rows += [(b, i * (1 if b % 2 else 3), t, x) for i, (t, x) in enumerate(lines)]
        end = t + rng.choice([0, 19, 20, 40]) if b % 3 == 0 else None
        ends += [(b, end)] if end is not None else []
        want[b] = plain_kill(lines, end, threshold=threshold)
    found = logs.events(spark.createDataFrame(rows, "build_id int, line_no long, t_s double, text string"))
    got = {r["build_id"]: (r["at_s"], r["reason"]) for r in logs.kills(found, spark.createDataFrame(ends, "build_id int, end_s double"), threshold=threshold).collect()}
    assert got == {b: (k[0], k[2]) for b, k in want.items() if k}


def test_first_lines_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 3)
    rows = [("b", i, 0.0, f"*** e{i}" if i % 2 else "x") for i in range(20)] + [("c", i, 0.0, f"*** c{i}") for i in range(9)]
    found = logs.events(spark.createDataFrame(rows, "build_id string, line_no long, t_s double, text string"))
    assert {r["build_id"]: r["error_head"] for r in logs.error_heads(found).collect()} == {"b": "e1 | e3", "c": "c0 | c1"}
    assert {r["build_id"]: r["block"] for r in logs.failure_block(found).collect()} == {"b": "e1", "c": "\n".join(f"c{i}" for i in range(6))}


def plain_duty(samples, window=15, least=5.0):
    most, out = {}, []
    for t in sorted({s[1] for s in samples}):
        for pid, at, cpu in samples:
            if at == t:
                most[pid] = max(most.get(pid, 0.0), cpu)
        out.append((t, sum(most.values())))
    rows = []
    for t, c in out:
        inside = [(a, b) for a, b in out if t - window <= a <= t]
        span = t - inside[0][0]
        rows.append((t, round(c, 6), round((c - inside[0][1]) / span, 6) if len(inside) > 1 and span >= least and c >= inside[0][1] else None))
    return rows


@pytest.mark.parametrize("block", [15.0, 20.0, 1e6])
def test_duty_by_blocks(spark, block):
    """Blocks of three or four samples, with gaps and processes that come and go, against one pass over the samples."""
    rng = random.Random(int(block))
    rows = []
    for b in range(5):
        own = [(rng.randrange(3), float(t), round(rng.uniform(0, 3) + t / 4, 2)) for t in range(0, 200, 5) for _ in range(rng.choice([0, 1, 1, 3]))]
        rows += [(b, *s) for s in own]
    samples = spark.createDataFrame(rows, "build_id int, pid int, t_s double, cpu_s double")
    got = logs.duty_cycles(logs.cumulative_cpu(samples, block), block_s=block)
    for b in range(5):
        own = [(r["t_s"], round(r["cpu_s"], 6), None if r["duty"] is None else round(r["duty"], 6)) for r in got.where(F.col("build_id") == b).orderBy("t_s").collect()]
        assert own == plain_duty([r[1:] for r in rows if r[0] == b])


def test_one_build_of_a_million_samples(spark):
    samples = spark.range(1_000_000).select(F.lit("b").alias("build_id"), (F.col("id") % 2).alias("pid"), F.floor(F.col("id") / 2).cast("double").alias("t_s"), (F.floor(F.col("id") / 2) / 4).alias("cpu_s"))
    began = time.time()
    found = logs.duty_cycles(logs.cumulative_cpu(samples)).agg(F.count("*").alias("n"), F.count("duty").alias("d"), F.min("duty").alias("a"), F.max("duty").alias("b"), F.max("cpu_s").alias("c")).first()
    assert (found["n"], found["d"], found["a"], found["b"], found["c"]) == (500_000, 499_995, 0.5, 0.5, 249_999.5) and time.time() - began < 120
