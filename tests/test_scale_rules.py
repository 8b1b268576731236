"""Rules that must hold, and stay quick, for long chains, long files, long hunks, many draws and split files."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.test_operators import attempts, one_hunk
from tryloom.operators import attribution, components, diffs, integrity, lengths
from tryloom.sources import corpus


def plain_components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {x: find(x) for x in up}


def test_components_of_random_edges(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(90):02}", f"n{rng.randrange(90):02}") for _ in range(60)] + [("z", "z"), (None, "a"), ("b", None), ("n01", "n02"), ("n02", "n01")]
    got = {r["node"]: r["part"] for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == plain_components(edges)
    assert components.components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_a_chain_of_a_thousand_moves(spark, monkeypatch):
    rounds = []
    once = components._contracted
    monkeypatch.setattr(components, "_contracted", lambda edges: rounds.append(1) or once(edges))
    moves = spark.createDataFrame([("c", i, 0, f"x/d{i:04}", f"x/d{i + 1:04}") for i in range(1000)], "corpus_id string, seq long, file_no int, old_dir string, new_dir string")
    found = attribution.move_aliases(moves)
    assert found.count() == 1000 and found.select("label").distinct().collect() == [("d1000",)] and len(rounds) <= 12


def git_id(text):
    data = text.encode()
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


def test_a_long_file_with_many_hunks(spark):
    """200,000 lines, 5,000 hunks that add, drop and change lines: the id is the new file's."""
    rng = random.Random(2)
    old = [f"line {i}" for i in range(200_000)]
    new, hunks, at = [], [], 0
    for start in sorted(rng.sample(range(0, 199_000, 20), 5_000)):
        new += old[at:start]
        gone, put = rng.randint(0, 3), [f"new {start} {k}" for k in range(rng.randint(0, 3))]
        body = [f"-{ln}" for ln in old[start : start + gone]] + [f"+{ln}" for ln in put]
        hunks += [f"@@ -{start + 1 if gone else start},{gone} +{len(new) + 1 if put else len(new)},{len(put)} @@", *body]
        new += put
        at = start + gone
    new += old[at:]
    text, made = "\n".join(old) + "\n", "\n".join(new) + "\n"
    diff = "\n".join(["diff --git a/A.thy b/A.thy", "--- a/A.thy", "+++ b/A.thy", *hunks, ""])
    rows = attempts(spark, [{"diff": diff, "tree": "t"}]).withColumn("base", F.lit("b"))
    entries = spark.createDataFrame([("b", "A.thy", git_id(text)), ("t", "A.thy", git_id(made))], "tree string, path string, blob_id string")
    blobs = spark.createDataFrame([(git_id(text), text)], "blob_id string, content string")
    began = time.time()
    assert [r["verdict"] for r in integrity.replayed(rows, entries, blobs).collect()] == ["ok"]
    assert time.time() - began < 60


def test_a_hunk_of_a_hundred_thousand_lines(spark):
    body = [x for i in range(25_000) for x in (f"+text \\<open>word {i}", f"+more\\<close> (* no {i} *)", f"+lemma l{i}", f" by \\<open>x\\<close> {i}")]
    began = time.time()
    found = diffs.file_verdicts(diffs.files(attempts(spark, [{"diff": one_hunk("A.thy", body)}]))).select("verdict", F.size("evidence").alias("n"), F.get("evidence", F.lit(24_999)).alias("last")).first()
    assert (found["verdict"], found["n"], found["last"]) == ("code", 25_000, "+lemma l24999") and time.time() - began < 90


def test_a_hunk_that_replaces_fifty_thousand_lines(spark):
    """Sides are compared by halving: what both hold is no evidence, the rest stands in order and as often."""
    body = [f"-old {i}" for i in range(50_000)] + [f"+{'old' if i % 2 else 'new'} {i}" for i in range(50_000)] + ["+new 0"]
    began = time.time()
    found = diffs.file_verdicts(diffs.files(attempts(spark, [{"diff": one_hunk("A.thy", body)}]))).first()["evidence"]
    want = [f"-old {i}" for i in range(0, 50_000, 2)] + [f"+new {i}" for i in range(0, 50_000, 2)] + ["+new 0"]
    assert list(found) == want and time.time() - began < 60


@pytest.mark.parametrize("few", [0, 64])
def test_what_a_side_lacks(spark, monkeypatch, few):
    monkeypatch.setattr(diffs, "FEW_LINES", few)
    rng = random.Random(few)
    rows = [([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))], [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", diffs.lacking(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == [p for p in r["a"] if p not in r["b"]] for r in got)


def test_draws_agree_with_joined_draws(spark, monkeypatch):
    days = spark.createDataFrame([(f"2026-01-{d:02}", d % 5 + 1, d % 3, d % 4 + 2, d % 2) for d in range(1, 29)], "day string, n_a long, x_a long, n_b long, x_b long")
    rows = lambda df: [(r["replicate"], round(r["gap"], 9)) for r in df.orderBy("replicate").collect()]
    own = rows(lengths.bootstrap(days, 300))
    began = time.time()
    assert lengths.bootstrap(days, 10_000).count() == 10_000 and time.time() - began < 20
    monkeypatch.setattr(lengths, "DAYS_BROADCAST", 0)
    assert rows(lengths.bootstrap(days, 300)) == own and len(own) == 300
    assert lengths.bootstrap(days.limit(0), 10).collect() == []


@pytest.mark.parametrize("split", [100, 1000, 1 << 27])
def test_split_files_keep_their_order(spark, tmp_path, split):
    """Lines of one file that all have one time, read in splits of any size, are numbered as they stand."""
    records = [{"build_id": f"b{(i * 7919) % 400}", "timestamp": "2026-01-01T00:00:00", "outcome": "ok"} for i in range(400)]
    lines = [json.dumps(r) for r in records]
    lines[10:10], lines[200:200] = ["", "   "], ["\t"]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(r) for r in records[:7]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = corpus.scan(spark, str(tmp_path), large=True).select("corpus_id", "seq", "build_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = corpus.scan(spark, str(tmp_path)).select("corpus_id", "seq", "build_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 407
