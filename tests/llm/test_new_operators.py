"""Periodic runs, the prefix trie and WARC archives against plain versions, on random and on hard rows."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tryloom import llm
from tryloom.llm import prefix_trie, runs, warc

WHITE = b" \t\n\x0b\x0c\r"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- runs


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Start, end and period of every run, by trying every period at every place."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.add((start, i + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    best = None
    for s, e, q in found:
        if best is None or (e - s) * best[2] > best[1] * q:
            best = (s, e - s, q)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    values = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *values, sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            few, words = rng.choice([1, 2, 2, 3, 5]), []
            for _ in range(rng.randint(0, 8)):
                words += ([rng.randrange(few) for _ in range(rng.randint(1, 9))] * rng.randint(1, 9))[: rng.randint(1, 60)]
            docs.append(words)
        start, end, period = runs.runs_of(np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        want, offset = set(), 0
        for d in docs:
            want |= {(s + offset, e + offset, q) for s, e, q in plain_runs(d)}
            offset += len(d)
        assert sorted(zip(start.tolist(), end.tolist(), period.tolist())) == sorted(want)


def test_a_long_text_of_one_word_is_one_run():
    start, end, period = runs.runs_of(np.zeros(300_000, np.int64), np.zeros(300_000, np.int64))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [300_000], [1])


def test_rules_are_compressed_once():
    """A stretch that repeats makes far fewer rules than it has words."""
    w = np.tile(np.arange(50), 200)
    assert runs.Grammar(w, np.zeros(len(w), np.int64)).rules < 200


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("new"))
    rng = random.Random(9)
    texts = [None, "", " \t\n ", "a", "a a a a a", "a a a a a a", "x y " * 3 + "x y", "\x1c\x85 é " * 5, "no run in here", "日本 " * 40, "a b c d " * 700 + "e", "p\x0bq\x0cr\rs\n" * 9]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 80))) for _ in range(150)] + ["one two three four " * 2] * 3
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "a a a a a"), (None, "z " * 9), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.select("*", *[F.lit(1).alias(c) for c in ("runs", "collapsed", "best", "start", "words")]).repartition(3).write.parquet(f"{path}/documents.parquet")
    turns = []
    for c in range(90):
        for t in range(rng.randint(1, 6)):
            turns.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi there", "yes", "no  no", ""]) if t < 3 else rng.choice(["x", "y z"])))
    turns += [(200 + c, t, "user", "same again") for c in range(40) for t in range(3)]
    turns += [(5, 2, None, None), (5, None, "user", "first"), (7, 1, "user", "tie b"), (7, 1, "user", "tie a"), (7, 1, "user", "tie a"), (None, 0, "user", "no id"), (301, 0, "user", "gone"), (10_000, 0, "user", "far"), (-41, 0, "user", "below"), (-40, 0, "system", "root")]
    schema = "conv_id long, turn int, role string, text string"
    spark.createDataFrame(turns, schema).select("*", *[F.lit(1).alias(c) for c in ("keys", "words", "key", "class", "depth", "root", "h")]).repartition(3).write.parquet(f"{path}/conversations.parquet")
    pages = [(i, f"https://h{i % 3}.org/a b?q=%20&r=é\n{i}", t) for i, t in enumerate([None, "", "<p>one", "<p>two", "<p>one", "é" * 70_000, "x" * 400_000, "<p>one", "日本"])]
    pages += [(2, None, "<p>one"), (2, "u", "other"), (None, "v", "<p>two"), (None, "v", "lonely"), (None, "w", "lonely")]
    spark.createDataFrame(pages, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("digest", "payload", "first_id", "known", "n")]).repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


def same(got, want) -> None:
    key = lambda row: [(x is not None, x) for x in row]
    assert sorted((tuple(r) for r in got), key=key) == sorted((tuple(r) for r in want), key=key)


def with_duckdb(folder: str, table: str, name: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return con.sql(f"SELECT {', '.join(columns)} FROM ({llm.oracle_sql()[name]})").fetchall()


def test_op11(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = llm.queries()["op11_runs"](spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    same(got.collect(), [plain_row(*r) for r in rows])
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in rows if i is not None)


def test_op11_on_the_smallest_table(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").collect()
    some = [r for r in rows if len((r["text"] or "").split()) < 1500]
    got = {r["doc_id"]: r for r in llm.queries()["op11_runs"](spark, path).collect()}
    same([got[r["doc_id"]] for r in some], [plain_row(r["doc_id"], r["text"]) for r in some])
    assert len(got) == len(rows) and any(r["n_runs"] for r in got.values())


# --- trie


def plain_trie(sequences: dict[int, list[tuple]]) -> list[tuple]:
    """Nodes of the trie of conversations, each a list of (turn, words)."""
    members, stops = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        path = tuple(t for t, _ in turns)
        for d in range(len(path) + 1):
            members[path[:d]].append((c, turns[d - 1][1] if d else 0))
        stops[path].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(held) - 1) * held[0][1]
    least = {path: min(c for c, _ in held) for path, held in members.items()}
    ends = lambda path: sha(",".join(map(str, sorted(stops[path]))).encode())
    return [(least[p], len(p), least[p[:-1]] if p else None, len(held), kids[p], leaves[p], saved[p], ends(p)) for p, held in members.items()]


@pytest.mark.parametrize("turns", [1, 5, 40, 1 << 16])
def test_trie_of_random_sequences(spark, turns):
    """Blocks of any size, so with boundaries anywhere, give the trie."""
    rng = random.Random(turns)
    sequences = {}
    for c in range(150):
        sequences[c * 7 - 60] = [(rng.choice("ab"), 0) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))]
    sequences |= {5000 + i: [("a", 0)] * (i % 9) for i in range(60)}
    sequences = {c: [(t, 1 + (t == "b")) for t, _ in s] for c, s in sequences.items()}
    rows = [(c, [hashlib.md5(t.encode()).digest() for t, _ in s], [w for _, w in s]) for c, s in sequences.items()]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, keys array<binary>, words array<int>"), turns)
    same(found.collect(), plain_trie(sequences))


def test_op12(spark, folder):
    got = llm.queries()["op12_prefix_trie"](spark, folder)
    want = with_duckdb(folder, "conversations", "op12_prefix_trie", got.columns)
    same(got.collect(), want)
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").where("conv_id IS NOT NULL").collect():
        rows[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    sequences = {}
    for c in rows:
        h, root = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        turns = sorted(rows.get(root, []))[:h] + sorted(rows[c])[h:]
        sequences[c] = [((r, t), len(t.encode().split())) for _, _, r, t in turns]
    assert any(not s for s in sequences.values())
    same(got.collect(), plain_trie(sequences))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    lists = prefix_trie.turn_lists(none)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(lists)).collect() == []


# --- WARC


def test_op13(spark, folder):
    got = llm.queries()["op13_warc"](spark, folder)
    same(got.collect(), with_duckdb(folder, "pages", "op13_warc", got.columns))
    groups = defaultdict(list)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    for i, payload in rows:
        groups[payload].append(i)
    first = {p: min((i for i in ids if i is not None), default=None) for p, ids in groups.items()}
    want = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first[p] else "revisit", None if i == first[p] else first[p]) for i, p in rows]
    same(got.collect(), want)


def test_archives_are_plain_gzip_and_give_back_pages(spark, folder, tmp_path):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    manifest = warc.archived(pages, str(tmp_path / "a"), least=6, roll=1000)
    files = manifest.collect()
    assert len(files) > 3 and sum(f["n_records"] for f in files) == pages.count()
    rows = warc.records(manifest).collect()
    short = [r for r in rows if r["payload_bytes"] < 6]
    assert {r["record_type"] for r in short} == {"response"} and any(r["record_type"] == "revisit" for r in rows)
    got = sorted((str(r["page_id"]), str(r["target_uri"]), r["payload"]) for r in rows if r["record_type"] == "response")
    kept = {(str(r["page_id"]), r["payload_digest"]) for r in rows if r["record_type"] == "response"}
    whole = [(str(r["page_id"]), str(r["url"]), (r["html"] or "").encode()) for r in pages.collect()]
    assert got == sorted(w for w in whole if (w[0], warc.base32_sha1(w[2])) in kept)
    for f in files:
        with gzip.open(f["archive"]) as plain:
            assert plain.read().count(b"WARC/1.1\r\nWARC-Type: ") == f["n_records"]
    by_offset = max(rows, key=lambda r: r["record_offset"])
    with open(by_offset["archive"], "rb") as raw:
        raw.seek(by_offset["record_offset"])
        assert by_offset["record_id"].encode() in zlib.decompressobj(31).decompress(raw.read())


def archive_of(*members: bytes) -> pa.NativeFile:
    return pa.BufferReader(b"".join(members))


def test_damage_is_an_error_with_its_place():
    good = [warc.member(warc.record("response", str(i), "u", b"x" * n, None)) for i, n in enumerate((0, 10, 600_000))]
    assert [r["payload_bytes"] for r in warc.read_archive(archive_of(*good), "a")] == [0, 10, 600_000]
    assert list(warc.read_archive(archive_of(), "a")) == []
    text = warc.record("response", "1", "u", b"payload", None)
    bad = {
        "breaks off": good[2][:-9], "no gzip": b"plain text", "shorter": warc.member(text[:-8]), "longer": warc.member(text + b"more"), "block's digest": warc.member(text.replace(b"payload", b"paylode")),
        "no record": warc.member(b"HTTP/1.1 200\r\n\r\n"), "does not end": warc.member(b"WARC/1.1\r\nA: b"), "incorrect data check": good[1][:-5] + b"\0" + good[1][-4:],
    }
    for said, member in bad.items():
        with pytest.raises(warc.Broken, match=f"a at {len(good[0])}: .*{said}"):
            list(warc.read_archive(archive_of(good[0], member), "a"))


def test_one_byte_at_a_time():
    class Slow:
        def __init__(self, data):
            self.source = pa.BufferReader(data)

        def read(self, _):
            return self.source.read(1)

    data = b"".join(warc.member(warc.record("response", str(i), "u", b"ab" * i, None)) for i in range(4))
    assert [r["payload"] for r in warc.read_archive(Slow(data), "a")] == [b"ab" * i for i in range(4)]


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(warc.archived(none, str(tmp_path / "none"))).collect() == []
    assert isinstance(warc.opened("file:/tmp/x")[0], pafs.LocalFileSystem) and warc.opened("file:///tmp/x")[1] == "/tmp/x"
