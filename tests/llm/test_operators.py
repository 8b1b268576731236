"""The training-data operators against plain versions, with nulls, empties, ties, repeats and long texts."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tryloom.llm import ann, bpe_codec, chat_format, language_id, media, near_dups, packing, pii, secrets, textspans, token_counts  # noqa: E402

TEXTS = [
    None, "", " ", "a", "Hello  world\n\n it's 42 ½ ñandú", "\x1c a\x1fb", "a" * 3000, "ab" * 500 + " <|endoftext|> x", "word " * 3000, "Ünï ΣΑΣ ̈é 日本 ｶﾅ", "x", "x",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys int, ids int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 1) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_codec(docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tool = bpe_codec.Codec(path, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.ranks, special_tokens={})
    got = by_id(bpe_codec.byte_pair_codec(docs, path, public_tokenizers.PATTERN))
    for i, t in enumerate(TEXTS):
        assert got[i]["ids"] == plain.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    assert bpe_codec.byte_pair_codec(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_token_counts(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    got = by_id(token_counts.token_counts(docs, path))
    for i, t in enumerate(TEXTS):
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048)


def test_packing(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    rows = packing.packed(docs, path, length=64).collect()
    for i, t in enumerate(TEXTS):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum((r["ids"] for r in own), []) == plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in own)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    at = 0
    for sequence, offset, size in places:
        assert sequence * 64 + offset == at and offset + size <= 64
        at += size
    assert packing.packed(docs.limit(0), path).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one", "One", "two words", "two  WORDS"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = spark.createDataFrame(list(enumerate(texts)) + [(len(texts) - 1, texts[-1])], "doc_id long, text string")
    got = by_id(near_dups.near_duplicates(rows, words=2))
    sets = []
    for t in texts:
        parts = (t or "").lower().split()
        sets.append(set(zip(parts, parts[1:], strict=False)) if len(parts) > 1 else {tuple(parts)} if parts else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in got} == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    kept = near_dups.first_of_each(rows, words=2)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({label[i] for i in range(len(texts))})
    assert near_dups.near_duplicates(rows.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {(r["node"], r["component"]) for r in near_dups.components(links).collect()} == {(i, 0) for i in range(1, 60)}


def test_minor_members_meet_everything(spark):
    """The exact join finds pairs that share no bucket head."""
    sets = {1: list(range(20)), 2: list(range(1, 20)), 3: list(range(50, 70)), 4: [*range(50, 69), 99]}
    shingles = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    nodes = spark.createDataFrame([(n, n, True) for n in sets], "node long, component long, minor boolean")
    classes = spark.createDataFrame([(n, [7] * 2 * near_dups.KEYS) for n in sets], "node long, keys array<long>")
    for frequent in (0, 256):  # with each shingle split by keys, and with none
        pairs = near_dups.prefix_pairs(nodes, shingles, classes, 80, frequent)
        assert {(r["a"], r["b"]) for r in near_dups.confirmed(pairs, shingles, 80).collect()} == {(1, 2), (3, 4)}


def test_few_words_make_frequent_shingles(spark):
    """Texts over a dozen words: their rarest shingles are shared by thousands, and only the planted copies are similar."""
    rng = random.Random(5)
    texts = [[rng.randrange(12) for _ in range(rng.randint(20, 30))] for _ in range(8000)]
    texts += [[*t, 12 + i] for i, t in enumerate(texts[:400])]
    sets = [set(zip(t, t[1:], strict=False)) for t in texts]
    rows = spark.createDataFrame([(i, " ".join(f"w{x}" for x in t)) for i, t in enumerate(texts)], "doc_id long, text string")
    began = time.monotonic()
    got = by_id(near_dups.near_duplicates(rows.repartition(4), words=2))
    assert time.monotonic() - began < 90
    # brute force, by a matrix of the sets
    places = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(places)), np.float32)
    for i, x in enumerate(sets):
        held[i, [places[y] for y in x]] = 1
    size, label = held.sum(axis=1), list(range(len(sets)))
    for begin in range(0, len(sets), 1000):
        common = held[begin : begin + 1000] @ held.T
        for i, j in zip(*np.nonzero(100 * common >= 80 * (size[begin : begin + 1000, None] + size - common)), strict=True):
            a, b = sorted((int(i) + begin, int(j)))
            label[b] = min(label[b], label[a])
    assert sum(x != i for i, x in enumerate(label)) >= 400
    assert {i: got[i]["component_id"] for i in got} == dict(enumerate(label))


def test_graph_search_finds_the_lists():
    """Of clustered centroids, those within the bound are found, and few others are looked at."""
    rng = np.random.default_rng(1)
    for many in (1, 2, 9, 30, 2000):
        middle = rng.normal(size=(many // 32 + 1, 16))
        draw = lambda n: middle[rng.integers(0, len(middle), n)] + 0.6 * rng.normal(size=(n, 16))  # noqa: B023, E731
        points, asked = draw(many), draw(200)
        found = ann.Centroids(points, ann.neighbours(points, 24), 1.0)
        assert found.graph.shape[1] <= 25
        for ratio, least in ((1.0, 1), (1.15, 8), (3.0, many + 5)):
            row, at, reach = found.within(asked, ratio, least)
            whole = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(axis=2))
            bound = np.maximum(whole.min(axis=1) * ratio, np.sort(whole, axis=1)[:, min(least, many) - 1])
            true = set(zip(*(x.tolist() for x in np.nonzero(whole <= bound[:, None])), strict=True))
            got = set(zip(row.tolist(), at.tolist(), strict=True))
            assert len(got) == len(row) and np.allclose(reach, whole[row, at])
            assert len(got & true) >= (0.95 if many == 2000 and least < many else 0.999) * len(true)
    assert found.within(asked[:0], 1.1)[0].size == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8)).astype("f4")
    v[5], v[300] = v[0], v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=10).collect()
    w = v.astype("f8")
    found = total = 0
    for q in range(0, 600, 20):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(r["score"] == pytest.approx(w[q] @ w[r["vec_id"]], abs=1e-12) for r in own)
        s = w @ w[q]
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:10]
        found, total = found + len({r["vec_id"] for r in own} & set(best)), total + 10
    assert found / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, 600, 20))
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_nearest_measures_recall(spark):
    """Lists that are too few at first are raised until true neighbours are found, on clustered vectors, and most vectors are not read."""
    rng = np.random.default_rng(4)
    n = 50_000
    v = (rng.normal(size=(500, 24))[rng.integers(0, 500, n)] + 0.5 * rng.normal(size=(n, 24))).astype("f4")
    vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(v.reshape(-1), 24).cast(pa.list_(pa.float32()))}))
    vectors = vectors.repartition(8)
    queries = vectors.where("vec_id % 250 = 0")
    got = ann.nearest(vectors, queries, k=10, copies=2, boundary=1.02, prune=1.0).collect()
    scores = v[::250].astype("f8") @ v.astype("f8").T
    scores[np.arange(n // 250), np.arange(0, n, 250)] = -np.inf
    best = np.argpartition(-scores, 9, axis=1)[:, :10]
    assert len(got) == n // 25 and sum(r["vec_id"] in best[r["query_id"] // 250] for r in got) / len(got) >= 0.9
    # the share of all vectors that a query is compared with
    made = ann.index(vectors, queries, 10, 2, 1.02, 1.0)
    sizes = made.posted.groupBy("list").agg(F.count("*").alias("n"))
    read = made.routes().join(sizes, "list").groupBy("rep").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0]
    assert len(made.centroids.points) == n // ann.LIST_SIZE and read / n < 0.2


def test_language_id(spark):
    sample = {"en": "the house and the garden with water", "fr": "la maison et le jardin avec de l'eau", "ru": "дом и сад с водой"}
    rows = [(i, (t + " ") * 5, k) for i, (k, t) in enumerate(sample.items())]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(0, None), (1, "12 34"), (2, "the water"), (3, "jardin maison"), (4, "сад"), (5, "the house with water and the garden " + "дом и сад с водой дом и сад")]
    got = by_id(language_id.language_id(spark.createDataFrame(tests, "doc_id long, text string"), model, ["doc_id"], penalty=3.0))
    assert [got[i]["lang_pred"] for i in range(5)] == ["und", "und", "en", "fr", "ru"]
    assert got[0]["score"] == 0 and [s["lang"] for s in got[5]["lang_spans"]] == ["en", "ru"]
    empty = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.language_id(spark.createDataFrame(tests, "doc_id long, text string"), empty, ["doc_id"]).collect()} == {"und"}


def test_language_sample_counts_distinct_texts(spark):
    """Copies of one text take nothing from a language's sample."""
    rows = [("en", f"house garden water number{chr(97 + i % 26) * (1 + i // 26)}") for i in range(60)] + [("fr", f"maison jardin mot{chr(97 + i % 26) * (1 + i // 26)}") for i in range(60)]
    plain = language_id.fit(spark.createDataFrame(rows, "lang string, text string"), sample_texts=100)
    copies = language_id.fit(spark.createDataFrame(rows + rows[60:61] * 3000, "lang string, text string"), sample_texts=100)
    assert np.array_equal(plain.scores, copies.scores)


def spans(text, kinds):
    out = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m)]
    return [s for _, _, s in sorted(out)]


SECRET_TEXTS = [None, "", "no secret", 'ñ password = "abc"; token: abcdef', "api_key=token:abcdefgh SECRET=xyz123", "AKIA" + "A" * 16 + " AKIA12", "f" * 24 + "g" + "0" * 30, "x" * 50_000 + " passwd:hunter2!", "password=secret=abcdef token=ab"]


def test_secrets(spark):
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(SECRET_TEXTS)] + [(50, SECRET_TEXTS[3], 1)], "doc_id long, text string, rules int")
    kinds = [("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    got = by_id(secrets.secret_spans(rows).select("doc_id", secrets.joined(secrets.all_spans(last=3)).alias("s")))
    for i, t in [*enumerate(SECRET_TEXTS), (50, SECRET_TEXTS[3])]:
        assert got[i]["s"] == ",".join(spans(t or "", kinds)), t
    clean = by_id(secrets.secret_spans(rows).withColumn("text", textspans.replaced(F.col("text"), secrets.all_spans())).select("doc_id", "text"))
    assert clean[3]["text"] == 'ñ password = "abc"; [assign]' and clean[2]["text"] == "no secret"


def test_trigram_queries():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is None
    assert len(secrets.trigram_query(secrets.ASSIGN)) == 6


PII_TEXTS = [None, "", "a@b.co x@y a..b@c-d.org", "1.2.3.4.5 300.1.1.1 01.002.3.4", "4111 1111 1111 1111 4111111111111112 5", "+1 (017) 555-7713 +12 34", "a@b.c_d@e.f xx@yy@zz.com", "7" * 30_000, "1 " * 20_000, "9" * 3 + "a" * 30_000]


def test_pii(spark):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
    ]
    rows = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    found = pii.personal_data(rows)
    base = F.concat(*[pii.placed(F.col("pii")[k], i, k) for i, k in enumerate(pii.KINDS)])
    got = by_id(found.select("doc_id", pii.joined(base).alias("s")))
    for i, t in enumerate(PII_TEXTS):
        assert got[i]["s"] == ",".join(spans(t or "", kinds)), (t or "")[:60]


def test_pii_context(spark):
    known = [f"user contact: name{i}@mail.org" for i in range(12)]
    rows = spark.createDataFrame(list(enumerate([*known, "user contact: name77@mail", "see item12 there"])), "doc_id long, text string")
    # "name77@mail" is no address, but stands where addresses do; its outline is another, so patterns share the word only.
    edges = spark.createDataFrame([("contact: a", f"n{i}", True) for i in range(20)] + [("contact: a", "new", False), ("see a", "item12", False)], "pattern string, instance string, seed boolean")
    assert [r["pattern"] for r in pii.scored(edges).collect()] == ["contact: a"]
    assert by_id(pii.personal_data(rows))[13]["context"] == []


def test_pii_context_reaches_other_shapes(spark):
    """Unseen identifiers in known contexts are found whole: cut addresses, phones without a plus, account and spaced card numbers."""
    known = [f"user contact: name{i}@mail.org" for i in range(24)]
    known += [f"call +1 (017) 555-{1000 + i} today" for i in range(12)] + [f"see item{i} there" for i in range(5)]
    hidden = {"user contact: name77@mail": "name77@mail", "user contact: 99812734": "99812734", "call (017) 555 7713 today": "(017) 555 7713", "call 4111 1111 1111 1112 today": "4111 1111 1111 1112"}
    rows = spark.createDataFrame(list(enumerate([*known, *hidden])), "doc_id long, text string")
    got = by_id(pii.personal_data(rows))
    for i, (text, inner) in enumerate(hidden.items(), len(known)):
        assert [tuple(s) for s in got[i]["context"]] == [(text.index(inner), text.index(inner) + len(inner))], text
    assert all(not got[i]["context"] for i, text in enumerate(known) if text.startswith(("see", "user", "call")))


def test_chat(spark):
    log = [
        (1, "m1", 0, "user", 0, "start", ""), (1, "m1", 0, "user", 1, "delta", "Hi <|end|>\n~0 [INST]"), (1, "m2", 1, "assistant", 0, "start", None), (1, "m2", 1, "assistant", 1, "delta", "wrong"),
        (1, "m2", 1, "assistant", 2, "regenerate", "x"), (1, "m2", 1, "assistant", 3, "delta", "ri"), (1, "m2", 1, "assistant", 4, "delta", "ght </s>"), (1, "m3", 2, None, 0, "delta", "a"), (1, "m3", 2, None, 1, "edit", "b\n"),
        (None, "m", None, "assistant\n", 0, "delta", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, message string, turn long, role string, seq int, event string, text string").repartition(4)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.rendered(chat_format.folded(events))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "Hi <|end|>\n~0 [INST]"), ("assistant", "right </s>"), ("", "b\n")]
    assert got[1]["loss"] == ["right </s>"] and got[1]["formatted"].count("<|end|>\n") == 3
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("assistant\n", "")] and got[None]["loss"] == []


def test_media(spark, docs):
    page = "<p>One &amp; two</p><figure><img src='sha256:00' alt=x><figcaption>Cap <b>tion</b></figcaption></figure><script>no</script>three<img src=u>"
    out = media.sequence(page)
    assert [(e["kind"], e["text"], e["ref"], e["caption"]) for e in out] == [("text", "One & two", None, None), ("image", None, "sha256:00", "Cap tion"), ("text", "three", None, None), ("image", None, "u", None)]
    assert media.sequence(None) == []
    table = {bytes(r["digest"]): r for r in media.media(docs).collect()}
    assert len(table) == len({t or "" for t in TEXTS})
    for t in TEXTS:
        data = (t or "").encode()
        row = table[hashlib.sha256(data).digest()]
        assert media.samples(bytes(row["media"])).tobytes() == data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
    rows = spark.createDataFrame([(7, f"<p>a</p><img src='sha256:{hashlib.sha256(b'x').hexdigest()}' alt=c><img src='sha256:{'0' * 64}'>")], "page_id long, html string")
    joined = media.aligned(media.resolved(media.elements(media.sequences(rows, ["page_id"]), "page_id"), media.media(docs, with_media=False), "page_id"), "page_id").first()["elements"]
    assert [(e["position"], e["kind"], e["caption"], e["n_bytes"]) for e in joined] == [(0, "text", None, None), (1, "image", "c", 1), (2, "image", None, None)]
