"""Operator 3: near-duplicates by MinHash with tensored banding.

A document's set holds the hashes of its distinct word shingles. Documents of
equal sets form a class at once. For each class two small collections of keys
are made from few minhashes each, and every pair of one key from either
collection keys a table: 2 x 11 keys of two minhashes give 121 tables of four,
from 44 minhashes instead of 484. A pair at similarity 0.8 shares no table with
a probability of 0.00003, more similar ones nearly never.

In a table, a bucket of many classes is not expanded into its pairs. First each
class is compared with the bucket's smallest class; confirmed links give
components. Members of a bucket that are then still outside of its largest
component are joined exactly, by prefixes of their shingles in order of rarity,
so no link between components is lost and what differs costs no comparison.
Every link is confirmed on the full sets. Components come from a contraction of
the link graph that stays in tables.

Shingles are compared by 64-bit hashes of words; equal hashes of unlike
shingles are the only inexactness of a confirmed link.

Cases: a document with null text or without words has an empty set and is
linked with nothing; with fewer words than a shingle takes, all its words are
its one shingle; texts are taken whole; rows without an id are left out, and
repeated rows (of one id) count once, by the smallest of their sets' digests;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tryloom.llm.chunks import bounded, column
from tryloom.llm.shared import cut, fresh, id_side, small_batches, table, written

#: Keys in each of the two collections, and minhashes in a key.
KEYS, ROWS = 11, 2
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _RANDOM.integers(1, 1 << 63, 2 * KEYS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, 2 * KEYS * ROWS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of so many words."""
    # bytes.lower() and bytes.split() know ASCII letters and white space only.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = len(parts) - words + 1
    out = hashes[:size].copy()
    for k in range(1, words):
        out = _mixed(out) + hashes[k : k + size]
    return np.unique(_mixed(out))


def minhash_keys(shingles: np.ndarray) -> np.ndarray:
    """The KEYS keys of the first collection, then those of the second."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for begin in range(0, len(shingles), 4096):
        part = shingles[begin : begin + 4096]
        mixed = (part[None, :] ^ _MASKS[:, None]) * _FACTORS[:, None]
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1), out=least)
    keys = _mixed(least).reshape(2 * KEYS, ROWS)
    out = keys[:, 0].copy()
    for k in range(1, ROWS):
        out = _mixed(out) + keys[:, k]
    return _mixed(out + np.arange(2 * KEYS, dtype=np.uint64))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set and its ``keys``; these two are null for an empty set."""
    names = ["doc_id", "n_shingles", "digest", "keys"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            sizes, digests, keys = [], [], []
            for text in column(batch, "text"):
                found = shingle_set(text.as_py(), words)
                sizes.append(len(found))
                digests.append(hashlib.sha256(found.tobytes()).digest()[:16] if len(found) else None)
                keys.append(minhash_keys(found).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=names)

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, keys array<long>")


def sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``node`` and ``shingles`` of the documents in ``ids`` (distinct ``node``)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [shingle_set(t.as_py(), words).view(np.int64) for t in column(batch, "text")]
            digests = [hashlib.sha256(s.tobytes()).digest()[:16] for s in found]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["node", "digest", "shingles"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(id_side(ids), "node", "left_semi")
    return chosen.mapInArrow(make, "node long, digest binary, shingles array<long>")


def table_keys(classes: DataFrame) -> DataFrame:
    """``node`` and ``key`` of every table: a hash of one key of either collection."""
    pairs = [F.xxhash64(F.lit(KEYS * i + j), F.col("keys")[i], F.col("keys")[KEYS + j]) for i in range(KEYS) for j in range(KEYS)]
    return classes.select("node", F.explode(F.array(*pairs)).alias("key"))


def confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets have at least ``percent`` of similarity."""
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    # sizes alone rule out many pairs
    fits = 100 * F.least(F.size("x"), F.size("y")) >= percent * F.greatest(F.size("x"), F.size("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
                x, y = (np.asarray(v.values) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.where(fits).select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


#: Minor sets that a shingle may be among the first of; one that is more frequent is split by the sets' keys.
FREQUENT = 256


def prefix_pairs(nodes: DataFrame, shingles: DataFrame, classes: DataFrame, percent: int, frequent: int = FREQUENT) -> DataFrame:
    """Pairs ``a``, ``b`` of ``nodes`` (``node``, ``component``, ``minor``) that may be similar enough; none that is and shares a table (by the ``keys`` of ``classes``) gets lost.

    Sets of ``na`` and ``nb`` shingles need a certain overlap. With all
    shingles in one order, the rarest first, both sets then share one among
    their first, as many as each may miss and one more. So what a set has to
    itself excludes it without a comparison. One of a pair is minor, and
    components differ.

    A shingle that is among the first of more than ``frequent`` minor sets (as
    where all texts have a dozen words) is split by the keys of the first
    collection, which sets of one table share, and its pairs also share a key of
    the second. Another shingle's pairs are not asked for a key; they are at
    most ``frequent`` for each of its sets.
    """
    rows = nodes.join(shingles, "node").select("node", "component", "minor", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = rows.groupBy("s").agg(F.count("*").alias("df"))
    ranked = rows.join(counts, "s").groupBy("node", "component", "minor", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("order"))
    # the most that a set can miss: with a partner that is a subset of it
    first = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    heads = cut(ranked.select("node", "component", "minor", "n", F.posexplode(first).alias("at", "x")).where("x.df > 1").select("node", "component", "minor", "n", "at", "x.s"))
    often = heads.where("minor").groupBy("s").agg(F.count("*").alias("minors")).where(F.col("minors") > frequent).select("s")
    many = id_side(cut(often))
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    fits = (F.col("ca") != F.col("cb")) & (~F.col("mb") | (F.col("a") < F.col("b"))) & (F.col("pa") <= F.col("na") - need) & (F.col("pb") <= F.col("nb") - need)

    def met(rows: DataFrame, by: list[str], more: Column, *own: str) -> DataFrame:
        side = lambda x: rows.select(*by, F.col("node").alias(x), *[F.col(c).alias(c[0] + x) for c in ("component", "minor", "n", *own)], F.col("at").alias(f"p{x}"))
        return side("a").where("ma").join(side("b"), by).where(fits & more).select("a", "b")

    # A set's keys come in one row; 11 of the first collection stand for the 121 tables.
    keyed = heads.join(many, "s", "left_semi").join(classes.select("node", "keys"), "node")
    split = keyed.select("s", "node", "component", "minor", "n", "at", F.slice("keys", KEYS + 1, KEYS).alias("second"), F.explode(F.slice("keys", 1, KEYS)).alias("key"))
    pairs = met(heads.join(many, "s", "left_anti"), ["s"], F.lit(True)).unionByName(met(split, ["s", "key"], F.arrays_overlap("sa", "sb"), "second"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of the nodes of ``links`` (``a``, ``b``).

    Every round, each node's larger neighbours are linked with its smallest
    one, then its smaller ones are; both shrink the graph's paths, and the
    edges end as stars. Rounds grow with the logarithm of the longest path.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # Large star: neighbours above the node move to the node's minimum.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        # Small star: neighbours below the node, and the node, move to the minimum.
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        edges = cut(small)
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (found["n"], found["h"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = (found["n"], found["h"])


def labelled(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    return nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and ``n_rows`` of every document."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, percent)


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    signed = written(signatures(docs, words), "signatures")
    rows = signed.groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles", "keys")).alias("s"), F.count("*").alias("n_rows")).select("doc_id", "n_rows", "s.*")
    node = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "keys")).alias("s")).select("digest", F.col("s.doc_id").alias("node"), F.col("s.keys").alias("keys"))
    classes = written(node, "classes")

    # A class makes many keys, so classes are dealt to as many tasks as the documents take, not to the few that their own size asks for.
    tasks = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = table_keys(classes.repartition(tasks, "node"))
    # Most keys are one class's alone; only the others travel with more than the key.
    common = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = written(keyed.join(common, "key", "left_semi"), "members")
    heads = members.groupBy("key").agg(F.min("node").alias("head"))
    shared = written(members.join(heads, "key"), "buckets")
    involved = written(shared.select("node").distinct(), "involved")
    # A repeated id may have several texts; only the one whose set stands for it counts.
    shingles = written(sets(docs, involved, words).dropDuplicates(["node", "digest"]).join(classes.select("node", "digest"), ["node", "digest"], "left_semi").select("node", "shingles"), "sets")

    stars = shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    first = cut(confirmed(stars, shingles, percent))
    parts = components(first)

    # Buckets that still hold several components: their members are joined
    # exactly, each that is outside of its bucket's largest component with all
    # that could still be linked with it.
    open_rows = labelled(shared.select("key", "node"), parts)
    sizes = open_rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    several = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("most")).where("parts > 1").select("key", F.col("most.component").alias("main"))
    mixed = open_rows.join(several, "key").groupBy("node").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("minor"))
    across = cut(prefix_pairs(cut(mixed), shingles, classes, percent))
    more = confirmed(across, shingles, percent)
    star = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = components(star.unionByName(more))

    by_digest = labelled(classes.select("digest", "node"), parts).select("digest", "component")
    linked = rows.select("doc_id", "n_rows", "n_shingles", "digest").join(by_digest, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), "n_rows")


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row for each component; rows without an id stay."""
    found = written(near_duplicates(docs, words, percent).select("doc_id", "kept", "n_rows"), "kept")
    ids = found.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "kept", "n_rows")
    rest = docs.join(id_side(ids.where("NOT kept").select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    repeated = ids.where("kept AND n_rows > 1").select("doc_id")
    if repeated.limit(1).count() == 0:
        return rest
    # Ids of several rows: one row each, by a fixed order.
    n = fresh(docs, "n")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    firsts = docs.join(id_side(repeated), "doc_id", "left_semi").select(*docs.columns).withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).drop(n)
    return rest.join(id_side(repeated), "doc_id", "left_anti").select(*docs.columns).unionByName(firsts)


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all ``documents``, on shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2).drop("n_rows")
