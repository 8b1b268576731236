"""Operator 12: the prefix trie of conversations by union-find over sorted neighbours.

Conversations are sequences of turns, each named by a digest. Equal sequences are
one class first. Classes are sorted by range, cut into blocks of bounded size,
and each block builds its forest by itself: the edges between sorted neighbours,
weighted by their longest common prefix, are taken in descending depth; the merge
of two components creates a branching node at that depth or adds to the one that
is there. What lies between two branching nodes is a chain of nodes with the same
members.

A node that a block's first or last sequence shares with the sequence before or
behind the block is open: other blocks hold parts of it. Each forest is
contracted to its open nodes, which lie on its outer paths, and these are merged
across the boundaries by the digest of their prefix. All figures of a node are
sums or minima over its parts, where a node counts as begun in the first block
that holds it. All other nodes are final where they are made.

Ids that end in one node are joined into its digest by blocks of ids, which are
streamed in order, so a class of any number of conversations is never held whole.

Cases: a null role or text is empty; turns are ordered with null first, equal
ones by role, the first characters of the text and the digest; repeated rows are
turns of their own; rows without a conversation id are left out; a conversation
that is rebuilt without a turn ends in the root; an empty table has no node, not
even the root; texts are hashed and counted whole; other columns are ignored. A
conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tryloom.llm.shared import id_side, table, written

WORD = r"[^\x20\x09-\x0D]++"
#: Bytes of a turn's digest, characters of a text that order turns of equal number, and ids in a block of a class.
KEY, ORDER_CHARS, IDS_SHIFT = 16, 32, 12
#: A block is closed when it holds so many turns.
BLOCK_TURNS = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_BLOCK = "part int, at int, prev int, next int, first binary, last binary, lengths array<int>, keys binary, words array<int>, n array<long>, conv array<long>, ends array<string>"
_NODE = "conv_id long, depth long, parent_conv_id long, key binary, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``keys`` (a digest a turn, in order) and ``words`` (a count a turn)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role), role, text), 256), 1, 2 * KEY))
    one = F.struct("turn", role.alias("role"), F.substring(text, 1, ORDER_CHARS).alias("head"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: x["key"]).alias("keys"), F.transform("t", lambda x: x["words"]).alias("words"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """``lists`` (as ``turn_lists`` gives them, read twice) with their first turns taken from the conversation that begins their twenty.

    How many, 0 to 3, follows from the id.
    """
    heads = lists.where("conv_id % 20 = 0").select(F.col("conv_id").alias("root"), F.slice("keys", 1, 3).alias("k"), F.slice("words", 1, 3).alias("w"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    rows = lists.withColumns({"root": F.expr("conv_id - conv_id % 20"), "h": h}).join(heads, "root", "left")
    both = lambda head, own: F.concat(F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.slice(own, F.lit(1), F.lit(0))), F.slice(own, F.col("h") + 1, F.size(own)))
    return rows.select("conv_id", both("k", "keys").alias("keys"), both("w", "words").alias("words"))


def classes(sequences: DataFrame) -> DataFrame:
    """One row for each distinct sequence: ``keys``, ``words``, members ``n``, the smallest as ``conv`` and the digest of all as ``ends``. ``sequences`` is read twice."""
    named = sequences.withColumn("class", F.unhex(F.sha2(F.array_join(F.transform("keys", F.hex), ""), 256)))
    block = F.shiftright("conv_id", IDS_SHIFT)
    ids = named.groupBy("class", block.alias("block")).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, n, conv = None, None, 0, 0
        out: list[list] = [[], [], [], []]

        def close() -> None:
            if held is not None:
                for values, value in zip(out, (held, n, conv, digest.hexdigest()), strict=True):
                    values.append(value)

        for batch in batches:
            for name, _, more, least, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != held:
                    close()
                    held, digest, n, conv = name, hashlib.sha256(), 0, least
                else:
                    digest.update(b",")
                digest.update(text.encode())
                n += more
            if len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["class", "n", "conv", "ends"])
                out = [[], [], [], []]
        close()
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["class", "n", "conv", "ends"])

    ends = ids.repartition("class").sortWithinPartitions("class", "block").mapInArrow(stream, "class binary, n long, conv long, ends string")
    texts = named.groupBy("class").agg(F.first("keys").alias("keys"), F.first("words").alias("words"))
    return texts.join(ends, "class").drop("class")


def common(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from their beginning."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // KEY
    low, high = 0, most // KEY  # the first `low` turns are shared, the first `high` are not
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low * KEY : middle * KEY] == b[low * KEY : middle * KEY] else (low, middle)
    return low


@dataclass
class _Open:
    """Sorted sequences on their way into a block."""

    prev: int
    rows: list[tuple] = field(default_factory=list)
    turns: int = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.turns += len(row[1]) + 1


def blocks(found: DataFrame, turns: int = BLOCK_TURNS) -> DataFrame:
    """Sorted classes in blocks of about ``turns`` turns, with what a block's ends share with their neighbours in the same task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held = TaskContext.get().partitionId(), 0, _Open(-1)

        def close(next_: int) -> pa.RecordBatch:
            flat = [r[0] for r in held.rows]
            row = {"part": part, "at": at, "prev": held.prev, "next": next_, "first": flat[0] if held.prev < 0 else None, "last": flat[-1] if next_ < 0 else None}
            row |= {"lengths": [len(r[1]) for r in held.rows], "keys": b"".join(flat), "words": [w for r in held.rows for w in r[1]]} | {k: [r[i] for r in held.rows] for i, k in ((2, "n"), (3, "conv"), (4, "ends"))}
            return pa.RecordBatch.from_pylist([row], _schema(_BLOCK))

        for batch in batches:
            for keys, words, n, conv, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (b"".join(keys), words, n, conv, ends)
                if held.turns >= turns:
                    shared = common(held.rows[-1][0], row[0])
                    yield close(shared)
                    at, held = at + 1, _Open(shared)
                held.add(row)
        if held.rows:
            yield close(-1)

    ordered = found.select("keys", "words", "n", "conv", "ends").repartitionByRange("keys").sortWithinPartitions("keys")
    return ordered.mapInArrow(cut, _BLOCK)


def boundaries(cut: DataFrame) -> DataFrame:
    """``part``, ``lcp_prev`` and ``lcp_next``: what the ends of each task's blocks share with the tasks beside it. One row a task goes through the window."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            both = lambda a, b: -1 if a is None or b is None else common(a, b)
            out = [[r[0] for r in rows], [both(r[3], r[1]) for r in rows], [both(r[2], r[4]) for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in out], names=["part", "lcp_prev", "lcp_next"])

    ends = cut.where("first IS NOT NULL OR last IS NOT NULL").groupBy("part").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    order = Window.orderBy("part")
    beside = ends.withColumns({"before": F.lag("last").over(order), "behind": F.lead("first").over(order)})
    return beside.select("part", "first", "last", "before", "behind").mapInArrow(share, "part int, lcp_prev int, lcp_next int")


class Forest:
    """The trie of one block's sorted, distinct sequences, by union-find over the edges between neighbours."""

    def __init__(self, keys: list[bytes], words: list[list[int]], n: list[int], conv: list[int], ends: list[str], prev: int, next_: int):
        self.keys, self.words, self.prev, self.next = keys, words, prev, next_
        last = len(keys) - 1
        self.low, self.high = list(range(len(keys))), list(range(len(keys)))
        self.depth = [len(w) for w in words]
        self.n, self.conv, self.ends = list(n), list(conv), list(ends)
        self.kids, self.inner = [0] * len(keys), [False] * len(keys)
        # the last sequence is no leaf if the next block's first goes on from it
        self.leaves = [int(not (i == last and next_ == len(w))) for i, w in enumerate(words)]
        self.below = [0] * len(keys)  # tokens saved in the subtrees of the children
        self.out: list[tuple] = []
        self.waiting: list[tuple] = []
        self._prefixes: dict[bool, list[bytes]] = {}
        self._build()

    def _build(self) -> None:
        edges = [common(a, b) for a, b in zip(self.keys, self.keys[1:])]
        up, top = list(range(len(self.keys))), list(range(len(self.keys)))

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        # From the deepest on, those of equal depth from left to right: so only the left component's node can have the edge's depth.
        for i in sorted(range(len(edges)), key=lambda i: -edges[i]):
            a, b = find(i), find(i + 1)
            node = top[a]
            if self.depth[node] != edges[i]:
                node = self._node(edges[i], node)
            self._attach(node, top[b])
            up[b], top[a] = a, node
        root = top[find(0)]
        if self.depth[root]:
            root = self._node(0, root)
        for row, node in self.waiting:
            key = self._key(node, self.depth[node])
            self.out.append((*row, self.conv[node] if key is None else None, key))
        self.out.append((*self._row(root, 0, self.kids[root], self.below[root], self._key(root, 0)), None, None))

    def _node(self, depth: int, child: int) -> int:
        for values, value in ((self.low, self.low[child]), (self.high, self.high[child]), (self.depth, depth), (self.n, 0), (self.conv, self.conv[child]), (self.ends, None), (self.kids, 0), (self.inner, False), (self.leaves, 0), (self.below, 0)):
            values.append(value)
        node = len(self.depth) - 1
        self._attach(node, child)
        return node

    def begins(self, node: int, depth: int) -> bool:
        """Whether no earlier block holds a part of the node."""
        return not (self.low[node] == 0 and depth <= self.prev)

    def _prefix(self, last: bool, depth: int) -> bytes:
        """The digest of the first turns of the block's first or last sequence."""
        if last not in self._prefixes:
            keys, most = (self.keys[-1], self.next) if last else (self.keys[0], self.prev)
            digest, found = hashlib.blake2b(digest_size=16), []
            for d in range(most + 1):
                found.append(digest.copy().digest())
                digest.update(keys[d * KEY : (d + 1) * KEY])
            self._prefixes[last] = found
        return self._prefixes[last][depth]

    def _key(self, node: int, depth: int) -> bytes | None:
        """Names an open node; null for one that is all in this block."""
        if not self.begins(node, depth):
            return self._prefix(False, depth)
        return self._prefix(True, depth) if self.high[node] == len(self.keys) - 1 and depth <= self.next else None

    def _row(self, node: int, depth: int, kids: int, saved: int, key: bytes | None) -> tuple:
        ends = self.ends[node] if depth == self.depth[node] else None
        return (self.conv[node], depth, key, self.n[node], kids, self.leaves[node], saved, ends)

    def _close(self, node: int, above: int) -> int:
        """Writes a finished node and its chain down to the depth after ``above``; tokens saved in all of it."""
        saved, kids = self.below[node], self.kids[node]
        words, n = self.words[self.low[node]], self.n[node]
        for depth in range(self.depth[node], above, -1):
            begins, w = self.begins(node, depth), words[depth - 1]
            saved += n * w - (w if begins else 0)
            row = self._row(node, depth, kids, saved, self._key(node, depth))
            if depth > above + 1:
                parent_key = self._key(node, depth - 1)
                self.out.append((*row, self.conv[node] if parent_key is None else None, parent_key))
            else:
                self._last = row
            kids = int(begins)
        return saved

    def _attach(self, node: int, child: int) -> None:
        depth = self.depth[node]
        saved = self._close(child, depth)
        self.low[node], self.high[node] = min(self.low[node], self.low[child]), max(self.high[node], self.high[child])
        self.n[node] += self.n[child]
        self.conv[node] = min(self.conv[node], self.conv[child])
        # a sequence that others go on from is no leaf
        self.leaves[node] = self.leaves[child] + (self.leaves[node] if self.inner[node] else 0)
        self.inner[node] = True
        self.below[node] += saved
        self.kids[node] += int(self.begins(child, depth + 1))
        self.waiting.append((self._last, node))


def forest(block: dict, prev: int, next_: int) -> list[tuple]:
    keys, words, at = [], [], 0
    for length in block["lengths"]:
        keys.append(block["keys"][at * KEY : (at + length) * KEY])
        words.append(block["words"][at : at + length])
        at += length
    return Forest(keys, words, block["n"], block["conv"], block["ends"], prev, next_).out


def nodes(cut: DataFrame) -> DataFrame:
    """Nodes of each block; those with a ``key`` are parts of open ones."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                prev, next_ = (block[own] if block[own] >= 0 else block[beside] for own, beside in (("prev", "lcp_prev"), ("next", "lcp_next")))
                conv, depth, key, n, kids, leaves, saved, ends, parent, parent_key = zip(*forest(block, prev, next_), strict=True)
                values = (conv, depth, parent, key, parent_key, n, kids, leaves, saved, ends)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _schema(_NODE), strict=True)], schema=_schema(_NODE))

    # One row for each task that cut blocks: bounded by their number.
    with_ends = cut.drop("first", "last").join(F.broadcast(boundaries(cut)), "part")
    return with_ends.mapInArrow(build, _NODE)


def prefix_trie(sequences: DataFrame, turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of ``sequences`` (``conv_id``, ``keys``, ``words``; read twice)."""
    cut = written(blocks(written(classes(sequences), "trie-classes"), turns), "trie-blocks")
    found = written(nodes(cut), "trie-nodes")
    figures = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    parts = found.where("key IS NOT NULL")
    merged = parts.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in figures], F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key"))
    merged = written(merged, "trie-open")
    names = ["conv_id", "depth", "parent_conv_id", *figures, "ends"]
    own = found.where("key IS NULL AND parent_key IS NULL").select(*names)
    hanging = found.where("key IS NULL AND parent_key IS NOT NULL").drop("key", "parent_conv_id").unionByName(merged.drop("key"))
    tops = merged.select(F.col("key").alias("parent_key"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    joined = hanging.join(id_side(tops), ["parent_key", "depth"], "left").select(*names)
    return own.unionByName(joined).select(*names[:-1], F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt ``conversations``."""
    lists = written(turn_lists(table(spark, sf_dir, "conversations")), "trie-turns")
    return prefix_trie(written(rebuilt(lists), "trie-sequences"))


ORACLE_SQL = r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
    SELECT conv_id AS c, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: list_transform(range(8), lambda b: ((ascii(substr(conv_id::VARCHAR, i::INT, 1)) >> b::INT) & 1)::BIGINT))) AS bs
    FROM (SELECT DISTINCT conv_id FROM t)),
ids AS (
    SELECT c, c - c % 20 AS root,
           xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda s, b: xor(s >> 1, CASE WHEN (xor(s, b) & 1) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 4 AS h
    FROM bits),
turns AS (
    SELECT c, 0 AS part, pos, r, x FROM ids JOIN t ON t.conv_id = root AND pos < h
    UNION ALL SELECT c, 1, pos, r, x FROM ids JOIN t ON t.conv_id = c AND pos >= h),
keyed AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, sha256(length(r) || ':' || r || ':' || x) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM turns),
lists AS (SELECT ids.c, coalesce(list(k ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS ks, coalesce(list(w ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS ws FROM ids LEFT JOIN keyed USING (c) GROUP BY ids.c),
paths AS (
    SELECT c, d, sha256(array_to_string(ks[1:d], ',')) AS p, CASE WHEN d > 0 THEN sha256(array_to_string(ks[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, len(ks) = d AS stops
    FROM lists, unnest(range(0, len(ks) + 1)) AS u(d)),
nodes AS (
    SELECT d, p, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(w) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE stops), '') AS stopped
    FROM paths GROUP BY d, p),
kids AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.p AND kids.d = nodes.d),
sums AS (
    SELECT a.d, a.p, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum(v.saved) AS saved_tokens
    FROM full_ v JOIN paths a ON a.c = v.conv_id AND a.d <= v.d GROUP BY a.d, a.p)
SELECT f.conv_id, f.d::BIGINT AS depth, g.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(f.stopped) AS ends_sha256
FROM full_ f JOIN sums s USING (d, p) LEFT JOIN nodes g ON g.p = f.up AND g.d = f.d - 1
"""
