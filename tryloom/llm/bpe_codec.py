"""Operator 1: byte-level BPE encoding and decoding.

Each task splits its texts into pieces, and an embedded DuckDB encodes the
distinct pieces with a recursive query: the token positions of every piece
join the merge table, the leftmost pair of least rank is contracted, and
pieces without a pair left drop out. An ordered aggregation over token
positions decodes. Texts never leave their partition, so the operator has no
shuffle at all.

Cases: a null text encodes as the empty text; an empty text has no ids; any
length of text or piece is encoded whole, in time and memory near proportion;
repeated rows give repeated rows;
an empty table gives an empty result; other columns of the input are ignored
unless named in ``keep``.
"""

from __future__ import annotations

import base64
import functools
import glob
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.llm.chunks import Group, Ragged, grouped, spaced_chunks, white_then_blank
from tryloom.llm.shared import table

#: Pieces of more bytes are contracted by ``LONG`` instead of ``SHORT``.
LONG_PIECE = 64
#: Pieces, and squares of their sizes, handed to ``SHORT`` at once; it keeps every step's ids.
PIECES_A_QUERY, SQUARES_A_QUERY = 40_000, 20_000_000
#: Bytes of text in a group; the larger it is, the fewer pieces are encoded more than once.
TEXT_BYTES = 40 << 20
#: Bytes handed to ``LONG`` at once, one piece at least.
BYTES_A_QUERY = 500_000

#: No rank.
NONE = 65_535

SHORT = """
WITH RECURSIVE state(w, ids) AS (
    SELECT w, list(id ORDER BY p) FROM symbols GROUP BY w
  UNION ALL
    SELECT s.w, list_concat(s.ids[:b.at - 1], [b.merged], s.ids[b.at + 2:])
    FROM state s JOIN (
        SELECT w, (min(m.merged::UBIGINT << 32 | p) & 4294967295)::INTEGER AS at,
                  (min(m.merged::UBIGINT << 32 | p) >> 32)::USMALLINT AS merged
        FROM (SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids))) AS p FROM state) x
        JOIN merges m ON m.pair = (x.l::UINTEGER << 16 | x.r)
        GROUP BY w) b ON b.w = s.w)
SELECT w, arg_min(ids, len(ids)) AS ids FROM state GROUP BY w
"""

# Position rows of many pieces, one behind the other; ``cut`` ends a piece. In
# a step every pair is contracted that the leftmost least rank would reach
# unchanged: no token of a lower rank ends with its left neighbour and its
# first part, none begins with its second part and its right neighbour, and
# none takes up the pair itself. Of a run of equal pairs, every other one. The
# leftmost least pair of each segment is always contracted. A place that no
# token can bridge (its pair stands in ``pairs`` nowhere) parts segments, and
# tokens between two such places are done and leave the recursion, so what it
# keeps stays in proportion to the text.
LONG = """
WITH RECURSIVE state(p, id, cut, done) AS (
    SELECT p, id, cut, false FROM symbols
  UNION ALL
    SELECT p, id, cut, cut AND lag(cut, 1, true) OVER (ORDER BY p)
    FROM (
        SELECT p, CASE WHEN hit THEN merged ELSE id END AS id, CASE WHEN first_at IS NULL THEN true WHEN hit THEN cut2 ELSE cut END AS cut, lag(hit, 1, false) OVER (ORDER BY p) AS gone
        FROM (
            SELECT *, coalesce(p = first_at OR (safe AND start & 1 = 1 AND (n - (start >> 1)) % 2 = 0), false) AS hit
            FROM (
                SELECT *, max(CASE WHEN NOT follows THEN n << 1 | strict::BIGINT END) OVER (ORDER BY p) AS start, (min(merged::BIGINT << 32 | p) OVER (PARTITION BY segment)) & 4294967295 AS first_at
                FROM (
                    SELECT *, safe AND tied AND lag(CASE WHEN safe THEN merged END) OVER (ORDER BY p) IS NOT DISTINCT FROM merged AS follows,
                           max(CASE WHEN before_cut THEN n END) OVER (ORDER BY p) AS segment
                    FROM (
                        SELECT y.*, coalesce(y.merged <= coalesce(after_least, 65535) AND (y.calm OR (y.merged < coalesce(e2.ends, 65535) AND y.merged < coalesce(b2.begins, 65535))), false) AS safe,
                               coalesce(y.merged < coalesce(before_least, 65535), false) AS strict, coalesce(y.merged = before_least, false) AS tied
                        FROM (
                            SELECT x.p, x.id, x.before, x.after, t.pair IS NULL AS cut, t.merged, t.calm, row_number() OVER byp AS n, lag(t.pair IS NULL, 1, true) OVER byp AS before_cut, lead(t.pair IS NULL, 1, true) OVER byp AS cut2,
                                   lag(t.ends) OVER byp AS before_least, lead(t.begins) OVER byp AS after_least
                            FROM (SELECT p, id, cut, lead(id) OVER byp AS r, lag(id) OVER byp AS before, lead(id, 2) OVER byp AS after FROM state WHERE NOT done WINDOW byp AS (ORDER BY p)) x
                            LEFT JOIN pairs t ON t.pair = (CASE WHEN NOT cut THEN x.id END::UINTEGER << 16 | x.r)
                            WINDOW byp AS (ORDER BY x.p)) y
                        LEFT JOIN pairs e2 ON e2.pair = (CASE WHEN NOT y.calm AND NOT y.before_cut THEN before END::UINTEGER << 16 | y.merged)
                        LEFT JOIN pairs b2 ON b2.pair = (CASE WHEN NOT y.calm AND NOT y.cut2 THEN y.merged END::UINTEGER << 16 | after)))))
        )
    WHERE NOT gone)
SELECT p, id FROM state WHERE done ORDER BY p
"""

# Positions run over all ids; a block holds many pieces.
DECODE = """
SELECT block, string_agg(t.bytes, '' ORDER BY p) AS bytes
FROM (SELECT p, p // 4096 AS block, id FROM encoded) e JOIN tokens t USING (id)
GROUP BY block ORDER BY block
"""


def batches(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``sizes`` whose sums are at most ``most`` (one entry at least) and of at most ``rows`` entries."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    while begin < len(sizes):
        end = int(np.searchsorted(sums, sums[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), begin + rows, len(sizes))
        yield begin, end
        begin = end


class Codec:
    """Encodes and decodes distinct pieces inside one Python worker."""

    def __init__(self, vocabulary: str, pattern: str, memory: str = "300MB"):
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(self.ranks.values()) >= NONE:
            raise ValueError("ids over 65534 are not supported")
        self.split = regex.compile(pattern).findall
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append(left << 16 | right)
                    merged.append(rank)
        # what a query cannot hold in memory goes to a folder of this worker, made when it is needed
        spill = f"{tempfile.gettempdir()}/pieces-{os.getpid()}"
        for left in glob.glob(f"{tempfile.gettempdir()}/pieces-*"):
            # a worker is ended without notice, so the next one removes what it has left
            if not os.path.exists(f"/proc/{left.rpartition('-')[2]}"):
                shutil.rmtree(left, ignore_errors=True)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill, "preserve_insertion_order": False})
        self._load("merges", {"pair": pa.array(pairs, pa.uint32()), "merged": pa.array(merged, pa.uint16())})
        # As text, each byte is the character of its number.
        self._load("tokens", {"id": pa.array(self.ranks.values(), pa.uint16()), "bytes": [t.decode("latin-1") for t in self.ranks]})
        self.token_bytes = np.zeros(1 << 16, np.int64)
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = len(token)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.uint16)
        self.has_pairs = False

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM incoming")
        self.db.unregister("incoming")

    def _load_pairs(self) -> None:
        """Every pair of tokens that stands next to each other within a token.

        ``merged`` is what the pair makes, ``ends`` the least token that ends
        with it, ``begins`` the least that begins with it, and ``calm`` whether
        no token made of ``merged`` and more has a lower rank than it.
        """
        if self.has_pairs:
            return
        known: dict[int, list[int]] = {}
        rash = set()
        for token, rank in self.ranks.items():
            size = len(token)
            parts = [[self.ranks.get(token[a:b]) for b in range(size + 1)] for a in range(size)]
            for i in range(1, size):
                for a in range(i):
                    left = parts[a][i]
                    for b in range(i + 1, size + 1) if left is not None else ():
                        right = parts[i][b]
                        if right is None:
                            continue
                        found = known.setdefault(left << 16 | right, [NONE, NONE, NONE])
                        if b == size:
                            found[1] = min(found[1], rank)
                        if a == 0:
                            found[2] = min(found[2], rank)
                        if a == 0 and b == size:
                            found[0] = rank
                            rash.update(x for x in (left, right) if rank <= x)
        columns = np.array(list(known.values()), np.uint16).T
        self._load("pairs", {
            "pair": np.fromiter(known, np.uint32, len(known)), "merged": pa.array(columns[0], pa.uint16(), mask=columns[0] == NONE),
            "ends": columns[1], "begins": columns[2], "calm": ~np.isin(columns[0], np.array(sorted(rash), np.uint16)),
        })
        self.has_pairs = True

    def _short(self, data: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces (by number), how many ids each has, and the ids."""
        starts = np.cumsum(each) - each
        self.db.register("symbols", pa.table({"w": np.repeat(np.arange(len(each), dtype=np.uint32), each), "p": (np.arange(len(data)) - np.repeat(starts, each)).astype(np.uint32), "id": self.byte_ids[data]}))
        out = self.db.sql(SHORT).to_arrow_table()
        ids = out.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return out.column("w").to_numpy(), np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False)

    def _long(self, data: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._load_pairs()
        ends = np.cumsum(each)
        cut = np.zeros(len(data), bool)
        cut[ends - 1] = True
        self.db.register("symbols", pa.table({"p": np.arange(len(data), dtype=np.uint32), "id": self.byte_ids[data], "cut": cut}))
        out = self.db.sql(LONG).to_arrow_table()
        return np.arange(len(each)), np.diff(np.searchsorted(out.column("p").to_numpy(), ends), prepend=0), out.column("id").to_numpy()

    def encode(self, pieces: list[bytes]) -> Ragged:
        """The ids of each piece."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        known = np.flatnonzero(whole >= 0)
        parts.append((known, np.ones(len(known), np.int64), whole[known].astype(np.uint16)))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        short, long = np.flatnonzero((whole < 0) & (sizes <= LONG_PIECE)), np.flatnonzero((whole < 0) & (sizes > LONG_PIECE))
        for contract, rows, cost, most, many in ((self._short, short, sizes**2, SQUARES_A_QUERY, PIECES_A_QUERY), (self._long, long, sizes, BYTES_A_QUERY, BYTES_A_QUERY)):
            for begin, end in batches(cost[rows], most, many):
                some = rows[begin:end]
                data = np.frombuffer(b"".join([pieces[i] for i in some.tolist()]), np.uint8)
                at, counts, ids = contract(data, sizes[some])
                parts.append((some[at], counts, ids))
        order = np.concatenate([p[0] for p in parts])
        lengths = np.empty(len(pieces), np.int64)
        lengths[order] = np.concatenate([p[1] for p in parts])
        shuffled = Ragged(np.concatenate([p[2] for p in parts]).astype(np.uint16), np.concatenate([p[1] for p in parts]))
        back = np.empty(len(pieces), np.int64)
        back[order] = np.arange(len(order))
        return Ragged(shuffled.gather(back), lengths)

    def decode(self, encoded: Ragged) -> tuple[bytes, np.ndarray]:
        """All pieces' bytes, decoded by an ordered aggregation over token positions, and where each ends."""
        texts = []
        step = 4096 * 256
        for begin in range(0, len(encoded.flat), step):
            ids = encoded.flat[begin : begin + step]
            self.db.register("encoded", pa.table({"p": np.arange(begin, begin + len(ids)), "id": ids}))
            texts += self.db.sql(DECODE).to_arrow_table().column("bytes").to_pylist()
        sums = np.concatenate([[0], np.cumsum(self.token_bytes[encoded.flat])])
        return "".join(texts).encode("latin-1"), sums[encoded.starts + encoded.lengths]

    def chunks(self, chunks: list[str]) -> tuple[Ragged, list[bytes]]:
        """Ids and decoded bytes of each chunk, every distinct piece encoded once."""
        index: dict[str, int] = {}
        codes: list[int] = []
        counts = np.ones(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                codes.append(index.setdefault(chunk, len(index)))
            else:
                found = self.split(chunk)
                counts[i] = len(found)
                codes += [index.setdefault(p, len(index)) for p in found]
        encoded = self.encode([p.encode("utf-8", "surrogatepass") for p in index])
        text, ends = self.decode(encoded)
        decoded = [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []
        where = np.array(codes, np.int64)
        ends = np.cumsum(counts)
        sums = np.concatenate([[0], np.cumsum(encoded.lengths[where])])
        lengths = sums[ends] - sums[ends - counts]
        texts = [decoded[c] for c in codes]
        joined = [texts[b] if e - b == 1 else b"".join(texts[b:e]) for b, e in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        return Ragged(encoded.gather(where), lengths), joined

    def texts(self, group: Group) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids and decoded bytes of each text of ``group``.

        A blank begins a chunk of its own unless other white space stands
        before it; texts with such a place are cut at white-space runs instead.
        """
        odd = white_then_blank(group.texts)
        first = [group.fields[group.codes[b]] for b in group.offsets[:-1].tolist()]
        runs = {i: spaced_chunks(group.texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        used = np.zeros(len(group.fields), bool)
        used[group.codes[np.repeat(~odd, np.diff(group.offsets))]] = True
        chunks = {" " + f: None for f, u in zip(group.fields, used.tolist(), strict=True) if u}
        place = np.cumsum(used) - 1
        more = {c: None for cs in [first, *runs.values()] for c in cs if c not in chunks}
        order = {c: i for i, c in enumerate([*chunks, *more])}
        encoded, decoded = self.chunks(list(order))
        for i in range(len(group)):
            if odd[i]:
                codes = np.array([order[c] for c in runs[i]], np.int64)
            else:
                codes = place[group.of(i)]
                codes[0] = order[first[i]]
            yield encoded.gather(codes), b"".join([decoded[c] for c in codes.tolist()])


@functools.lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def byte_pair_codec(docs: DataFrame, vocabulary: str, pattern: str, keep: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``keep``, ``n_tokens``, digests of ids and decoded bytes and, if asked, ``ids`` and ``decoded``."""
    kind = docs.schema[keep].dataType.simpleString()
    columns = ["_key", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    schema = f"_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, pattern)
        for group in grouped(batches, ["_key"], most=TEXT_BYTES):
            out: list[list] = [[] for _ in columns[1:]]
            for ids, text in tool.texts(group):
                row = [len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()]
                for values, value in zip(out, row + [ids.astype(np.int32), text] * with_ids, strict=True):
                    values.append(value)
            yield pa.RecordBatch.from_arrays([group.kept[0], *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=columns)

    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()][: len(columns) - 1]
    return docs.select(F.col(f"`{keep}`").alias("_key"), "text").mapInArrow(encode, schema).withColumnRenamed("_key", keep)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_pair_codec(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)
