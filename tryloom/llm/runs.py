"""Operator 11: periodic runs of words, detected on a Re-Pair grammar.

Each document's word ids are compressed by Re-Pair: pairs that occur at least
twice in it are replaced by nonterminals, the most frequent first. Rounds replace
many at once: a pair is replaced wherever no overlapping pair ranks above it, and
a place whose pair occurs once is never replaced. What is left of a stretch at
the end is joined by a balanced tree of further nodes that occur once.

A run lies within the expansion of a lowest node and crosses the boundary between
its two halves, so it has two of its periods on one side of it. For each
nonterminal the runs over its boundary are computed once, at one place: a period
is tried if the words at the boundary come again at its distance, and the run is
extended to both sides, word by word. They are then carried to every place where
the nonterminal is derived, and intervals of one period that overlap by it are
merged into maximal ones. A pair of words that occurs once in a document lies in
no run, so only stretches of repeated pairs are looked at.

Texts are worked on in groups of bounded size; a text is never divided and
nothing is shuffled.

Cases: a null text counts as empty and has no word and no run; texts are taken
whole at any length (a text of words that are all equal takes linear time and
memory); a row without an id keeps its words as they are; repeated rows give
repeated rows; an empty table gives an empty result; other columns of the input
are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.llm.chunks import bounded, column
from tryloom.llm.shared import table
from tryloom.llm.textspans import bound

WORD = r"[^\x20\x09-\x0D]++"
#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Text bytes of a group, pairs of node and period that are tried at once, and words that are compared before runs are extended one by one.
GROUP, AT_ONCE, FIRST_WORDS = 4 << 20, 1 << 21, 8

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start:long,length:long,period:long>"


def _stretches(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last elements of the maximal stretches whose neighbours are joined (``pairs[i]`` joins i and i + 1), of ``least`` elements at least."""
    edge = np.diff(np.concatenate(([0], pairs.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    good = last - first + 1 >= least
    return first[good], last[good]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` occur more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return out


class Grammar:
    """Re-Pair of the stretches of an array: rules at one place each, all places, and the nodes above.

    ``words`` are ids that differ between documents; stretch ``i`` is from ``first[i]`` to ``last[i]`` of them.
    """

    def __init__(self, words: np.ndarray, stretch: np.ndarray):
        self.words = words
        n = len(words)
        symbols = np.unique(words, return_inverse=True)[1].astype(np.int64)
        base = 2 * n + 1  # a rule takes two symbols away at some place, so there are fewer symbols than this
        keys, ids = np.empty(0, np.int64), np.empty(0, np.int64)  # rules by their pair
        self.low, self.middle, self.high = [], [], []
        self.rule, self.place = [], []
        tops: list[tuple[np.ndarray, np.ndarray]] = []
        rules, next_id = 0, int(symbols.max(initial=-1)) + 1
        start, length, part = np.arange(n), np.ones(n, np.int64), stretch.copy()
        while len(symbols):
            joined = part[:-1] == part[1:]
            pair = symbols[:-1] * base + symbols[1:]
            _, kind, count = np.unique(pair[joined], return_inverse=True, return_counts=True)
            often = count[kind] > 1
            joined[np.flatnonzero(joined)[~often]] = False
            single = ~(np.concatenate((joined, [False])) | np.concatenate(([False], joined)))
            # where nothing is replaced any more, the symbol is one of the stretch's last
            tops.append((start[single], length[single]))
            if single.all():
                break
            # by count, equal ones in a fixed but scattered order
            scattered = np.argsort(np.lexsort(((np.arange(len(count)) * 2654435761) % (1 << 32), count)))
            rank = np.full(len(joined), -1, np.int64)
            rank[joined] = scattered[kind[often]]
            chosen = self._chosen(rank)
            at = np.flatnonzero(chosen)
            new = np.unique(pair[at])
            new = new[~np.isin(new, keys, assume_unique=True)]
            keys, ids = np.concatenate((keys, new)), np.concatenate((ids, np.arange(next_id, next_id + len(new))))
            order = np.argsort(keys)
            keys, ids, next_id = keys[order], ids[order], next_id + len(new)
            named = ids[np.searchsorted(keys, pair[at])]
            self.rule.append(named)
            self.place.append(start[at])
            one = np.unique(named, return_index=True)[1]
            fresh = named[one] >= next_id - len(new)
            one = at[one[fresh]]
            self.low.append(start[one])
            self.middle.append(start[one] + length[one])
            self.high.append(start[one] + length[one] + length[one + 1])
            rules += len(new)
            symbols[at] = named
            length[at] += length[at + 1]
            # stretches fall apart where nothing joins
            part = np.concatenate(([0], np.cumsum(~joined)))
            stays = ~single
            stays[at + 1] = False
            symbols, start, length, part = symbols[stays], start[stays], length[stays], part[stays]
        self.rules = rules
        self._above(np.concatenate([t[0] for t in tops]) if tops else start, np.concatenate([t[1] for t in tops]) if tops else length, stretch)
        empty = [np.empty(0, np.int64)]
        self.low, self.middle, self.high = (np.concatenate(empty + x).astype(np.int64) for x in (self.low, self.middle, self.high))
        rule = np.concatenate(empty + self.rule).astype(np.int64) - (next_id - rules)
        order = np.argsort(rule, kind="stable")
        self.place = np.concatenate(empty + self.place).astype(np.int64)[order]
        self.first_place = np.searchsorted(rule[order], np.arange(rules + 1))

    @staticmethod
    def _chosen(rank: np.ndarray) -> np.ndarray:
        """Pairs that rank above both neighbours; of a chain of equal pairs every other one from its left."""
        n = len(rank)
        begins = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        sizes = np.diff(np.concatenate((begins, [n])))
        values = rank[begins]
        above = (values > np.concatenate(([-1], values[:-1]))) & (values > np.concatenate((values[1:], [-1]))) & (values >= 0)
        offset = np.arange(n) - np.repeat(begins, sizes)
        return np.repeat(above, sizes) & (offset % 2 == 0)

    def _above(self, start: np.ndarray, length: np.ndarray, stretch: np.ndarray) -> None:
        """Nodes over the last symbols of each stretch, two by two until one is left."""
        order = np.argsort(start)
        start, length = start[order], length[order]
        part = stretch[start]
        while len(start):
            begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sizes = np.diff(np.concatenate((begins, [len(part)])))
            if sizes.max() == 1:
                break
            offset = np.arange(len(part)) - np.repeat(begins, sizes)
            left = np.flatnonzero((offset % 2 == 0) & (offset + 1 < np.repeat(sizes, sizes)))
            self.low.append(start[left])
            self.middle.append(start[left] + length[left])
            self.high.append(start[left] + length[left] + length[left + 1])
            length[left] += length[left + 1]
            stays = np.ones(len(part), bool)
            stays[left + 1] = False
            start, length, part = start[stays], length[stays], part[stays]


def _extent(w: np.ndarray, x: np.ndarray, y: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``x`` and ``y`` on, in the direction of ``step``, are equal; at most ``room``."""
    n, live, size = np.zeros(len(x), np.int64), np.flatnonzero(room > 0), 8
    while len(live):
        size = max(1, min(size, AT_ONCE // len(live)))
        t = np.arange(size)
        at = n[live, None] + t
        inside = at < room[live, None]
        at = np.where(inside, at, 0) * step
        same = inside & (w[x[live, None] + at] == w[y[live, None] + at])
        got = np.where(same.all(axis=1), size, np.argmin(same, axis=1))
        n[live] += got
        live, size = live[got == size], size * 2
    return n


def _crossing(w: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray, right: bool) -> tuple[np.ndarray, ...]:
    """``node``, ``start``, ``end`` and ``period`` of the runs over each node's boundary that have two periods on its right (or left) side."""
    most = (high - middle if right else middle - low) // 2
    most[high - low < LEAST] = 0
    out: list[tuple[np.ndarray, ...]] = []
    upto = np.cumsum(most)
    begin = 0
    while begin < len(most):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + AT_ONCE, "right")))
        sizes = most[begin:end]
        # A node's periods stay together, as shorter ones rule longer ones out: memory is linear in the longest text.
        total = int(sizes.sum())
        node = np.repeat(np.arange(begin, end), sizes)
        period = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        for j in range(FIRST_WORDS):
            x, far = (middle[node] + j, period) if right else (middle[node] - 1 - j, -period)
            ends = j >= period
            same = ends | (w[np.where(ends, 0, x)] == w[np.where(ends, 0, x + far)])
            node, period = node[same], period[same]
        begin = end
        while len(node):
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            k, q = node[first], period[first]
            m = middle[k]
            if right:
                ahead = _extent(w, m, m + q, high[k] - m - q, 1)
                back = _extent(w, m - 1, m + q - 1, m - low[k], -1)
                s, e, square = m - back, m + q + ahead, ahead >= q
            else:
                back = _extent(w, m - 1 - q, m - 1, m - q - low[k], -1)
                ahead = _extent(w, m - q, m, high[k] - m, 1)
                s, e, square = m - q - back, m + ahead, back >= q
            good = square & (e - s >= np.maximum(LEAST, TIMES * q))
            out.append((k[good], s[good], e[good], q[good]))
            # Longer periods within what has a shorter one are its multiples.
            which = np.cumsum(np.concatenate(([True], node[1:] != node[:-1]))) - 1
            reach = np.where(square, e - m if right else m - s, 0)[which]
            stays = 2 * period > reach
            stays[first] = False
            node, period = node[stays], period[stays]
    return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(4))


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one period that overlap by it are one."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    group = np.cumsum(np.concatenate(([0], period[1:] != period[:-1])))
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    fresh = np.concatenate(([True], (period[1:] != period[:-1]) | (start[1:] + period[1:] > reach[:-1])))
    at = np.flatnonzero(fresh)
    return start[at], np.maximum.reduceat(end, at), period[at]


def runs_of(words: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, ...]:
    """``start``, ``end`` and ``period`` of all runs of the documents' words, which are given one after the other."""
    none = (np.empty(0, np.int64),) * 3
    if len(words) < LEAST:
        return none
    words, document = words.astype(np.int64), document.astype(np.int64)
    beside = document[:-1] == document[1:]
    size = int(words.max()) + 1
    # A document's number, and two words of it
    pair = (document[:-1] * size + words[:-1]) * size + words[1:]
    joined = np.zeros(len(pair), bool)
    joined[beside] = _repeated(pair[beside])
    first, last = _stretches(joined, LEAST)
    sizes = last - first + 1
    if not len(sizes):
        return none
    stretch = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(stretch)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    w = words[place] + document[place] * size
    g = Grammar(w, stretch)
    found = [_crossing(g.words, g.low, g.middle, g.high, side) for side in (True, False)]
    node, s, e, q = (np.concatenate([f[i] for f in found]) for i in range(4))
    # A rule's runs at all of its places; the nodes above have one place.
    inner = node < g.rules
    k = node[inner]
    times = g.first_place[k + 1] - g.first_place[k]
    moved = g.place[np.repeat(g.first_place[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())] - np.repeat(g.low[k], times)
    start = np.concatenate((s[~inner], np.repeat(s[inner], times) + moved))
    end = np.concatenate((e[~inner], np.repeat(e[inner], times) + moved))
    start, end, period = merged(start, end, np.concatenate((q[~inner], np.repeat(q[inner], times))))
    return place[start], place[end - 1] + 1, period


def _worked(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Runs, and the text of the words that are kept, of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values = split.flatten()
    document = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    full = pc.greater(pc.binary_length(values), 0)
    values, document = values.filter(full), document[full.to_numpy(zero_copy_only=False)]
    codes = values.dictionary_encode().indices.to_numpy()
    start, end, period = runs_of(codes, document)
    dropped = np.zeros(len(codes) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    offsets = lambda owner: np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(offsets(document[kept]), values.filter(pa.array(kept))), " ")
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    owner = document[start] if len(start) else np.empty(0, np.int64)
    begins = offsets(document)[owner] if len(start) else owner
    found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - begins, end - start, period)], fields=list(_RUN))
    return pa.ListArray.from_arrays(offsets(owner), found), collapsed


def periodic_runs(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``runs`` (start, length and period in words, by start and period) and ``collapsed``: the text of the words that repeat no earlier period of a run, joined by blanks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, GROUP):
            found, collapsed = _worked(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), found, collapsed], names=[*keep, "runs", "collapsed"])

    fields = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.select(*keep, "text").mapInArrow(work, f"{fields}runs array<{_RUN_SQL}>, collapsed string")


def with_periods(text: Column, doc_id: Column) -> Column:
    """Texts of every tenth id (by its checksum) with a tail that repeats some of its words; others, and those without an id, as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n

        def rewritten(x: Column) -> Column:
            return F.array_join(F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " ")

        return F.when(n > 0, bound(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), rewritten)).otherwise("")

    return F.when(h % 10 == 0, bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), tail)).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run of the greatest exponent, the first of equal ones; ``runs`` are in order."""
    none = F.lit(None).cast(_RUN_SQL)
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, some of which repeat a part of themselves first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_periods(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs, ["doc_id"]).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = [F.col("best")[k].alias(k) for k in ("start", "length", "period")]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *best,
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
