"""Operator 2: language identification of mixed-language text.

The script of a word's letters narrows the candidate languages; the word's
character n-grams score them; and a Viterbi path over the words of a text, with
a penalty for each switch, labels spans. The text's language is the one whose
spans hold most letters (ties: the first in order).

The model is a table of hashed n-gram log-probabilities of fixed size, fitted
on a sample of labelled texts whose expected size is a parameter
(``sample_texts`` for each language, each distinct text once). Only text and
label are used for fitting, and only text for predictions. Scoring has no
shuffle.

Cases: a null text, or one without a letter, is ``und`` with score 0; texts
are scored whole at any length; repeated rows give repeated rows; without a
labelled text there is no model and every text is ``und``; other columns of
the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.llm.chunks import Group, bounded, column, grouped
from tryloom.llm.shared import table

#: Rows of the hashed n-gram table.
BUCKETS = 1 << 16
#: Words times languages that one Viterbi block may hold.
BLOCK_CELLS = 1 << 20
#: Bytes of text in a group, and words whose n-grams are held at once.
TEXT_BYTES, WORDS_HELD = 6 << 20, 40_000
#: First code points of the script ranges (fixed values) and their numbers:
#: 0 Latin, 1 Greek, 2 Cyrillic, 3 Armenian, 4 Hebrew, 5 Arabic, 6 Indic,
#: 7 Thai and Lao, 8 Hangul, 9 Kana, 10 Han, 11 other.
SCRIPTS = (
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 11), (0x0750, 5),
    (0x0780, 11), (0x08A0, 5), (0x0900, 6), (0x0E00, 7), (0x0F00, 11), (0x1100, 8), (0x1200, 11), (0x1C80, 2),
    (0x1C90, 11), (0x1D00, 0), (0x1F00, 1), (0x2000, 0), (0x2DE0, 2), (0x2E00, 11), (0x3040, 9), (0x3100, 10),
    (0x3130, 8), (0x3190, 10), (0xA000, 11), (0xA640, 2), (0xA6A0, 11), (0xAC00, 8), (0xD800, 11), (0xF900, 10),
    (0xFB00, 0), (0xFB13, 3), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 11), (0xFF00, 0), (0xFF66, 9), (0xFFA0, 8),
    (0xFFE0, 11), (0x20000, 10), (0x40000, 11),
)
N_SCRIPTS = 12


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    found = np.zeros(0x110000, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for m in regex.finditer(r"\p{L}+", every):
        begin = ord(m[0][0])
        found[begin : ord(m[0][-1]) + 1] = True
    return found


@dataclass
class Grams:
    """N-gram rows and letters of some words; ``owner`` is the word."""

    owner: list[np.ndarray]
    bucket: list[np.ndarray]
    letters: np.ndarray
    scripts: np.ndarray


def grams(words: list[str], most: int = 3) -> Grams:
    """Hashed n-grams (1 to ``most``) of the words' letters, lower-cased, with word edges."""
    lower = [w.lower() for w in words]
    points = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, lower), np.int64, len(words)) + 1) if words else np.empty(0, np.int64)
    points = points[: len(owner)]
    is_letter = letters()[points]
    text = np.where(is_letter, points, 0).astype(np.uint64)
    out = Grams([], [], np.bincount(owner, is_letter, len(words)).astype(np.int64), np.zeros((len(words), N_SCRIPTS), bool))
    starts = np.array([a for a, _ in SCRIPTS], np.uint32)
    numbers = np.array([b for _, b in SCRIPTS])
    where = np.flatnonzero(is_letter)
    out.scripts[owner[where], numbers[np.searchsorted(starts, points[where], "right") - 1]] = True
    before, after = np.concatenate([[np.uint64(0)], text])[: len(text)], np.concatenate([text[1:], [np.uint64(0)]])[: len(text)]
    # A 1-gram is a letter, a 2-gram a letter and what stands before it or an
    # end, a 3-gram a letter with both neighbours.
    for n, mixed in ((1, text), (2, before << np.uint64(21) | text), (3, (before << np.uint64(21) | text) << np.uint64(21) | after))[:most]:
        mixed = (mixed[where] + np.uint64(n << 62 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        out.owner.append(owner[where])
        out.bucket.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
    return out


@dataclass
class Model:
    """``scores`` by bucket and language; ``allowed`` by script and language."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by word and language, the best at 0, and the letters of each word."""
        scores, counts = np.zeros((len(words), len(self.languages)), np.float32), np.zeros(len(words), np.int64)
        for begin in range(0, len(words), WORDS_HELD):
            end = begin + WORDS_HELD
            scores[begin:end], counts[begin:end] = self._scored(words[begin:end])
        return scores, counts

    def _scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = grams(words)
        n = len(self.languages)
        scores = np.zeros((len(words), n), np.float32)
        for owner, bucket in zip(found.owner, found.bucket, strict=True):
            for k in range(n):
                scores[:, k] += np.bincount(owner, self.scores[bucket, k], len(words))
        fits = (found.scripts.astype(np.uint8) @ self.allowed.astype(np.uint8)) > 0
        narrowed = fits.any(axis=1) & ~fits.all(axis=1)
        scores[narrowed] = np.where(fits[narrowed], scores[narrowed], scores[narrowed].min(axis=1, initial=0)[:, None] - 30)
        scores[found.letters == 0] = 0
        return scores - scores.max(axis=1, initial=-np.inf)[:, None], found.letters


def fit(docs: DataFrame, sample_texts: int = 1500, smoothing: float = 0.5) -> Model:
    """A model of the labelled texts (columns ``text`` and ``lang``).

    About ``sample_texts`` distinct texts of each language are used: those
    whose hash falls below a threshold that follows from the language's count of
    distinct texts.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    share = F.lit(1.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample_texts / counts[name]))).otherwise(share)
    drawn = labelled.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, TEXT_BYTES):
            langs = np.array(column(batch, "lang").to_pylist(), object)
            for name in sorted(set(langs)):
                chosen = column(batch, "text").filter(pa.array(langs == name))
                words = " ".join(chosen.to_pylist()).split()
                sums, scripts = np.zeros(BUCKETS, np.int64), np.zeros(N_SCRIPTS, np.int64)
                for begin in range(0, len(words), WORDS_HELD):
                    found = grams(words[begin : begin + WORDS_HELD])
                    sums += np.bincount(np.concatenate(found.bucket), minlength=BUCKETS)
                    scripts += (found.scripts * found.letters[:, None]).sum(axis=0)
                used = np.flatnonzero(sums)
                bucket = np.concatenate([used, -1 - np.arange(N_SCRIPTS)])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(bucket), pa.string()), pa.array(bucket), pa.array(np.concatenate([sums[used], scripts]))], names=["lang", "bucket", "n"])

    # At most BUCKETS + N_SCRIPTS rows for each language.
    rows = drawn.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    code = {name: i for i, name in enumerate(languages)}
    lang = np.array([code[x] for x in rows.column("lang").to_pylist()], np.int64)
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    table_ = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((N_SCRIPTS, len(languages)))
    real = bucket >= 0
    table_[bucket[real], lang[real]] = n[real]
    scripts[-1 - bucket[~real], lang[~real]] = n[~real]
    table_ += smoothing
    return Model(languages, np.log(table_ / table_.sum(axis=0)).astype(np.float32), scripts >= np.maximum(1, 0.01 * scripts.sum(axis=0)))


def viterbi(scores: np.ndarray, codes: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best path's language of every word of every text.

    Texts advance together, one word a step, the longest first.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = offsets[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    # how many texts are longer than t
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), "right")
    n = scores.shape[1]
    value = np.zeros((len(sizes), n), np.float32)
    switched = np.zeros((len(codes), n), bool)
    source = np.zeros(len(codes), np.uint16)
    for t, m in enumerate(active.tolist()):
        at = begins[:m] + t
        now = value[:m]
        if t:
            best = now.argmax(axis=1)
            source[at] = best
            reach = now[np.arange(m), best] - np.float32(penalty)
            switch = reach[:, None] > now
            switched[at] = switch
            np.maximum(now, reach[:, None], out=now)
        now += scores[codes[at]]
    path = np.zeros(len(codes), np.uint16)
    state = np.zeros(len(sizes), np.int64)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = begins[:m] + t
        ending = sizes[:m] == t + 1
        state[:m][ending] = value[:m][ending].argmax(axis=1)
        path[at] = state[:m]
        jump = switched[at, state[:m]]
        state[:m] = np.where(jump, source[at], state[:m])
    return path


def label(model: Model, group: Group, penalty: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: letters by text and language, the paths, their offsets and letters by word."""
    scores, sizes = model.words(group.fields)
    n = len(model.languages)
    begin = 0
    while begin < len(group):
        most = group.offsets[begin] + BLOCK_CELLS // n
        end = max(begin + 1, int(np.searchsorted(group.offsets, most, "right")) - 1)
        first, last = group.offsets[begin], group.offsets[end]
        codes, offsets = group.codes[first:last], group.offsets[begin : end + 1] - first
        path = viterbi(scores, codes, offsets, penalty)
        text = np.repeat(np.arange(end - begin), np.diff(offsets))
        held = np.bincount(text * n + path, sizes[codes], (end - begin) * n).reshape(-1, n)
        yield held, path, offsets, sizes[codes]
        begin = end


def spans(path: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of equal labels as language, first word and number of words."""
    edges = np.flatnonzero(np.diff(path)) + 1
    begins = [0, *edges.tolist()] if len(path) else []
    return [{"lang": languages[path[b]], "first_word": b, "n_words": e - b} for b, e in zip(begins, [*begins[1:], len(path)], strict=True)]


def language_id(docs: DataFrame, model: Model, keep: list[str], penalty: float = 10.0, with_spans: bool = True, into: tuple[str, str, str] = ("lang_pred", "score", "lang_spans")) -> DataFrame:
    """``keep`` and, named by ``into``, the language, its share of the letters and, if asked, the spans."""
    names = [*keep, *into[: 2 + with_spans]]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, keep, "white", TEXT_BYTES):
            predicted, shares, paths = [], [], []
            if not model.languages:
                predicted, shares, paths = ["und"] * len(group), [0.0] * len(group), [[]] * len(group)
            for held, path, offsets, _ in label(model, group, penalty) if model.languages else ():
                total = held.sum(axis=1)
                predicted += [model.languages[k] if t else "und" for k, t in zip(held.argmax(axis=1).tolist(), total.tolist(), strict=True)]
                shares += (held.max(axis=1) / np.maximum(total, 1)).tolist()
                if with_spans:
                    paths += [spans(path[b:e], model.languages) if t else [] for b, e, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), total.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*group.kept, pa.array(predicted, pa.string()), pa.array(shares, pa.float64())] + [pa.array(paths, kind)] * with_spans, names=names)

    kinds = ["string", "double", "array<struct<lang:string,first_word:long,n_words:long>>"]
    fields = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + [f"`{n}` {t}" for n, t in zip(names[len(keep) :], kinds, strict=False)]
    columns = [F.col(f"`{k}`") for k in (keep if "text" in keep else [*keep, "text"])]
    return docs.select(*columns).mapInArrow(predict, ", ".join(fields))


def is_held_out() -> F.Column:
    """The documents that models may not learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~is_held_out()))
    found = language_id(docs, model, ["doc_id"], with_spans=False)
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
