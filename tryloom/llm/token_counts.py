"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list and its adjacent pairs a heap. The pair of
least rank (leftmost among equals) is popped and contracted until the heap is
empty; the count is the number of initial symbols minus the merges, and no
identifier is ever emitted. Each distinct word of a bounded group of texts is
merged once. There is no shuffle.

Cases: a null text counts as empty and has no tokens; any length of text or
word is merged whole (the heap keeps a word of n symbols at n log n); repeated
rows give repeated rows; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.llm.chunks import grouped
from tryloom.llm.shared import table
from tryloom.llm.word_bpe import byte_characters, lowered

#: Words whose counts a worker remembers between groups before it starts anew.
WORDS_KEPT = 500_000


class WordCounter:
    """Counts tokens of words and fields for a lower-casing word-end BPE file."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not end or model["unk_token"] is not None:
            raise ValueError("a BPE with a word-end suffix and no unknown token is expected")
        ids = model["vocab"]
        self.merges = {ids[a] << 16 | ids[b]: rank << 16 | ids[a + b] for rank, (a, b) in enumerate(model["merges"])}
        self.inner = [ids[c] for c in byte_characters()]
        self.last = [ids[c + end] for c in byte_characters()]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.known: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Initial symbols minus merges."""
        data = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        count = size = len(symbols)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        rank_of = self.merges.get
        heap = []
        for i in range(size - 1):
            found = rank_of(symbols[i] << 16 | symbols[i + 1])
            if found is not None:
                heap.append((found >> 16 << 48) | i << 16 | found & 0xFFFF)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top >> 16 & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= size or rank_of(symbols[i] << 16 | symbols[j]) != (top >> 48 << 16 | top & 0xFFFF):
                continue
            symbols[i], symbols[j] = top & 0xFFFF, -1
            count -= 1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                found = rank_of(symbols[i] << 16 | symbols[k])
                if found is not None:
                    heappush(heap, (found >> 16 << 48) | i << 16 | found & 0xFFFF)
            h = before[i]
            if h >= 0:
                found = rank_of(symbols[h] << 16 | symbols[i])
                if found is not None:
                    heappush(heap, (found >> 16 << 48) | h << 16 | found & 0xFFFF)
        return count

    def _plain(self, text: str) -> int:
        total = 0
        for word in self.words(lowered(text)):
            count = self.known.get(word)
            if count is None:
                count = self.known[word] = self.merged(word)
            total += count
        return total

    def field(self, field: str) -> int:
        """Tokens of a field. A special token's text counts as that one token."""
        if "<" not in field:
            return self._plain(field)
        parts = self.special.split(field)
        return len(parts) // 2 + sum(map(self._plain, parts[::2]))

    def fields(self, fields: list[str]) -> np.ndarray:
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        return np.fromiter(map(self.field, fields), np.int64, len(fields))


@functools.lru_cache(maxsize=2)
def counter(vocabulary: str) -> WordCounter:
    return WordCounter(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, keep: str = "doc_id") -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every text."""
    names = ["_key", "n_bytes", "n_tokens", "over_limit"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(vocabulary)
        for group in grouped(batches, ["_key"], "white"):
            sums = np.concatenate([[0], np.cumsum(tool.fields(group.fields)[group.codes])])
            tokens = sums[group.offsets[1:]] - sums[group.offsets[:-1]]
            yield pa.RecordBatch.from_arrays([group.kept[0], pa.array(group.sizes()), pa.array(tokens), pa.array(tokens > limit)], names=names)

    kind = docs.schema[keep].dataType.simpleString()
    counted = docs.select(F.col(f"`{keep}`").alias("_key"), "text").mapInArrow(count, f"_key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("_key", keep)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
