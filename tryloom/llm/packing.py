"""Operator 7: packing by concatenating and cutting.

First pass: every task tokenizes its texts once and writes each document's ids
(two bytes each) with its place in the task's run of tokens. The totals of the
tasks, one row each, get an exclusive prefix sum; that gives every document its
global offset. Second pass: the concatenation is cut at fixed windows, and a
document that crosses a window's edge leaves one boundary record in each window
it touches. Only the last sequence holds padding. Ids are shuffled nowhere.

Cases: a null or empty text contributes its end id alone; a document longer
than a window is cut into as many pieces as it needs; repeated rows are packed
as often as they occur; an empty table gives no pieces; other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tryloom.llm.chunks import grouped
from tryloom.llm.shared import small_batches, table, written
from tryloom.llm.word_bpe import encoder

#: Documents whose ids stand in one batch.
DOCS_A_BATCH = 512
#: Bytes of text in a group.
TEXT_BYTES = 6 << 20
#: Up to so many tasks, their offsets (24 bytes each) are broadcast.
PARTS_BROADCAST = 200_000


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, key: str) -> DataFrame:
    """Each document's ids, and where they begin among those of its task.

    Columns: ``_key``, ``part`` (the task), ``part_start``, ``doc_tokens``, ``ids`` (unsigned 16-bit).
    """
    names = ["_key", "part", "part_start", "doc_tokens", "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        part, total = TaskContext.get().partitionId(), 0
        for group in grouped(batches, ["_key"], "white", TEXT_BYTES):
            encoded = tool.fields(group.fields)
            for begin in range(0, len(group), DOCS_A_BATCH):
                end = min(len(group), begin + DOCS_A_BATCH)
                codes = group.codes[group.offsets[begin] : group.offsets[end]]
                sums = np.concatenate([[0], np.cumsum(encoded.lengths[codes])])
                # one more id for each document, behind its own
                ends = sums[group.offsets[begin + 1 : end + 1] - group.offsets[begin]] + np.arange(1, end - begin + 1)
                ids = np.empty(ends[-1], "<u2")
                own = np.ones(len(ids), bool)
                own[ends - 1] = False
                ids[own], ids[ends - 1] = encoded.gather(codes), end_id
                tokens = np.diff(ends, prepend=0)
                offsets = np.concatenate([[0], 2 * ends]).astype(np.int64)
                packed = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([group.kept[0].slice(begin, end - begin), pa.array(np.full(len(ends), part, np.int32)), pa.array(total + ends - tokens), pa.array(tokens), packed], names=names)
                total += int(ends[-1])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("_key"), "text").mapInArrow(encode, f"_key {kind}, part int, part_start long, doc_tokens long, ids binary")


def packed(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per piece, with its sequence, its offset there and, if asked, its ``ids``."""
    with small_batches(docs.sparkSession):
        runs = written(tokenized(docs, vocabulary, end_id, key), "packing")
    totals = runs.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the first pass
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if runs.rdd.getNumPartitions() <= PARTS_BROADCAST:
        bases = F.broadcast(bases)
    names = ["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, DOCS_A_BATCH):
                batch = whole.slice(first, DOCS_A_BATCH)
                rows, out = [], [[] for _ in names[1:]]
                begins, sizes, ids = (batch.column(i) for i in (1, 2, 3))
                for row, (begin, size, data) in enumerate(zip(begins.to_pylist(), sizes.to_pylist(), ids.to_pylist(), strict=True)):
                    wide = np.frombuffer(data, "<u2").astype("<u4")
                    at = 0
                    while at < size:
                        sequence, offset = divmod(begin + at, length)
                        take = min(length - offset, size - at)
                        piece = wide[at : at + take].tobytes()
                        rows.append(row)
                        for values, value in zip(out, [at, take, zlib.crc32(piece), size, sequence, offset] + [np.frombuffer(piece, "<i4")] * with_ids, strict=True):
                            values.append(value)
                        at += take
                arrays = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(v, pa.int64()) for v in out[:6]] + [pa.array(v, pa.list_(pa.int32())) for v in out[6:]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    placed = runs.join(bases, "part").select("_key", (F.col("part_start") + F.col("base")).alias("begin"), "doc_tokens", "ids")
    return placed.mapInArrow(cut, schema).withColumnRenamed("_key", key)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` in sequences of 4096 tokens."""
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
