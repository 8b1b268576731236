"""What a corpus weighs: bytes by field, kept and discarded diffs, compressed blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def field_bytes(df: DataFrame) -> DataFrame:
    """Characters of each field's JSON over all records: ``field`` and ``chars``; null fields count 4.

    Non-ASCII characters stand as themselves, unlike in writers that escape them.
    """
    # The text between the braces and the name, so that each value is measured as it stands in a line.
    sized = [F.struct(F.lit(c).alias("field"), F.coalesce(F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6, F.lit(4)).alias("chars")) for c in df.columns]
    filled = [F.struct(s["field"].alias("field"), F.when(F.col(c).isNull(), 4).otherwise(s["chars"]).alias("chars")) for s, c in zip(sized, df.columns, strict=True)]
    return df.select(F.inline(F.array(*filled))).groupBy("field").agg(F.sum("chars").alias("chars"))


def diff_bytes(classified: DataFrame) -> DataFrame:
    """One row: attempts and successes, and the bytes of kept, discarded and prose-only diffs and of error heads."""
    size = F.coalesce(F.octet_length("diff"), F.lit(0))
    kind = F.col("delta_class")
    return classified.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("outcome") == "ok").alias("ok"),
        F.sum(F.when(kind == "code", size).otherwise(0)).alias("kept"),
        F.sum(F.when(kind != "code", size).otherwise(0)).alias("discarded"),
        F.sum(F.when(kind == "doc", size).otherwise(0)).alias("doc_only"),
        F.sum(F.coalesce(F.octet_length("error_head"), F.lit(0))).alias("error_bytes"),
    )


def largest_fields(sizes: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest fields and one row for the others. The input has a row a field."""
    top = sizes.orderBy(F.desc("chars"), "field").limit(n)
    rest = sizes.join(top.select("field"), "field", "left_anti").agg(F.lit("(others)").alias("field"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    return top.unionByName(rest)


def block_gz(df: DataFrame, column: str, block: int = 1 << 20) -> DataFrame:
    """``blocks``, ``raw`` and ``block_gz``: the bytes of a column compressed in blocks of about ``block`` bytes.

    Blocks lose what they share with each other, so this is above the size of one stream.
    """

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, out = [], 0, [0, 0, 0]

        def close() -> None:
            nonlocal held, size
            if held:
                out[0] += 1
                out[1] += size
                out[2] += len(zlib.compress(b"".join(held), 6, wbits=31))
            held, size = [], 0

        for batch in batches:
            for value in batch.column(0):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                held.append(data)
                size += len(data)
                if size >= block:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in out], names=["blocks", "raw", "block_gz"])

    parts = df.select(F.col(column).cast("string").alias("v")).mapInArrow(squeeze, "blocks long, raw long, block_gz long")
    return parts.agg(*[F.sum(c).alias(c) for c in ("blocks", "raw", "block_gz")])


def source_bytes(spark: SparkSession, folder: str, tracked: DataFrame | None = None, glob: str = "*.thy") -> DataFrame:
    """Files and bytes of sources below a folder; ``tracked`` (``path``) limits them. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    if tracked is not None:
        found = found.join(tracked.select("path"), "path", "left_semi")
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
