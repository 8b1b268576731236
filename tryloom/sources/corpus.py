"""Reading and writing corpora and build logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.operators.ordered import number_rows
from tryloom.schemas import RECORD


def scan(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """A JSONL corpus with ``corpus_id`` (its file) and ``seq`` (its place, counted over non-blank lines).

    A file is read whole. ``large`` reads its lines in parallel instead and numbers
    them by the file's blocks, in the order in which they stand, so that no row holds a file.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    schema = f"{RECORD}, _corrupt_record string"
    name = F.regexp_extract(F.input_file_name(), "[^/]*$", 0).alias("corpus_id")
    if large:
        # Within a block, lines are read in order by one task.
        text = spark.read.text(path).select(name, "value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
        numbered = number_rows(text.where(F.col("value").rlike(r"\S")), ["corpus_id"], F.col("_at"), ["_id"])
        return numbered.select("corpus_id", "seq", F.from_json("value", schema, options).alias("r")).select("corpus_id", "seq", "r.*")
    text = spark.read.text(path, wholetext=True).select(name, "value")
    lines = text.select("corpus_id", F.posexplode(F.filter(F.split("value", "\n"), lambda x: x.rlike(r"\S"))).alias("seq", "line"))
    return lines.select("corpus_id", F.col("seq").cast("long"), F.from_json("line", schema, options).alias("r")).select("corpus_id", "seq", "r.*")


def pool(corpora: list[DataFrame], name: str = "pooled", distinct: bool = False) -> DataFrame:
    """Corpora in one: in the order given, then each one's own. ``distinct`` keeps one row of a build of an instance."""
    tagged = [c.withColumn("_file", F.lit(i)) for i, c in enumerate(corpora)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).withColumnRenamed("seq", "_line")
    if distinct:
        both = both.dropDuplicates(["instance_id", "build_id"])
    numbered = number_rows(both.withColumn("corpus_id", F.lit(name)), ["corpus_id"], F.struct("_file", F.floor(F.col("_line") / 100_000)), ["_file", "_line"])
    return numbered.drop("_file", "_line")


def land(attempts: DataFrame, path: str) -> None:
    """A corpus as Parquet by ``corpus_id``, so that later reads skip the diffs they do not need."""
    attempts.write.mode("overwrite").partitionBy("corpus_id").parquet(path)


def rewrite(attempts: DataFrame, path: str) -> None:
    """A repaired corpus, to a new path; writing over an existing one is an error."""
    attempts.write.mode("errorifexists").partitionBy("corpus_id").json(path)


def export_episodes(episodes: DataFrame, path: str) -> None:
    """Nested episodes as JSON, by instance."""
    episodes.write.partitionBy("instance_id").json(path)


def write_histogram(hist: DataFrame, path: str, kind: str = "csv") -> None:
    """A length histogram as CSV with a header, or as JSON."""
    ordered = hist.orderBy("length")
    (ordered.write.option("header", True).csv if kind == "csv" else ordered.write.json)(path)


def build_log(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """Log files as ``build_id`` (the file's name), ``line_no`` and ``text`` without escape codes; a last line without its feed counts.

    A log is read whole. ``large`` reads lines in parallel instead and numbers
    them by the file's blocks, so that no row holds a log.
    """
    from tryloom.operators.logs import stripped

    name = F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1).alias("build_id")
    if large:
        rows = spark.read.text(path).select(name, "value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
        numbered = number_rows(rows, ["build_id"], F.col("_at"), ["_id"], "line_no")
        return numbered.select("build_id", "line_no", stripped(F.regexp_replace("value", r"\r\z", "")).alias("text"))
    whole = spark.read.text(path, wholetext=True).select(name, F.regexp_replace("value", r"\n\z", "").alias("value"))
    return whole.select("build_id", F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "text")).select("build_id", F.col("line_no").cast("long"), stripped(F.col("text")).alias("text"))


def log_stream(spark: SparkSession, path: str, schema: str = "build_id string, line_no long, ts timestamp, text string") -> DataFrame:
    """New log lines of a folder of JSON files as a stream."""
    return spark.readStream.schema(schema).json(path)
