"""From raw documents to packed training sequences, in four stages.

Each stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``.

Cases: null texts and texts without a letter are rejected by the first stage; a
document without an id stays, is compared with none and packed like others;
repeated rows of an id become one; texts are taken whole at any length; an
empty table gives no pieces; other columns are carried along whatever their
names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tryloom.llm import language_id, near_dups, packing, secrets
from tryloom.llm.shared import fresh, table, written
from tryloom.llm.textspans import replaced

def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language: null, empty or without a letter. Mixtures of languages stay."""
    model = language_id.fit(docs.where(~language_id.is_held_out()))
    into = tuple(fresh(docs, name) for name in ("lang_pred", "score", "lang_spans"))
    found = language_id.language_id(docs, model, docs.columns, with_spans=False, into=into)
    return found.where(F.col(into[0]) != "und").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dups.first_of_each(docs, words=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its kind in brackets and corrects the length."""
    into = fresh(docs, "secrets")
    found = secrets.secret_spans(docs, into=into).withColumn("text", replaced(F.col("text"), secrets.all_spans(column=into)))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", length).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the token ids of all texts into sequences of 4096."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2)


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("secret_scan", redact), ("packing", pack)]

#: Tokenizing and MinHash have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
