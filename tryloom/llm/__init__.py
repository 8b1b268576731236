"""Operations of a training-data pipeline, one module each.

``queries()`` and ``oracle_sql()`` are what the repository's entry module
registers. Nothing outside this package imports it.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module that defines a function of that name.
_MODULES = {
    "op1_byte_bpe": "bpe_codec",
    "op2_language_id": "language_id",
    "op3_near_dups": "near_dups",
    "op4_ann": "ann",
    "op5_media": "media",
    "op6_secret_scan": "secrets",
    "op7_packing": "packing",
    "op8_pii": "pii",
    "op9_chat_format": "chat_format",
    "op10_token_counts": "token_counts",
    "op11_runs": "runs",
    "op12_prefix_trie": "prefix_trie",
    "op13_warc": "warc",
    "page_sequences": "media",
}


def _lazy(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(importlib.import_module(f"{__name__}.{module}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _lazy(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    found = {}
    for name, module in _MODULES.items():
        sql = getattr(importlib.import_module(f"{__name__}.{module}"), "ORACLE_SQL", None)
        sql = sql.get(name) if isinstance(sql, dict) else sql
        if sql:
            found[name] = sql
    return found
