"""The attempts table: explicit types, so that absent fields are null and never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fields of one record and their types.
FIELDS = {
    "build_id": "string", "instance_id": "string", "writer_version": "string", "timestamp": "string", "branch": "string", "hostname": "string",
    "contributor": "string", "origin_url": "string", "command": "array<string>", "outcome": "string", "exit_code": "int", "timeout_reason": "string",
    "elapsed_s": "double", "elapsed_s_ac": "double", "battery_factor": "double", "power": "string", "error_head": "string",
    "error_loci": "array<array<string>>", "limits": "map<string,double>",
    "contention": "struct<cpu_time_s:double,duty_cycle:double,verdict:string,load_factor_applied:double>",
    "sessions": "array<struct<name:string,role:string,started_s:double>>", "git_head": "string", "tree": "string", "head_dirty": "boolean",
    "diff": "string", "other_changed": "array<array<string>>", "note": "string", "note_source": "string", "note_predicted": "string",
    "note_fields": "map<string,string>", "note_pre_build": "boolean", "note_age_s": "double", "note_lint": "array<string>", "log": "string",
    "backfilled": "boolean", "diff_repaired": "string", "snapshot": "string", "parent_snapshot": "string",
}

#: One JSON line of a corpus.
RECORD = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())

#: What loci are in derived tables.
LOCI = "array<struct<theory:string,line:int>>"


def conform(df: DataFrame) -> DataFrame:
    """``df`` with every field of a record; those it lacks are null."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in FIELDS.items() if name not in df.columns})
