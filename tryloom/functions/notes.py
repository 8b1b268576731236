"""Notes written before a build: their sections, prediction and format."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tryloom.functions.scalars import bound

# The sections of a note and how one begins.
KEYS = ("diagnosis", "change", "expect", "ref")
_INLINE = r"(?i)(?:;[ \t]*|\.[ \t]+)(?=(?:diagnosis|change|expect|ref)[ \t]*:)"
_KEY = r"^\s*[-*#]{0,3}\s*([A-Za-z_]+)\s*:\s*(.*)$"
_ANYWHERE = r"(?i)\b(diagnosis|change|expect|ref)[ \t]*:"
_OUTCOME = r"(?i)^\W*(ok|fail|timeout)\b"


def note_lines(note: Column) -> Column:
    return F.split(F.regexp_replace(note, _INLINE, "\n"), "\r\n|[\n\r]", -1)


def parse(note: Column) -> Column:
    """Sections of a note as a map; text before the first key goes to ``notes``; null if nothing is left.

    A section that is opened again replaces the earlier one.
    """
    names = (*KEYS, "notes")
    blank = F.struct(F.lit("notes").alias("key"), *[F.lit(None).cast("string").alias(n) for n in names])

    def read(line: Column) -> Column:
        """A line with the section that it opens, if any: a key is sought once, and only where there is a colon."""
        word = F.when(F.contains(line, F.lit(":")), F.lower(F.regexp_extract(line, _KEY, 1))).otherwise("")
        value = lambda w: F.when(w.isin(*KEYS), F.regexp_extract(line, _KEY, 2)).otherwise(line)
        return bound(word, lambda w: F.struct(F.when(w.isin(*KEYS), w).alias("opens"), value(w).alias("text")))

    def step(acc: Column, line: Column) -> Column:
        opens = line["opens"].isNotNull()
        key = F.coalesce(line["opens"], acc["key"])
        value = lambda n: F.when(key != n, acc[n]).when(opens | acc[n].isNull(), line["text"]).otherwise(F.concat(acc[n], F.lit("\n"), line["text"]))
        return F.struct(key.alias("key"), *[value(n).alias(n) for n in names])

    clean = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    done = lambda acc: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), clean(acc[n]).alias("value")) for n in names]), lambda e: e["value"].isNotNull() & (e["value"] != "")))
    found = F.aggregate(F.transform(note_lines(note), read), blank, step, done)
    return bound(found, lambda f: F.when(F.size(f) > 0, f))


def predicted(fields: Column) -> Column:
    """The outcome that ``expect`` opens with, lower-cased."""
    return F.lower(F.nullif(F.regexp_extract(F.element_at(fields, "expect"), _OUTCOME, 1), F.lit("")))


def _nearest(words: pd.Series) -> pd.Series:
    return words.map(lambda w: next(iter(difflib.get_close_matches(w, KEYS, 1, 0.6)), None))


def near_misses(notes: DataFrame) -> DataFrame:
    """``word`` and ``meant``: keys that are none, and the section each probably means.

    Python sees the distinct words only.
    """
    words = notes.select(F.explode(F.transform(note_lines(F.col("note")), lambda ln: F.lower(F.regexp_extract(ln, _KEY, 1)))).alias("word"))
    unknown = words.where((F.col("word") != "") & ~F.col("word").isin(*KEYS)).distinct()
    return unknown.withColumn("meant", F.pandas_udf(_nearest, StringType())("word")).where("meant IS NOT NULL")


def lint(note: Column) -> Column:
    """Complaints that need the note alone: ``stranded``, ``no_section``, ``unscored``, ``no_expect``."""
    fields = F.coalesce(parse(note), F.create_map().cast("map<string,string>"))

    def told(note: Column, fields: Column, have: Column) -> Column:
        named = F.when(F.contains(note, F.lit(":")), F.regexp_extract_all(note, F.lit(_ANYWHERE), F.lit(1))).when(note.isNotNull(), F.array().cast("array<string>"))
        return bound(F.array_except(F.array_distinct(F.transform(named, F.lower)), have), lambda stranded: complaints(fields, have, stranded))

    def complaints(fields: Column, have: Column, stranded: Column) -> Column:
        seen = F.size(F.array_intersect(have, F.array(*map(F.lit, KEYS)))) > 0
        some, expect = F.size(stranded) > 0, F.array_contains(have, "expect")
        return F.array_compact(F.array(
            F.when(some, "stranded"),
            F.when(~some & ~seen, "no_section"),
            F.when(expect & predicted(fields).isNull(), "unscored"),
            F.when(~expect & seen & ~F.array_contains(stranded, "expect"), "no_expect"),
        ))

    # A note is read once, however often its parts are asked for.
    return bound(F.struct(note.alias("note"), fields.alias("fields")), lambda n: bound(F.map_keys(n["fields"]), lambda have: told(n["note"], n["fields"], have)))
