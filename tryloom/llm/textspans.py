"""Positions of regular-expression matches as native column expressions.

Spark extracts matches without their positions. Splitting at the same pattern
gives the text between them, so running sums of both lengths give each match's
place in code points. Running values are worked out by doubling strides, so a
text's time grows with its matches times their logarithm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<struct<start:int,end:int,text:string,gap:string>>"
#: Characters in a piece of a text that is cut by position.
PIECE = 1024


def no_matches() -> Column:
    return F.array().cast(_NONE)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with all before it; ``join`` is associative."""

    def step(acc: Column, stride: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= stride, join(F.get(acc, i - stride), x)).otherwise(x))

    strides = F.array(*[F.lit(1 << k) for k in range(31)])
    return bound(values, lambda all_: F.aggregate(F.filter(strides, lambda s: s < F.size(all_)), all_, step))


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches: start, end (exclusive), text, and the text since the last match.

    ``guard`` is a cheap condition without which the text has no match.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(gaps, found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("text"), (F.length(gap) + F.length(m)).alias("wide"))), lambda x: x["text"].isNotNull())

    def place(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda x: x["wide"]), lambda a, b: a + b)
        return F.zip_with(all_, ends, lambda x, end: F.struct((end - F.length(x["text"])).alias("start"), end.alias("end"), x["text"].alias("text"), x["gap"].alias("gap")))

    return F.when(text.rlike(pattern) if guard is None else guard & text.rlike(pattern), bound(pairs, place)).otherwise(no_matches())


def placed(spans: Column, rank: int, kind: str) -> Column:
    """Spans as sortable structs: by start, then rank."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` of a text cut into pieces of ``PIECE`` characters."""
    first = (start / PIECE).cast("int")
    some = F.array_join(F.slice(pieces, first + 1, F.greatest(((end - 1) / PIECE).cast("int") - first + 1, F.lit(1))), "")
    return F.when(end > start, F.substring(some, start - first * PIECE + 1, end - start)).otherwise("")


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with every span of ``spans`` (structs as ``placed`` gives them) replaced by its kind in brackets.

    A span that begins inside an earlier one extends it instead of being replaced itself.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(held: Column) -> Column:
        own = held["own"]
        # how far the spans before each one reach
        reach = running(F.transform(own, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        marked = F.zip_with(own, F.concat(F.array(F.lit(0)), reach), lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at")))
        # the last one stands for the text's end, the others for spans that begin outside of earlier ones
        fresh = F.filter(marked, lambda s: s["kind"].isNull() | (s["start"] >= s["at"]))
        size = F.length(text)
        parts = F.transform(fresh, lambda s: F.concat(between(held["pieces"], s["at"], F.coalesce(s["start"], size)), F.when(s["kind"].isNull(), "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))))
        return F.array_join(parts, "")

    return F.when(F.size(spans) == 0, text).otherwise(bound(F.struct(F.array_sort(spans).alias("own"), pieces.alias("pieces")), cut))
