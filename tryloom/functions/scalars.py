"""Small column expressions: versions, text, budgets, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def release(version: Column) -> Column:
    """The leading numbers of a version as four integers, null if there are none.

    The numbers must end at a character that continues no number.
    """
    text = F.regexp_extract(version, r"^(\d+(?:\.\d+)*)(?:[^\d]|$)", 1)
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("int"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)
    return F.when(text != "", padded)


def writer_at_least(version: Column, least: str) -> Column:
    """Whether a writer's release is ``least`` or later; unknown is not."""
    return F.coalesce(release(version) >= release(F.lit(least)), F.lit(False))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def day(timestamp: Column) -> Column:
    """The first ten characters of a timestamp as text."""
    return F.substring(timestamp.cast("string"), 1, 10)


def budget(configured: Column, battery_factor: Column, load_factor: Column) -> Column:
    """A budget with what the machine's state allows for."""
    return configured * F.coalesce(battery_factor, F.lit(1.0)) * F.coalesce(load_factor, F.lit(1.0))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, by a rational approximation (relative error below 1.2e-7)."""
    # Coefficients of the Chebyshev fit, highest power first.
    coefficients = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(coefficients[0])
    for c in coefficients[1:]:
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def two_proportions(x_a: Column, n_a: Column, x_b: Column, n_b: Column) -> tuple[Column, Column]:
    """z and two-sided p of a difference of rates with pooled error; null if the error is 0."""
    pool = (x_a + x_b) / (n_a + n_b)
    error = F.sqrt(pool * (1 - pool) * (1 / n_a + 1 / n_b))
    z = F.when(error > 0, (x_a / n_a - x_b / n_b) / error)
    return z, erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def cpu_seconds(text: Column) -> Column:
    """Seconds of ``[[DD-]HH:]MM:SS[.ss]``; what does not parse is null."""
    ok = text.rlike(r"^(?:(?:\d+-)?\d+:)?\d+:\d+(?:\.\d+)?$")
    days = F.coalesce(F.nullif(F.regexp_extract(text, r"^(\d+)-", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    parts = F.split(F.regexp_replace(text, r"^\d+-", ""), ":")
    clock = F.aggregate(F.transform(parts, lambda p: p.try_cast("double")), F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when(ok, days * 86400 + clock)


def root_sessions(text: Column) -> Column:
    """Sessions that stanzas of a ROOT text declare; comments are hidden and names may be quoted."""
    bare = F.regexp_replace(text, r"(?s)\(\*.*?\*\)", " ")
    pattern = r'(?m)^\s*session\s+(?:"([^"]+)"|([A-Za-z0-9_\-]+))'
    quoted, plain = (F.regexp_extract_all(bare, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.filter(F.zip_with(quoted, plain, lambda q, p: F.when(q != "", q).otherwise(p)), lambda n: n != "")


def root_parents(text: Column) -> Column:
    """``child`` and ``parent`` of the stanzas of a ROOT text that extend another session; sessions without a parent are left out."""
    bare = F.regexp_replace(text, r"(?s)\(\*.*?\*\)", " ")
    name = r'(?:"([^"]+)"|([A-Za-z0-9_\-]+))'
    pattern = rf'(?m)^\s*session\s+{name}\s*(?:\([^)]*\))?\s*(?:in\s+(?:"[^"]*"|\S+))?\s*=\s*{name}\s*\+'
    found = [F.regexp_extract_all(bare, F.lit(pattern), F.lit(i)) for i in (1, 2, 3, 4)]
    either = lambda a, b: F.zip_with(a, b, lambda q, p: F.when(q != "", q).otherwise(p))
    return F.zip_with(either(found[0], found[1]), either(found[2], found[3]), lambda c, p: F.struct(c.alias("child"), p.alias("parent")))
