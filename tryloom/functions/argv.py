"""What a build command's arguments say, as folds over the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Options of the build command.
#: Options that take the next argument, for lenient reading.
TAKES_NEXT = ("-d", "-o", "-j", "-l", "-x", "-B", "-D", "-N", "-P", "-S")
#: One-letter options with a value, and flags, for strict reading.
VALUE_LETTERS, FLAG_LETTERS = "ABDHPXdgjox", "NRSabceflnv"

_STRINGS = "array<string>"


def _lenient(command: Column) -> Column:
    """A struct of ``dirs`` (values of ``-d``) and ``targets`` (positional arguments)."""
    start = F.struct(F.lit("").alias("want"), F.array().cast(_STRINGS).alias("dirs"), F.array().cast(_STRINGS).alias("targets"))

    def step(acc: Column, arg: Column) -> Column:
        value = acc["want"] != ""
        option = arg.isin(*TAKES_NEXT)
        plain = ~value & ~option & ~F.startswith(arg, F.lit("-")) & ~arg.isin("isabelle", "build")
        return F.struct(
            F.when(~value & option, arg).otherwise("").alias("want"),
            F.when(acc["want"] == "-d", F.array_append(acc["dirs"], F.regexp_replace(arg, "^/+|/+$", ""))).otherwise(acc["dirs"]).alias("dirs"),
            F.when(plain, F.array_append(acc["targets"], arg)).otherwise(acc["targets"]).alias("targets"),
        )

    return F.aggregate(F.coalesce(command, F.array().cast(_STRINGS)), start, step)


def load_dirs(command: Column) -> Column:
    """Where sessions are loaded from: the values of ``-d``, without slashes at their ends."""
    return _lenient(command)["dirs"]


def targets(command: Column) -> Column:
    """Sessions named on the command."""
    return _lenient(command)["targets"]


def build_options(command: Column) -> Column:
    """``flags`` (letters) and ``sessions``, read strictly after ``build``.

    Flags bundle, values may be attached, and the first positional argument or
    ``--`` ends the options.
    """
    args = F.coalesce(command, F.array().cast(_STRINGS))
    at = F.array_position(args, "build").cast("int")
    rest = F.when(at > 0, F.slice(args, at + 1, F.greatest(F.size(args) - at, F.lit(0)))).otherwise(F.array().cast(_STRINGS))
    start = F.struct(F.lit("options").alias("mode"), F.array().cast(_STRINGS).alias("flags"), F.array().cast(_STRINGS).alias("sessions"))
    bundle = f"^-([{FLAG_LETTERS}]*)"

    def step(acc: Column, arg: Column) -> Column:
        options = acc["mode"] == "options"
        ends = options & (arg == "--")
        positional = (acc["mode"] == "sessions") | (options & ~ends & ((F.length(arg) < 2) | ~F.startswith(arg, F.lit("-"))))
        option = options & ~ends & ~positional
        letters = F.filter(F.split(F.regexp_extract(arg, bundle, 1), ""), lambda c: c != "")
        bare = option & arg.rlike(f"^-[{FLAG_LETTERS}]*[{VALUE_LETTERS}]$")
        return F.struct(
            F.when(ends | positional, "sessions").when(bare, "value").otherwise("options").alias("mode"),
            F.when(option, F.array_union(acc["flags"], letters)).otherwise(acc["flags"]).alias("flags"),
            F.when(positional, F.array_append(acc["sessions"], arg)).otherwise(acc["sessions"]).alias("sessions"),
        )

    return F.aggregate(rest, start, step, lambda acc: F.struct(acc["flags"].alias("flags"), acc["sessions"].alias("sessions")))


def stores_all_heaps(command: Column) -> Column:
    return F.array_contains(build_options(command)["flags"], "b")
