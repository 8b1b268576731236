"""Build logs as events, and the rules that turn them into loci, loops, stalls and kills.

A log has ``build_id``, ``line_no``, ``t_s`` (seconds since the build began) and
``text``. A build may be of any length: what a window would carry through it
goes by blocks of its lines, or is cut to a few rows before it is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tryloom.functions.scalars import root_sessions  # noqa: F401  (part of the log vocabulary)
from tryloom.operators import ordered
from tryloom.operators.ordered import running_count, with_previous

# How the build tool words its lines.
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
PLAN = r"^Session\s+\S+/\S+"
SESSION = r"^(Building|Running)\s+(\S+)\b.*\.\.\.\s*$"
PHASE = r"^(Session |Building |Running )"
PROGRESS = r"^(\S+):\s+theory\s+(\S+?)(?:\s+(\d+)%)?(?:\s.*)?$"
DONE = r":\s+theory\s+\S+\s+100%"
LOOP = r'^\S+:\s+command\s+"(\S+)"\s+running\s+for\s+([\d.]+)s\s+\(line\s+(\d+)\s+of\s+theory\s+"([^"]+)"\)'
ERROR = r"^\*\*\*\s+(.*)"
AT_COMMAND = r'^\*\*\*\s+At command\s+"[^"]*"\s+\(line\s+(\d+)\s+of\s+"([^"]+)"\)'
TIMING = r"^Timing\s+(\S+)\s+\((\d+)\s+threads?,\s+([\d.]+)s\s+elapsed.*?([\d.]+)s\s+cpu"
ELAPSED = r"^(\d+):(\d\d):(\d\d) elapsed time"
#: Default budgets: idle, wall, warnings in a row, what startup may take longer, and the share of it worth a note.
ACTIVITY_S, WALL_S, LOOPS, STARTUP_EXTRA_S, STARTUP_SHARE = 20.0, 40.0, 3, 20.0, 0.25
#: Seconds of the window for the use of CPU, and the bounds of its verdicts.
CPU_WINDOW_S, STALLED, RUNNING = 15.0, 0.05, 0.9


def stripped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\x1b[")), F.regexp_replace(text, ANSI, "")).otherwise(text)


def events(log: DataFrame) -> DataFrame:
    """``log`` with ``kind`` and the fields of its line. Stateless, so a stream is read by the same code."""
    clean = log.withColumn("text", stripped(F.col("text")))
    t = F.col("text")
    is_ = lambda kind: F.col("kind") == kind
    # Each form holds some fixed words: a line without them is not searched. A field is read from lines of its kind alone.
    has = lambda words, p: F.contains(t, F.lit(words)) & t.rlike(p)
    some = lambda of, p, i: F.when(of, F.nullif(F.regexp_extract(t, p, i), F.lit("")))
    kind = (
        F.when(has("running", LOOP), "loop").when(has("***", AT_COMMAND), "locus").when(has("***", ERROR), "error").when(has("Session", PLAN), "plan")
        .when(has("...", SESSION), "session").when(has("Timing", TIMING), "timing").when(has("elapsed time", ELAPSED), "elapsed").when(has("theory", PROGRESS), "progress").otherwise("other")
    )
    return clean.withColumns({"kind": kind, "is_phase": t.rlike(PHASE)}).withColumns({
        "loop_theory": some(is_("loop"), LOOP, 4), "loop_line": some(is_("loop"), LOOP, 3), "loop_command": some(is_("loop"), LOOP, 1), "loop_elapsed": some(is_("loop"), LOOP, 2),
        "session": some(is_("session"), SESSION, 2), "verb": some(is_("session"), SESSION, 1),
        "theory": some(is_("progress"), PROGRESS, 2), "pct": some(is_("progress"), PROGRESS, 3).cast("int"),
        "error": some(F.col("kind").isin("error", "locus"), ERROR, 1), "locus_line": some(is_("locus"), AT_COMMAND, 1), "locus_theory": some(is_("locus"), AT_COMMAND, 2),
    })


def _by_line() -> Window:
    return Window.partitionBy("build_id").orderBy("line_no")


def loops(found: DataFrame) -> DataFrame:
    """``events`` with ``run``: how many warnings of the same place have come with no other line between."""
    return _with_runs(found).drop("_p")


def _with_runs(found: DataFrame) -> DataFrame:
    """``loops`` with the line before as ``_p``."""
    place = ["kind", "loop_theory", "loop_line", "loop_command"]
    rows = with_previous(found, [*place, *[c for c in ("t_s", "line_no") if c in found.columns]], "_p", "build_id", "line_no")
    is_loop = F.col("kind") == "loop"
    same = is_loop & F.coalesce((F.col("_p.kind") == "loop") & (F.struct(*[f"_p.{c}" for c in place[1:]]) == F.struct(*place[1:])), F.lit(False))
    fresh = running_count(rows.withColumn("_fresh", ~same), F.col("_fresh"), "_before", "build_id", "line_no")
    # A run's first line is fresh itself, so the run's number is one more than what came before it.
    island = F.col("_before") + F.col("_fresh").cast("long")
    nth = F.row_number().over(Window.partitionBy("build_id", "_island").orderBy("line_no"))
    return fresh.withColumn("_island", island).withColumn("run", F.when(is_loop, nth).otherwise(0)).drop("_fresh", "_before", "_island")


def kills(found: DataFrame, ends: DataFrame | None = None, activity: float = ACTIVITY_S, wall: float = WALL_S, threshold: int = LOOPS, load: float = 1.0) -> DataFrame:
    """The budget that each build breaks first: ``reason`` and ``at_s``; builds that break none have no row.

    A wall budget breaks when it has passed, a loop at the warning that completes it, an idle time when it
    has passed since the last line (with more before the first phase line). At equal times the order is wall,
    loop, activity. ``ends`` (``build_id``, ``end_s``) says how long a log was followed; else it ends at its last line.

    One pass over blocks of a build's lines leaves a row a block; these are folded in order, each with the last lines before it.
    """
    need = max(1, math.ceil(threshold * load))  # warnings of one place in a row
    short, long = activity * load, (activity + STARTUP_EXTRA_S) * load
    place = F.when(F.col("kind") == "loop", F.concat_ws("|", "loop_theory", "loop_line", "loop_command"))
    rows = found.select("build_id", "line_no", F.col("t_s").cast("double").alias("t_s"), F.coalesce("is_phase", F.lit(False)).alias("is_phase"), place.alias("place"), F.floor(F.col("line_no") / ordered.BLOCK).alias("block"))
    w = Window.partitionBy("build_id", "block").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    # the last places up to this line, and how many of them there are in the block
    lately = F.array(*[F.lag("place", k).over(w) for k in range(need - 1, 0, -1)], F.col("place"))
    rows = rows.withColumns({"n": F.row_number().over(w), "before_s": F.lag("t_s").over(w), "begun": F.coalesce(F.max("is_phase").over(upto), F.lit(False)), "lately": lately})
    repeats = F.col("place").isNotNull() & (F.col("n") >= need) & F.forall("lately", lambda p: F.coalesce(p == F.col("place"), F.lit(False)))
    gap = F.col("t_s") - F.col("before_s")
    idle = F.when(F.col("begun"), short).otherwise(long)
    head = F.when(F.col("n") < need, F.struct("n", "place", "t_s"))
    parts = rows.groupBy("build_id", "block").agg(
        F.min(F.when(gap >= idle, F.col("before_s") + idle)).alias("a"),
        F.min(F.when(gap >= short, F.col("before_s") + short)).alias("a_begun"),
        F.min(F.when(repeats, F.col("t_s"))).alias("l"),
        F.max("t_s").alias("end"),
        F.min_by("t_s", "line_no").alias("first_s"),
        F.max_by("t_s", "line_no").alias("last_s"),
        F.max("is_phase").alias("phase"),
        F.array_sort(F.collect_list(head)).alias("head"),
        F.max_by(F.struct("lately", "n"), "line_no").alias("tail"),
    )
    whole = parts.groupBy("build_id").agg(F.array_sort(F.collect_list(F.struct("block", *[c for c in parts.columns if c not in ("build_id", "block")]))).alias("blocks"))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("a"), none.alias("l"), none.alias("end"), none.alias("last_s"), F.lit(False).alias("phase"), F.array().cast("array<string>").alias("places"))

    def fold(acc: Column, b: Column) -> Column:
        since = F.when(acc["phase"], short).otherwise(long)
        waited = F.when(b["first_s"] - acc["last_s"] >= since, acc["last_s"] + since)
        both = F.concat(acc["places"], F.transform(b["head"], lambda x: x["place"]))
        at = F.size(acc["places"])

        def spans(x: Column) -> Column:
            last = F.slice(both, F.greatest(at + x["n"] - need + 1, F.lit(1)), F.lit(need))
            return x["place"].isNotNull() & (at + x["n"] >= need) & F.forall(last, lambda p: F.coalesce(p == x["place"], F.lit(False)))

        first = F.array_min(F.transform(F.filter(b["head"], spans), lambda x: x["t_s"]))
        own = F.slice(b["tail"]["lately"], F.greatest(need - b["tail"]["n"] + 1, F.lit(1)), F.lit(need))
        kept = F.concat(acc["places"], own)
        return F.struct(
            F.least(acc["a"], waited, F.when(acc["phase"], b["a_begun"]).otherwise(b["a"])).alias("a"),
            F.least(acc["l"], first, b["l"]).alias("l"),
            F.greatest(acc["end"], b["end"]).alias("end"),
            b["last_s"].alias("last_s"),
            (acc["phase"] | b["phase"]).alias("phase"),
            F.slice(kept, F.greatest(F.size(kept) - need + 2, F.lit(1)), F.lit(need - 1)).alias("places"),
        )

    per = whole.select("build_id", F.aggregate("blocks", start, fold).alias("s")).select("build_id", "s.a", "s.l", "s.end", "s.last_s", "s.phase")
    if ends is not None:
        since = F.when(F.col("phase"), short).otherwise(long)
        open_ = F.when(F.col("end_s") - F.col("last_s") >= since, F.col("last_s") + since)
        per = per.join(ends, "build_id", "left").withColumns({"a": F.least("a", open_), "end": F.greatest("end", "end_s")})
    trigger = lambda at, rank, name: F.when(at.isNotNull(), F.struct(at.cast("double").alias("at_s"), F.lit(rank).alias("rank"), F.lit(name).alias("reason")))
    over = F.when(F.col("end") >= wall * load, F.lit(wall * load))
    least = F.array_min(F.array_compact(F.array(trigger(over, 0, "wall"), trigger(F.col("l"), 1, "loop_progress"), trigger(F.col("a"), 2, "activity"))))
    return per.select("build_id", least["reason"].alias("reason"), least["at_s"].alias("at_s")).where("reason IS NOT NULL")


def session_timeline(found: DataFrame, all_heaps: Column | None = None) -> DataFrame:
    """``sessions`` of each build: first start and role; empty if a plan was seen but no session, else null.

    Roles are null where ``all_heaps`` (of ``events``) says that every session stores one.
    """
    return _told(found, all_heaps).select("build_id", "sessions")


def _told(found: DataFrame, all_heaps: Column | None = None) -> DataFrame:
    """``sessions`` of each build, the last place warned of (``loop_theory`` and so on) and the theory last seen (``_stuck``), in one pass.

    The lines of a build are first grouped by session, so that a session's lines are never gathered.
    """
    role = F.when(F.col("verb") == "Building", "dependency").otherwise("target")
    if all_heaps is not None:
        role = F.when(~all_heaps, role)
    place = ["loop_theory", "loop_line", "loop_command", "loop_elapsed"]
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    parts = found.groupBy("build_id", "session").agg(
        F.min(of("session", F.struct("line_no", F.round("t_s", 1).alias("started_s"), role.alias("role")))).alias("s"),
        F.bool_or(F.col("kind") == "plan").alias("plan"),
        F.max(of("loop", F.struct("line_no", *place))).alias("k"),
        F.max(F.when(F.col("theory").isNotNull(), F.struct("line_no", "theory"))).alias("t"),
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s.line_no", F.col("session").alias("name"), "s.role", "s.started_s"))))
    rows = parts.groupBy("build_id").agg(listed.alias("_s"), F.bool_or("plan").alias("_plan"), F.max("k").alias("_k"), F.max("t").alias("_t"))
    out = F.transform("_s", lambda x: F.struct(x["name"].alias("name"), x["role"].alias("role"), x["started_s"].cast("double").alias("started_s")))
    sessions = F.when((F.size("_s") > 0) | F.col("_plan"), out)
    return rows.select("build_id", sessions.alias("sessions"), *[F.col(f"_k.{c}").alias(c) for c in place], F.col("_t.theory").alias("_stuck"))


def last_progress(found: DataFrame) -> DataFrame:
    """The latest theory below 100 %."""
    rows = found.where("pct IS NOT NULL AND pct <> 100")
    return rows.groupBy("build_id").agg(F.max_by(F.struct("theory", "pct"), "line_no").alias("p")).select("build_id", "p.*")


def last_loop_key(found: DataFrame) -> DataFrame:
    """The last place warned of, whatever came after it."""
    rows = found.where("kind = 'loop'")
    return rows.groupBy("build_id").agg(F.max_by(F.struct("loop_theory", "loop_line", "loop_command", "loop_elapsed"), "line_no").alias("k")).select("build_id", "k.*")


def _first_lines(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` lines of each build with the least numbers, as ``_n``: first of its blocks of lines, then of what these leave."""
    block = F.floor(F.col("line_no") / ordered.BLOCK)
    near = rows.withColumn("_b", block).withColumn("_n", F.row_number().over(Window.partitionBy("build_id", "_b").orderBy("line_no"))).where(F.col("_n") <= most)
    return near.drop("_b", "_n").withColumn("_n", F.row_number().over(_by_line())).where(F.col("_n") <= most)


def error_heads(found: DataFrame) -> DataFrame:
    """The first two non-blank error lines, joined."""
    rows = _first_lines(found.where("trim(error) <> ''").select("build_id", "line_no", "error"), 2)
    return rows.groupBy("build_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.trim("error").alias("e")))), lambda x: x["e"]), " | ").alias("error_head"))


def error_loci(found: DataFrame) -> DataFrame:
    """Distinct loci of each build in order of appearance, and how many."""
    first = found.where("kind = 'locus'").groupBy("build_id", "locus_theory", "locus_line").agg(F.min("line_no").alias("at"))
    return first.groupBy("build_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "locus_theory", "locus_line"))), lambda x: F.array(x["locus_theory"], x["locus_line"])).alias("error_loci"), F.count("*").alias("n_loci"))


def failure_block(found: DataFrame, most: int = 6) -> DataFrame:
    """The first run of error lines, its first non-blank ones."""
    error = F.startswith("text", F.lit("***"))
    first = found.where(error).groupBy("build_id").agg(F.min("line_no").alias("_from"))
    after = found.where(~error).join(first, "build_id").where("line_no > _from").groupBy("build_id").agg(F.min("line_no").alias("_to"))
    run = found.where(error & (F.trim("error") != "")).join(first, "build_id").join(after, "build_id", "left").where("_to IS NULL OR line_no < _to")
    cut = _first_lines(run.select("build_id", "line_no", "error"), most)
    return cut.groupBy("build_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "error"))), lambda x: x["error"]), "\n").alias("block"))


def success_summary(log: DataFrame) -> DataFrame:
    """Theories at 100 %, and seconds elapsed and of CPU: of the last timing line, else of the total."""
    t = F.col("text")
    timing = F.when(t.rlike(TIMING), F.struct(F.regexp_extract(t, TIMING, 3).cast("double").alias("elapsed"), F.regexp_extract(t, TIMING, 4).cast("double").alias("cpu")))
    h, m, s = (F.regexp_extract(t, ELAPSED, i).try_cast("double") for i in (1, 2, 3))
    total = F.when(t.rlike(ELAPSED), h * 3600 + m * 60 + s)
    at = lambda c: F.when(c.isNotNull(), F.col("line_no"))
    rows = log.groupBy("build_id").agg(F.count_if(t.rlike(DONE)).alias("theories"), F.max_by(timing, at(timing)).alias("_t"), F.max_by(total, at(total)).alias("_e"))
    return rows.select("build_id", "theories", F.coalesce("_t.elapsed", "_e").alias("elapsed_s"), F.col("_t.cpu").alias("cpu_s"))


def timeout_head(reason: Column, command: Column, line: Column, theory: Column, seconds: Column, wall: Column) -> Column:
    named = F.concat(reason, F.lit(': "'), command, F.lit('" line '), line, F.lit(" of "), theory, F.lit(" ("), seconds, F.lit("s)"))
    return F.when(theory.isNotNull(), named).otherwise(F.concat(reason, F.lit(" timeout ("), wall.cast("int").cast("string"), F.lit("s wall)")))


def session_of(theory: Column) -> Column:
    """The session that a theory's qualifier names, empty without one."""
    return F.when(F.contains(theory, F.lit(".")), F.substring_index(theory, ".", 1)).otherwise(F.lit(""))


def budget_note(sessions: Column, stuck: Column) -> Column:
    """Where a budget went: into the dependency it is stuck in, or into those rebuilt first."""
    deps = F.transform(F.filter(sessions, lambda s: s["role"] == "dependency"), lambda s: s["name"])
    return F.when(F.array_contains(deps, stuck), F.concat(F.lit("stuck in dependency "), stuck)).when(F.size(deps) > 0, F.concat(F.lit("rebuilt first: "), F.array_join(deps, ", "))).otherwise("")


def startup_note(sessions: Column, wall: Column) -> Column:
    """A note where the first session began after a share of the wall budget."""
    begun = F.get(sessions, F.lit(0))["started_s"]
    return F.when((wall > 0) & (begun >= wall * STARTUP_SHARE), F.concat(begun.cast("string"), F.lit("s before "), F.get(sessions, F.lit(0))["name"], F.lit(" started"))).otherwise("")


def contention_note(verdict: Column, duty: Column, cpu: Column, elapsed: Column, window: float = CPU_WINDOW_S) -> Column:
    used = F.when(cpu.isNotNull(), F.concat(F.lit(", "), cpu.cast("string"), F.lit("s of CPU in "), F.round(elapsed).cast("int").cast("string"), F.lit("s"))).otherwise("")
    return F.when((verdict == "starved") & duty.isNotNull(), F.concat(F.lit("contended: "), F.round(duty, 2).cast("string"), F.lit(" of a core"))).when(verdict == "stalled", F.concat(F.lit(f"no CPU in the last {window:g}s"), used)).otherwise("")


def stuck_locus(theory: Column, line: Column, reason: Column) -> Column:
    """The last place warned of. A wall kill says only that it was last there."""
    return F.when(theory.isNotNull(), F.concat(F.when(reason == "wall", "last at ").otherwise("stuck at "), theory, F.lit(" line "), line)).otherwise("")


def timeout_class(reason: Column) -> Column:
    return F.when(reason == "loop_progress", "LOOP").when(reason == "wall", "TIMEOUT").when(reason == "activity", "STUCK")


def timeout_text(reason: Column, key: Column, count: Column, wall: Column, idle: Column, progress: Column, notes: Column) -> Column:
    """What is said of a kill. ``key`` has the last place warned of (``loop_theory`` and so on), ``progress`` a theory and its ``pct``; either may be null.

    Only a completed loop is called one; the other kills say where the last warning was. The wording is
    fixed values: readers of records match it. ``explained`` has the same as columns.
    """
    last = lambda comma: F.concat(F.lit(' (last: "'), key["loop_command"], F.lit('" at '), key["loop_theory"], F.lit(" line "), key["loop_line"], F.lit(comma), key["loop_elapsed"], F.lit("s)"))
    tail = F.when(F.size(notes) > 0, F.concat(F.lit("  ("), F.array_join(notes, "; "), F.lit(")"))).otherwise("")
    known = key["loop_theory"].isNotNull()
    loop = F.concat(key["loop_theory"], F.lit(': "'), key["loop_command"], F.lit('" looping on line '), key["loop_line"], F.lit(" ("), count.cast("string"), F.lit("x same line, last "), key["loop_elapsed"], F.lit("s elapsed)"))
    stuck = F.concat(F.coalesce(F.concat(progress["theory"], F.lit(" "), progress["pct"].cast("string"), F.lit("%  ")), F.lit("")), F.lit("no output for "), idle.cast("string"), F.lit("s"), F.when(known, last(", ")).otherwise(""))
    timeout = F.concat(wall.cast("string"), F.lit("s wall clock exceeded"), F.when(known, last(", ")).otherwise(""))
    text = F.when((reason == "loop_progress") & known, loop).when(reason == "wall", timeout).when(reason == "activity", stuck)
    return F.concat(timeout_class(reason), F.lit("  "), text, tail)


def assembled(found: DataFrame, outcomes: DataFrame, **budgets: float) -> DataFrame:
    """One record a build: outcome from its exit code (``build_id``, ``exit_code``) and the budget it broke."""
    killed = kills(found, **budgets)
    rows = outcomes.join(killed, "build_id", "left").join(error_heads(found), "build_id", "left").join(error_loci(found), "build_id", "left").join(_told(found).drop("_stuck"), "build_id", "left")
    outcome = F.when(F.col("reason").isNotNull(), "timeout").when(F.col("exit_code") == 0, "ok").otherwise("fail")
    head = F.when(F.col("reason").isNotNull(), timeout_head(F.col("reason"), F.col("loop_command"), F.col("loop_line"), F.col("loop_theory"), F.col("loop_elapsed"), F.lit(budgets.get("wall", WALL_S)))).otherwise(F.col("error_head"))
    return rows.select("build_id", outcome.alias("outcome"), F.when(F.col("reason").isNotNull(), 124).otherwise(F.col("exit_code")).alias("exit_code"), F.col("reason").alias("timeout_reason"), head.alias("error_head"), "error_loci", "sessions")


#: Seconds of a build's samples in a block.
SAMPLES_S = 4 * 3600.0


def _samples_block(seconds: float) -> Column:
    return F.floor(F.col("t_s") / seconds)


def _so_far(rows: DataFrame, keys: list[str], value: str, how, join, seconds: float) -> DataFrame:
    """``rows`` with ``value`` replaced by ``how`` of it over all rows of ``keys`` up to this time: in blocks, and carried over them from one row a block."""
    blocks = rows.withColumn("_block", _samples_block(seconds))
    inside = Window.partitionBy(*keys, "_block").orderBy("t_s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.groupBy(*keys, "_block").agg(how(value).alias("_v")).withColumn("_v", how("_v").over(before))
    near = blocks.withColumn(value, how(value).over(inside)).join(carried, [*keys, "_block"])
    return near.withColumn(value, F.when(F.col("_v").isNull(), F.col(value)).otherwise(join(F.col(value), F.col("_v")))).drop("_v", "_block")


def explained(found: DataFrame, killed: DataFrame, wall: float = WALL_S, all_heaps: Column | None = None, duty: DataFrame | None = None) -> DataFrame:
    """What is known of each kill (``build_id``, ``reason``, ``at_s``), as columns.

    ``class``, the last place warned of (``theory``, ``line``, ``command``,
    ``seconds``), the ``locus`` and the ``notes``: where the budget went, what
    startup took of it, and whether the machine was busy, which needs ``duty``
    (``build_id``, ``duty``, ``cpu_s``) at the time of the kill.
    """
    rows = killed.join(_told(found, all_heaps), "build_id", "left")
    rows = rows.join(duty.select("build_id", "duty", "cpu_s"), "build_id", "left") if duty is not None else rows.withColumns({c: F.lit(None).cast("double") for c in ("duty", "cpu_s")})
    within = session_of(F.coalesce("loop_theory", "_stuck"))
    busy = contention_note(F.when(F.col("duty").isNotNull(), contention(F.col("duty"))["verdict"]), F.col("duty"), F.col("cpu_s"), F.col("at_s"))
    notes = F.array(*[F.coalesce(n, F.lit("")) for n in (budget_note(F.col("sessions"), within), startup_note(F.col("sessions"), F.lit(wall)), busy)])
    return rows.select(
        "build_id", "reason", "at_s", timeout_class(F.col("reason")).alias("class"), F.col("loop_theory").alias("theory"), F.col("loop_line").alias("line"), F.col("loop_command").alias("command"), F.col("loop_elapsed").cast("double").alias("seconds"),
        stuck_locus(F.col("loop_theory"), F.col("loop_line"), F.col("reason")).alias("locus"), F.filter(notes, lambda n: n != "").alias("notes"),
    )


def cumulative_cpu(samples: DataFrame, block_s: float = SAMPLES_S) -> DataFrame:
    """``build_id``, ``t_s`` and ``cpu_s``: CPU of the whole tree so far.

    Of each process the most it has shown; one that is gone keeps what it had. A task holds a block of a build's time.
    """
    shown = samples.groupBy("build_id", "pid", "t_s").agg(F.max("cpu_s").alias("cpu_s"))
    most = _so_far(shown, ["build_id", "pid"], "cpu_s", F.max, F.greatest, block_s)
    # What each process adds at each sample; their running sum is the tree's. Only a block's first sample needs the block before.
    rows = most.withColumn("_block", _samples_block(block_s))
    w = Window.partitionBy("build_id", "pid", "_block").orderBy("t_s")
    edges = rows.groupBy("build_id", "pid", "_block").agg(F.max("cpu_s").alias("_e")).withColumn("_e", F.lag("_e").over(Window.partitionBy("build_id", "pid").orderBy("_block")))
    grown = rows.withColumn("_l", F.lag("cpu_s").over(w)).join(edges, ["build_id", "pid", "_block"])
    per = grown.groupBy("build_id", "t_s").agg(F.sum(F.col("cpu_s") - F.coalesce("_l", "_e", F.lit(0.0))).alias("cpu_s"))
    return _so_far(per, ["build_id"], "cpu_s", F.sum, lambda own, carried: own + carried, block_s)


def duty_cycles(cpu: DataFrame, window: float = CPU_WINDOW_S, least_span: float = 5.0, block_s: float = SAMPLES_S) -> DataFrame:
    """``duty``: cores used over a trailing window; null with one sample, a short span or a falling count.

    Blocks of a build's time overlap: each is given what the window of its first sample reaches back to.
    """
    block_s = max(block_s, window)
    own = _samples_block(block_s)
    # a row within a window of the next block's begin goes there too
    next_ = F.when(F.col("t_s") + int(window) >= (own + 1) * block_s, own + 1)
    rows = cpu.withColumn("_own", own).withColumn("_block", F.explode(F.array_compact(F.array(own, next_))))
    w = Window.partitionBy("build_id", "_block").orderBy("t_s").rangeBetween(-int(window), 0)
    c0, t0, n = F.first("cpu_s").over(w), F.first("t_s").over(w), F.count("*").over(w)
    rows = rows.withColumns({"_c0": c0, "_t0": t0, "_n": n}).where("_own = _block")
    span = F.col("t_s") - F.col("_t0")
    good = (F.col("_n") >= 2) & (span >= least_span) & (F.col("cpu_s") >= F.col("_c0"))
    return rows.withColumn("duty", F.when(good, (F.col("cpu_s") - F.col("_c0")) / span)).drop("_c0", "_t0", "_n", "_own", "_block")


def contention(duty: Column, cap: float = 4.0) -> Column:
    """A struct of ``verdict`` and the ``load_factor`` that budgets are stretched by."""
    verdict = F.when(duty.isNull(), "unknown").when(duty < STALLED, "stalled").when(duty >= RUNNING, "running").otherwise("starved")
    return F.struct(verdict.alias("verdict"), F.when(verdict == "starved", F.least(F.lit(cap), 1 / duty)).otherwise(F.lit(1.0)).alias("load_factor"))
