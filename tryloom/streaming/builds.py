"""Live build logs: the rules of ``operators.logs`` over a stream of lines.

Each build is one key. Lines carry event time; a watermark says how late one may
be. Lines are applied in the order of their numbers, however they fall into
batches: one that comes early is held until those before it are there, or until
the watermark has passed it, after which they can only be late. A number that was
applied or is held already is a repetition and counts once. Time must not fall
with the line's number. ``gate`` counts the lines that come too late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tryloom.operators.logs import ACTIVITY_S, LOOPS, STARTUP_EXTRA_S, WALL_S, events
from tryloom.streaming.cpu import cpu_windows, tree_cpu  # noqa: F401  (part of what is watched of a build)

WATERMARK = "1 minute"
_FIELDS = ("start", "last", "next", "phase", "key", "run")
_STATE = "start double, last double, next long, phase boolean, key string, run int"
_LINE = "at double, kind string, is_phase boolean, loop_key string, final boolean"


class BuildWatch(StatefulProcessor):
    """Emits the first budget that a build breaks: at a line that completes a loop or ends a gap, or at a timer.

    ``first`` is the number of a log's first line, which is applied at once. A log
    that begins with another, or any if it is null, begins with the least number
    that is held when the watermark passes it.
    """

    def __init__(self, activity: float = ACTIVITY_S, wall: float = WALL_S, threshold: int = LOOPS, load: float = 1.0, keep_s: float = 3600.0, first: int | None = 0):
        self.activity, self.wall, self.threshold, self.load, self.keep_s, self.first = activity, wall, threshold, load, keep_s, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("build", _STATE)
        self.held = handle.getMapState("held", "line_no long", _LINE)
        # a build that is over: what is left of it, until lines for it can only be late
        self.over = handle.getValueState("over", "until double")

    def _idle(self, s: dict) -> float:
        """When the idle time is over that began with the last line."""
        return s["last"] + (self.activity + (0 if s["phase"] else STARTUP_EXTRA_S)) * self.load

    def _due(self, s: dict, now: float) -> tuple[float, int, str] | None:
        """The budget broken by ``now``: when, and in which order at equal times."""
        found = ((s["start"] + self.wall * self.load, 0, "wall"), (self._idle(s), 2, "activity"))
        return min((f for f in found if f[0] <= now), default=None)

    def _apply(self, s: dict | None, line: tuple) -> tuple[dict, tuple[float, int, str] | None]:
        """The state after a line, and the budget that is broken at it or before it."""
        at, kind, is_phase, loop_key, _ = line
        s = s or {"start": at, "last": at, "next": 0, "phase": False, "key": "", "run": 0}
        broken = [self._due(s, at)]
        s["run"] = 0 if kind != "loop" else s["run"] + 1 if s["run"] and loop_key == s["key"] else 1
        s["key"] = loop_key
        if s["run"] >= self.threshold * self.load:
            broken.append((at, 1, "loop_progress"))
        s["last"], s["phase"] = at, s["phase"] or is_phase
        return s, min((b for b in broken if b), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows))
        if self.over.exists():
            return
        s = dict(zip(_FIELDS, self.state.get(), strict=True)) if self.state.exists() else None
        known = {n for (n,) in self.held.keys()}
        for n, at, kind, is_phase, loop_key, final in zip(*(lines[c].tolist() for c in ("line_no", "at", "kind", "is_phase", "loop_key", "final")), strict=True):
            if n not in known and not (s and n < s["next"]):
                known.add(n)
                self.held.updateValue((int(n),), (float(at), kind, bool(is_phase), loop_key, bool(final)))
        yield from self._advance(key, s, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        if self.over.exists():
            if self.over.get()[0] <= now:
                self.over.clear()
            return
        s = dict(zip(_FIELDS, self.state.get(), strict=True)) if self.state.exists() else None
        if s or self.held.exists():
            yield from self._advance(key, s, now)

    def _advance(self, key, s: dict | None, now: float) -> Iterator[pd.DataFrame]:
        """Applies the held lines that nothing can come before any more, then what the time has broken."""
        broken, ended, waits = None, False, None
        for (n,), line in sorted(self.held.iterator()):
            if n != (s["next"] if s else self.first) and line[0] > now:
                waits = line[0]
                break
            s, broken = self._apply(s, line)
            s["next"] = n + 1
            self.held.removeKey((n,))
            ended = bool(line[4])
            if broken or ended:
                break
        if s and not broken and not ended:
            broken = self._due(s, now)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if broken:
            yield pd.DataFrame({"build_id": [str(key[0])], "reason": [broken[2]], "at_s": [broken[0] - s["start"]]})
        if broken or ended:
            # A mark stays for a time, so that further lines of the build open no new one.
            until = max(now, s["last"]) + self.keep_s
            self.state.clear()
            self.held.clear()
            self.over.update((until,))
            self.handle.registerTimer(int(until * 1000) + 1)
            return
        if s:
            self.state.update(tuple(s[f] for f in _FIELDS))
            due = min(self._idle(s), s["start"] + self.wall * self.load)
            waits = due if waits is None else min(waits, due)
        if waits is not None:
            self.handle.registerTimer(int(waits * 1000) + 1)

    def close(self) -> None:
        pass


def watched(lines: DataFrame, watermark: str = WATERMARK, **budgets: float) -> DataFrame:
    """``build_id``, ``reason`` and ``at_s`` of every build of a stream that breaks a budget: what ``logs.kills`` says of the whole logs.

    ``lines`` has ``build_id``, ``line_no``, ``ts`` and ``text``, and may have ``final``: whether the build ended with
    the line. A build without such a line is followed on and breaks a budget in the end. Needs the RocksDB state store.
    """
    final = F.coalesce("final", F.lit(False)) if "final" in lines.columns else F.lit(False)
    rows = events(lines.withColumns({"t_s": F.lit(0.0), "final": final})).withWatermark("ts", watermark)
    place = F.concat_ws("|", "loop_theory", "loop_line", "loop_command").alias("loop_key")
    used = rows.select("build_id", "line_no", "ts", (F.unix_micros("ts").cast("double") / 1e6).alias("at"), "kind", "is_phase", place, "final")
    return used.groupBy("build_id").transformWithStateInPandas(BuildWatch(**budgets), "build_id string, reason string, at_s double", "append", "eventTime")


def sessions_started(lines: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """The first start of each session of each build, as it happens."""
    rows = events(lines.withColumn("t_s", F.lit(0.0))).where("kind = 'session'").withWatermark("ts", watermark)
    return rows.dropDuplicatesWithinWatermark(["build_id", "session"]).select("build_id", "session", "verb", "ts")


def late_rows(run: StreamingQuery) -> int:
    """Rows that came behind the watermark, as the state operators of a running query have dropped them in its last updates; ``gate.late_counts`` has all of them."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for progress in run.recentProgress for op in progress["stateOperators"])


def rolling(attempts: DataFrame, path: str, checkpoint: str):
    """Keeps the episodes of a growing corpus, closed and open, as a Parquet folder; ``rolled`` reads it.

    ``attempts`` is a stream with ``corpus_id``, ``episode_no``, ``seq`` and ``outcome``. A batch writes what it adds to
    each of its episodes, in a folder of its own number, so one that is run again replaces its own rows and nothing
    is written twice. Returns the running query.
    """

    def add(batch: DataFrame, number: int) -> None:
        own = batch.groupBy("corpus_id", "episode_no").agg(F.max("seq").alias("last_seq"), F.count("*").alias("n"), F.bool_or(F.col("outcome") == "ok").alias("closed"))
        own.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return attempts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def rolled(spark: SparkSession, path: str) -> DataFrame:
    """One row an episode of what ``rolling`` has written so far: ``last_seq``, ``n`` attempts and whether it is ``closed``."""
    rows = spark.read.parquet(path)
    return rows.groupBy("corpus_id", "episode_no").agg(F.max("last_seq").alias("last_seq"), F.sum("n").alias("n"), F.bool_or("closed").alias("closed"))
