"""Live use of CPU: the totals of a build's process tree, and how busy it was over a trailing window.

Samples carry event time. ``live_duty`` chains two keyed operators: the first
holds samples until the watermark has passed them and emits the tree's total at
each time in order; the second keeps one window of totals. Both drop the state of
a build that has shown nothing for ``keep_s`` of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tryloom.operators.logs import CPU_WINDOW_S

WATERMARK = "1 minute"


class TreeCpu(StatefulProcessor):
    """CPU of a build's whole process tree so far, at each sample as it comes: of each process the most that it has shown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.most = handle.getMapState("most", "pid long", "cpu_s double")
        self.total = handle.getValueState("total", "cpu_s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples = pd.concat(list(rows)).sort_values(["ts", "pid"])
        total = self.total.get()[0] if self.total.exists() else 0.0
        out = []
        for at, group in samples.groupby("ts", sort=True):
            for pid, cpu in zip(group["pid"].tolist(), group["cpu_s"].tolist(), strict=True):
                known = self.most.getValue((pid,))[0] if self.most.containsKey((pid,)) else 0.0
                if cpu > known:
                    total += cpu - known
                    self.most.updateValue((pid,), (cpu,))
            out.append((str(key[0]), at, total))
        self.total.update((total,))
        yield pd.DataFrame(out, columns=["build_id", "ts", "cpu_s"])

    def close(self) -> None:
        pass


class OrderedCpu(StatefulProcessor):
    """What ``operators.logs.cumulative_cpu`` says of each time, in order, once no earlier sample can come."""

    def __init__(self, keep_s: float = 600.0):
        self.keep_us = int(keep_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at long, pid long", "cpu_s double")
        self.most = handle.getMapState("most", "pid long", "cpu_s double")
        self.total = handle.getValueState("total", "cpu_s double, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples = pd.concat(list(rows)).groupby(["at", "pid"])["cpu_s"].max()
        for (at, pid), cpu in samples.items():
            before = self.held.getValue((int(at), int(pid))) if self.held.containsKey((int(at), int(pid))) else None
            if before is None or cpu > before[0]:
                self.held.updateValue((int(at), int(pid)), (float(cpu),))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, now: int) -> Iterator[pd.DataFrame]:
        total, last = self.total.get() if self.total.exists() else (0.0, now)
        out: dict[int, float] = {}
        waits = None
        for (at, pid), (cpu,) in sorted(self.held.iterator()):
            if at > now:
                waits = at
                break
            known = self.most.getValue((pid,))[0] if self.most.containsKey((pid,)) else 0.0
            if cpu > known:
                total += cpu - known
                self.most.updateValue((pid,), (cpu,))
            self.held.removeKey((at, pid))
            out[at], last = total, at
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if waits is None and now > last + self.keep_us:
            for state in (self.total, self.most):
                state.clear()
        else:
            self.total.update((total, last))
            self.handle.registerTimer((last + self.keep_us if waits is None else waits) // 1000 + 1)
        if out:
            yield pd.DataFrame({"build_id": [str(key[0])] * len(out), "ts": pd.to_datetime(list(out), unit="us"), "cpu_s": list(out.values())})

    def close(self) -> None:
        pass


class TrailingDuty(StatefulProcessor):
    """What ``operators.logs.duty_cycles`` says of each total; totals come in order."""

    def __init__(self, window: float = CPU_WINDOW_S, least_span: float = 5.0, keep_s: float = 600.0):
        self.window_us, self.least_span, self.keep_us = int(window) * 1_000_000, least_span, int(keep_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long, cpu_s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        totals = pd.concat(list(rows)).sort_values("at")
        kept = list(self.recent.get()) if self.recent.exists() else []
        out = []
        for at, cpu in zip(totals["at"].tolist(), totals["cpu_s"].tolist(), strict=True):
            kept = [k for k in kept if k[0] >= at - self.window_us] + [(at, cpu)]
            span = (at - kept[0][0]) / 1e6
            good = len(kept) >= 2 and span >= self.least_span and cpu >= kept[0][1]
            out.append((str(key[0]), at, cpu, (cpu - kept[0][1]) / span if good else None))
        self.recent.put(kept)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((kept[-1][0] + self.keep_us) // 1000 + 1)
        frame = pd.DataFrame(out, columns=["build_id", "at", "cpu_s", "duty"])
        yield pd.DataFrame({"build_id": frame["build_id"], "ts": pd.to_datetime(frame["at"], unit="us"), "cpu_s": frame["cpu_s"], "duty": frame["duty"].astype("float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def _samples(samples: DataFrame, watermark: str) -> DataFrame:
    return samples.withWatermark("ts", watermark).select("build_id", F.col("pid").cast("long").alias("pid"), "ts", F.unix_micros("ts").alias("at"), F.col("cpu_s").cast("double").alias("cpu_s"))


def tree_cpu(samples: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """``build_id``, ``ts`` and ``cpu_s`` (of the tree) at once from a stream of samples of processes (``build_id``, ``pid``, ``ts``, ``cpu_s``), for ``cpu_windows``; a late sample's total comes late."""
    return _samples(samples, watermark).groupBy("build_id").transformWithStateInPandas(TreeCpu(), "build_id string, ts timestamp, cpu_s double", "append", "eventTime")


def live_duty(samples: DataFrame, watermark: str = WATERMARK, keep_s: float = 600.0, **window: float) -> DataFrame:
    """``build_id``, ``ts``, ``cpu_s`` of the tree and ``duty`` over the trailing window: what the batch rules say of the same samples, as soon as the watermark has passed them."""
    cpu = _samples(samples, watermark).groupBy("build_id").transformWithStateInPandas(OrderedCpu(keep_s), "build_id string, ts timestamp, cpu_s double", "append", "eventTime", eventTimeColumnName="ts")
    totals = cpu.withColumn("at", F.unix_micros("ts"))
    return totals.groupBy("build_id").transformWithStateInPandas(TrailingDuty(keep_s=keep_s, **window), "build_id string, ts timestamp, cpu_s double, duty double", "append", "eventTime")


def cpu_windows(samples: DataFrame, watermark: str = WATERMARK, window: str = "15 seconds", slide: str = "5 seconds") -> DataFrame:
    """Cores that each build used over sliding windows of its samples (``build_id``, ``ts``, ``cpu_s`` of the tree)."""
    per = samples.withWatermark("ts", watermark).groupBy("build_id", F.window("ts", window, slide).alias("w")).agg(F.min("cpu_s").alias("c0"), F.max("cpu_s").alias("c1"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    span = (F.unix_micros("t1") - F.unix_micros("t0")) / 1e6
    return per.select("build_id", F.col("w.end").alias("window_end"), F.when(span > 0, (F.col("c1") - F.col("c0")) / span).alias("duty"))
