"""Episodes of growing corpora as a stream: segmentation and the figures of ``operators.episodes.summary``.

A corpus is one key. Attempts are applied in the order of their numbers, which
begin at 0 and leave none out; one that comes early is held until those before it
are there, so the result does not depend on how attempts fall into batches. After
each batch an episode that was touched is emitted with its figures so far;
``latest`` keeps the last of them. An episode is done when a success closes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tryloom.operators.episodes import EPISODE

_ATTEMPT = {"build_id": "string", "ts": "timestamp", "outcome": "string", "delta_class": "string"}
_FIGURES = "first_seq long, last_seq long, first_build string, last_build string, started timestamp, len_raw long, fails long, timeouts long, len_code long, len_attempt long, is_closed boolean, blind boolean"
_NAMES = [f.split(" ")[0] for f in _FIGURES.split(", ")]
#: Times are held in microseconds.
_OPEN = f"next long, episode_no long, outcome string, {_FIGURES.replace('started timestamp', 'started long')}"


class LiveEpisodes(StatefulProcessor):
    """Segments each corpus and sums up its episodes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "seq long", "build_id string, ts long, outcome string, delta_class string")
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, number, outcome, *figures = self.open.get() if self.open.exists() else (0, 0, None, *[None] * len(_NAMES))
        known = {n for (n,) in self.held.keys()}
        for frame in rows:
            for seq, *attempt in zip(*(frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in ("seq", "build_id", "at", "outcome", "delta_class")), strict=True):
                if seq >= at and seq not in known:
                    known.add(seq)
                    self.held.updateValue((int(seq),), (attempt[0], None if attempt[1] is None else int(attempt[1]), *attempt[2:]))
        episode = dict(zip(_NAMES, figures, strict=True)) if figures[0] is not None else None
        out = []
        while at in known:
            attempt = self.held.getValue((at,))
            self.held.removeKey((at,))
            episode, outcome = self._add(episode, at, attempt, outcome), attempt[2]
            at += 1
            if episode["is_closed"]:
                out.append((number, episode))
                number, episode, outcome = number + 1, None, None
        if episode:
            out.append((number, episode))
        self.open.update((at, number, outcome, *((episode or dict.fromkeys(_NAMES))[n] for n in _NAMES)))
        if out:
            found = pd.DataFrame([{"corpus_id": str(key[0]), "episode_no": n} | e for n, e in out], columns=["corpus_id", "episode_no", *_NAMES])
            found["started"] = pd.to_datetime(found["started"].astype("Int64"), unit="us")
            found["len_attempt"] = found["len_attempt"].where(found["len_attempt"] > 0).astype("Int64")
            yield found

    @staticmethod
    def _add(episode: dict | None, seq: int, attempt: tuple, before: str | None) -> dict:
        """``episode`` with one more attempt; ``before`` is the outcome of the one before it in the episode."""
        build, ts, outcome, kind = attempt
        e = episode or {"first_seq": seq, "first_build": build, "started": ts, "len_raw": 0, "fails": 0, "timeouts": 0, "len_code": 0, "len_attempt": 0, "is_closed": None, "blind": False}
        bad, after_bad = outcome is not None and outcome != "ok", before is not None and before != "ok"
        return e | {
            "last_seq": seq, "last_build": build, "len_raw": e["len_raw"] + 1, "fails": e["fails"] + (outcome == "fail"), "timeouts": e["timeouts"] + (outcome == "timeout"),
            "len_code": e["len_code"] + (kind == "code"), "len_attempt": e["len_attempt"] + (bad or kind == "code" or after_bad), "is_closed": e["is_closed"] if outcome is None else outcome == "ok", "blind": e["blind"] or (kind == "none" and after_bad),
        }

    def close(self) -> None:
        pass


def live_episodes(attempts: DataFrame) -> DataFrame:
    """Episodes as they grow. ``attempts`` is a stream with ``corpus_id``, ``seq``, ``build_id``, ``ts``, ``outcome`` and ``delta_class`` (which ``diffs.classified`` gives to a batch in ``gate.gated``)."""
    rows = attempts.select("corpus_id", F.col("seq").cast("long").alias("seq"), *[F.col(c).cast(kind).alias(c) for c, kind in _ATTEMPT.items()]).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("corpus_id").transformWithStateInPandas(LiveEpisodes(), f"corpus_id string, episode_no long, {_FIGURES}", "update", "none")


def latest(emitted: DataFrame) -> DataFrame:
    """One row an episode: the last that ``live_episodes`` has emitted of it."""
    return emitted.groupBy(*EPISODE).agg(F.max_by(F.struct(*_NAMES), "last_seq").alias("e")).select(*EPISODE, "e.*")
