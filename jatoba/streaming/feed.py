"""What watchers of running jobs are sent, as one stateful stream with timers.

Events (job_id, seq, at timestamp, status, percent, stage, detail, started_ms, position_s, total_s, removed) turn into rows of
``OUT``: a ``status`` when the signature changes, ``progress`` at each event that has a length, running on between
confirmations at the speed of the last one, a ``ping`` after so much time without a word, ``fim`` with a terminal status, and
``removida`` once for a job that is gone.

The clock is processing time, or event time for a replay: there the watermark is the clock, so a log gives the same rows
however it is cut into batches.  Silence between two events of one batch is made up for when the second is handled, silence at the
end by a timer.  State is one row per open job; a terminal status or a removal ends it with its timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from jatoba.streaming.live import SIGNATURE, TERMINAL

BEAT_MS, INITIAL, BATCH_S = 15_000, 1.0, 240.0
REMOVED = "Tarefa removida."
OUT = "job_id string, seq bigint, at_ms bigint, kind string, status string, percent bigint, stage string, detail string, progress double, message string"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
_STATE = StructType(
    [StructField(c, LongType() if c == "percent" else StringType()) for c in SIGNATURE] + [StructField(c, LongType()) for c in ("seq", "started_ms", "sent_ms")] + [StructField(c, DoubleType()) for c in ("done", "speed", "shown")]
)
_FIELDS = [f.name for f in _STATE.fields]


def _or_none(x):
    return None if pd.isna(x) else x


class JobFeed(StatefulProcessor):
    def __init__(self, event_time: bool, beat_ms: int = BEAT_MS, initial: float = INITIAL, batch_s: float = BATCH_S):
        self.event_time, self.beat_ms, self.initial, self.batch_s = event_time, beat_ms, initial, batch_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", _STATE)

    def _beats(self, job: str, s: dict, until_ms: int) -> list[tuple]:
        """Pings that were due before ``until_ms``."""
        out = []
        while s["sent_ms"] + self.beat_ms < until_ms:
            s["sent_ms"] += self.beat_ms
            out.append((job, s["seq"], s["sent_ms"], "ping", *[None] * 6))
        return out

    def _progress(self, s: dict, at_ms: int, position: float | None, total: float) -> float:
        """15 points, then at most 79 by the position: confirmed, or run on by at most ``batch_s`` seconds."""
        elapsed, total = (at_ms - s["started_ms"]) / 1000, max(1.0, total)
        if position is not None:
            s["done"] = max(s["done"], position)
            if elapsed > 5 and s["done"] > 0:
                s["speed"] = s["done"] / elapsed
        guess = min(total, elapsed * s["speed"], s["done"] + self.batch_s)
        s["shown"] = max(s["shown"], 15.0 + min(79.0, max(s["done"], guess) / total * 80.0))
        return s["shown"]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job, out = key[0], []
        s = dict(zip(_FIELDS, self.state.get(), strict=True)) if self.state.exists() else None
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            at = int(r.at_ms)
            if s is None:
                s = dict.fromkeys(_FIELDS) | {"started_ms": at if pd.isna(r.started_ms) else int(r.started_ms), "sent_ms": at, "done": 0.0, "speed": self.initial, "shown": 0.0}
            else:
                out += self._beats(job, s, at)
            s["seq"] = int(r.seq)
            if r.removed is True or r.removed == True:  # noqa: E712  numpy's truth
                out.append((job, s["seq"], at, "removida", *[None] * 5, REMOVED))
                s = None
                continue
            now = {"status": r.status, "percent": None if pd.isna(r.percent) else int(r.percent), "stage": r.stage, "detail": r.detail}
            if any(now[c] != s[c] for c in SIGNATURE):
                out.append((job, s["seq"], at, "status", *now.values(), None, None))
                s |= now | {"sent_ms": at}
            if not pd.isna(r.total_s):
                out.append((job, s["seq"], at, "progress", *[None] * 4, self._progress(s, at, _or_none(r.position_s), float(r.total_s)), None))
                s["sent_ms"] = at
            if r.status in TERMINAL:
                out.append((job, s["seq"], at, "fim", r.status, *[None] * 5))
                s = None
        self._keep(s)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            s = dict(zip(_FIELDS, self.state.get(), strict=True))
            now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            out = self._beats(key[0], s, now)
            self._keep(s)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _keep(self, s: dict | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s is None:
            self.state.clear()
        else:
            self.state.update(tuple(s[c] for c in _FIELDS))
            self.handle.registerTimer(s["sent_ms"] + self.beat_ms)

    def close(self) -> None:
        pass


def feed(events: DataFrame, event_time: bool = False, delay: str = "0 seconds", **limits) -> DataFrame:
    """The stream of ``OUT``; needs the RocksDB state store.  With ``event_time`` the column ``at`` is the clock, else the time of
    arrival is."""
    at = F.col("at") if event_time else F.current_timestamp()
    names = dict.fromkeys(("started_ms", "position_s", "total_s", "removed"))
    kinds = {"started_ms": "bigint", "position_s": "double", "total_s": "double", "removed": "boolean"}
    rows = events.select(*[F.col(c) if c in events.columns else F.lit(None).cast(kinds[c]).alias(c) for c in ("job_id", "seq", *SIGNATURE, *names)], at.alias("at"))
    rows = rows.withColumn("at_ms", F.unix_millis("at"))
    if event_time:
        rows = rows.withWatermark("at", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(JobFeed(event_time, **limits), outputStructType=OUT, outputMode="append", timeMode="EventTime" if event_time else "ProcessingTime")
