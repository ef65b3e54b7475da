"""Live events of running jobs: (job_id, seq, ts, status, percent, stage, detail), unbounded.

A status message goes out only when the signature (status, percent, stage, detail) differs from the last
one of its job; a terminal status ends the job's state.  Within a job, ``seq`` orders the events of a
micro-batch; state is one row per open job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

TERMINAL = ("concluido", "erro", "cancelado")
OUT = "job_id string, seq bigint, status string, percent bigint, stage string, detail string, final boolean"
SIGNATURE = ("status", "percent", "stage", "detail")
_STATE = StructType([StructField("status", StringType()), StructField("percent", LongType()), StructField("stage", StringType()), StructField("detail", StringType())])


class StatusChanges(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("seq")
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for r in got.itertuples():
            now = (r.status, None if pd.isna(r.percent) else int(r.percent), r.stage, r.detail)
            if now != last:
                final = r.status in TERMINAL
                out.append((key[0], int(r.seq), *now, final))
                last = None if final else now
        if last is None:
            self.last.clear()
        else:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["job_id", "seq", "status", "percent", "stage", "detail", "final"])

    def close(self) -> None:
        pass


def status_changes(events: DataFrame) -> DataFrame:
    """The stream of changes; needs the RocksDB state store provider."""
    return events.select("job_id", "seq", *SIGNATURE).groupBy("job_id").transformWithStateInPandas(StatusChanges(), outputStructType=OUT, outputMode="append", timeMode="None")


def status_changes_batch(events: DataFrame) -> DataFrame:
    """The same over a finished log, by windows.  After a terminal status everything counts as changed."""
    w = W.partitionBy("job_id").orderBy("seq")
    sig = F.struct(*SIGNATURE)
    ended = F.coalesce(F.lag("status").over(w).isin(*TERMINAL), F.lit(False))
    changed = F.lag(sig).over(w).isNull() | ended | ~F.lag(sig).over(w).eqNullSafe(sig)
    rows = events.withColumn("__c", changed).filter("__c")
    return rows.select("job_id", "seq", *SIGNATURE, F.col("status").isin(*TERMINAL).alias("final"))


def paced(events: DataFrame) -> DataFrame:
    """Progress that never goes back: 15 + at most 79 points over the recording's length."""
    w = W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    point = 15 + F.least(F.lit(79.0), F.col("position_s") / F.col("total_s") * 80)
    return events.withColumn("progress", F.floor(F.max(point).over(w)).cast("bigint"))


def paced_ahead(events: DataFrame, initial: float = 1.0, batch_s: float = 240.0) -> DataFrame:
    """Progress between confirmations: events (job_id, seq, elapsed_s, position_s or null, total_s).  The position runs on at
    the speed of the last confirmation (after 5 s; ``initial`` before that), at most ``batch_s`` beyond what is confirmed."""
    w = W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    total = F.greatest(F.lit(1.0), F.col("total_s"))
    d = events.withColumn("__done", F.coalesce(F.max("position_s").over(w), F.lit(0.0)))
    speed = F.when(F.col("position_s").isNotNull() & (F.col("elapsed_s") > 5) & (F.col("__done") > 0), F.col("__done") / F.col("elapsed_s"))
    d = d.withColumn("__speed", F.coalesce(F.last(speed, ignorenulls=True).over(w), F.lit(float(initial))))
    guess = F.least(total, F.col("elapsed_s") * F.col("__speed"), F.col("__done") + batch_s)
    point = 15.0 + F.least(F.lit(79.0), F.greatest(F.col("__done"), guess) / total * 80.0)
    return d.withColumn("progress", F.max(point).over(w)).drop("__done", "__speed")


def eta(elapsed_s, percent):
    """Seconds left, once more than five per cent are done."""
    return F.when(percent > 5, elapsed_s * (100 - percent) / percent)


def since(segments: DataFrame, cursor: int) -> DataFrame:
    """Live segments after the reader's cursor, in order."""
    return segments.filter(F.col("seg_id") > cursor).orderBy("seg_id")
