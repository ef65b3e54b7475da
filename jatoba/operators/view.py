"""What a reader of one result or of the queue sees: filters, steps through time, thinning, merges of polled states."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window as W, functions as F

from jatoba.functions import labels as L, text as T
from jatoba.operators.analytics import LOW_CONFIDENCE


def visible(segs: DataFrame, needle: str = "", hidden: Iterable[str] = (), low_only: bool = False) -> DataFrame:
    """Segments that hold the needle (case aside, accents count), of speakers that are not hidden.  Segments without a
    speaker are never hidden; null texts hold nothing; with ``low_only`` a null confidence does not count as low."""
    n = needle.strip().lower()
    out = segs.filter(F.lower("text").contains(n)) if n else segs
    if low_only:
        out = out.filter(F.col("confidence") < LOW_CONFIDENCE)
    names = sorted(set(hidden))
    return out.filter(F.col("speaker").isNull() | (F.col("speaker") == "") | ~F.col("speaker").isin(names)) if names else out


def neighbours(segs: DataFrame, at_ms: int) -> DataFrame:
    """(rec_id, next_ms, previous_ms): the first start over 150 ms later, and the last over 1,200 ms earlier.
    No later one is null, no earlier one is 0."""
    start = F.col("start_ms")
    return segs.groupBy("rec_id").agg(
        F.min(F.when(start > at_ms + 150, start)).alias("next_ms"), F.coalesce(F.max(F.when(start < at_ms - 1200, start)), F.lit(0).cast("bigint")).alias("previous_ms")
    )


def live_fields(segs: DataFrame) -> DataFrame:
    """The seven fields that a live segment carries, beside its recording."""
    return segs.select("rec_id", F.col("seg_id").alias("id"), "start_ms", "end_ms", T.short_time(F.col("start_ms")).alias("start_str"), T.short_time(F.col("end_ms")).alias("end_str"), "text", "confidence")


def thinned(points: DataFrame, width: int, step: int = 4) -> DataFrame:
    """(rec_id, point from 0, …): as many points as bars of ``step`` pixels fit, evenly by position, ``bar`` from 0.
    A filter on the position; only the count of points is gathered."""
    n = F.count(F.lit(1)).over(W.partitionBy("rec_id"))
    d = points.withColumn("__n", n).withColumn("__b", F.greatest(F.lit(1), F.least(F.col("__n"), F.lit(width // step))).cast("bigint"))
    d = d.withColumn("bar", F.expr("(point * __b + __n - 1) div __n"))
    return d.filter(F.expr("bar < __b AND (bar * __n) div __b = point")).drop("__n", "__b")


def steps(events: DataFrame, speakers: bool = True) -> DataFrame:
    """``step`` of each event of a job: that of its stage, else the last one known, at first 0."""
    w = W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("step", F.coalesce(F.last(L.stage_step(F.col("stage"), speakers), ignorenulls=True).over(w), F.lit(0)))


def merge_polled(batch: DataFrame, polled: DataFrame, key: str = "job_id", fields: tuple[str, ...] = ("status", "percent", "stage")) -> DataFrame:
    """The batch's rows with the polled values of ``fields``, nulls too; jobs that were not polled stay, others are
    not added.  ``polled`` has one row per job."""
    both = list(fields)
    new = polled.select(key, F.struct(*both).alias("__new"))
    out = batch.join(new, key, "left")
    return out.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in both else F.col(c) for c in batch.columns])


def model_flags(models: DataFrame, present: DataFrame, default: str) -> DataFrame:
    """``baixado`` for models (``nome``) that are present, ``padrao`` for the default."""
    there = present.select("nome").distinct().withColumn("baixado", F.lit(True))
    return models.join(there, "nome", "left").withColumn("baixado", F.coalesce("baixado", F.lit(False))).withColumn("padrao", F.col("nome") == default)


def raw_totals(raw: DataFrame) -> DataFrame:
    """Per recording over decoder output: segments kept and discarded by the hallucination filter, speech time and mean
    positive confidence of those kept (summed in decimals, so that the order of rows can't change it), in one aggregate."""
    gone = T.is_hallucination(F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob"))
    kept = raw.withColumn("__gone", F.coalesce(gone, F.lit(False)))
    good = ~F.col("__gone")
    return kept.groupBy("rec_id").agg(
        F.count_if(good).alias("segments"), F.count_if(~good).alias("discarded"), F.coalesce(F.sum(F.when(good, F.col("end_ms") - F.col("start_ms"))), F.lit(0)).alias("speech_ms"),
        F.coalesce(F.round(F.avg(F.when(good & (F.col("confidence") > 0), F.col("confidence").cast("decimal(9,6)"))), 3).cast("double"), F.lit(0.0)).alias("avg_confidence"),
    )


def removed(watched: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """A message for each watched job that is no longer there."""
    return watched.select(key).distinct().join(jobs.select(key), key, "left_anti").withColumn("message", F.lit("Tarefa removida."))


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Job metadata as JSON lines, without results and live segments, which have relations of their own."""
    jobs.drop("result", "live_segments").write.mode("overwrite").json(path)
