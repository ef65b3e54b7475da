"""Persistent relations without a table format: latest rows of a log, deletes, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from jatoba.functions import text as T

SLIM = ("rec_id", "seg_id", "speaker", "start_ms", "end_ms", "text", "confidence")
PRIVATE = ("result", "live_segments", "upload_path")


def latest(log: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Last write wins: the upsert of an append-only log.  Rows without a key are ignored."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def upsert(current: DataFrame, changes: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows of ``changes`` replace or join those of ``current``."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def indexable(segs: DataFrame) -> DataFrame:
    """Segments that say something; those without a number get their place by start."""
    rows = segs.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    return rows.withColumn("seg_id", F.coalesce("seg_id", F.row_number().over(W.partitionBy("rec_id").orderBy("start_ms")).cast("bigint")))


def delete(relations: dict[str, DataFrame], gone: DataFrame, key: str = "rec_id") -> dict[str, DataFrame]:
    """The relations without the given keys."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in relations.items()}


def expired(files: DataFrame, now_s: int, hours: int) -> DataFrame:
    """Files older than so many hours, strictly; 0 hours keeps all."""
    return files.filter(F.lit(hours > 0) & (F.col("modified_s") < now_s - hours * 3600))


def history(recs: DataFrame, limit: int = 500) -> DataFrame:
    return recs.orderBy(F.desc("created_at"), "rec_id").limit(limit)


def _parsed(jobs: DataFrame, column: str) -> DataFrame:
    parsed = F.try_parse_json(column)
    whole = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
    return jobs.withColumn("__p", whole)


def payloads(jobs: DataFrame, column: str = "payload") -> DataFrame:
    """Jobs with their saved state as a VARIANT; those whose text can't be read, or is no object, are left out."""
    return _parsed(jobs, column).filter("__p is not null").drop(column).withColumnRenamed("__p", column)


def payload_counts(jobs: DataFrame, column: str = "payload") -> DataFrame:
    """(kept, dropped)."""
    return _parsed(jobs, column).agg(F.count_if(F.col("__p").isNotNull()).alias("kept"), F.count_if(F.col("__p").isNull()).alias("dropped"))


def rescue(found: DataFrame, known: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs on disk that the history lacks; what was under way is an error now."""
    repaired = F.when(F.col("status").isin("processando", "na_fila"), "erro").otherwise(F.col("status"))
    return found.join(known.select(key), key, "left_anti").withColumn("status", repaired)


def slim(segs: DataFrame) -> DataFrame:
    """Without the words, which are most of a result's bytes."""
    return segs.select(*SLIM)


def public(jobs: DataFrame) -> DataFrame:
    kept = jobs.withColumn("segment_count", F.coalesce(F.size("live_segments"), F.lit(0))) if "live_segments" in jobs.columns else jobs
    return kept.drop(*PRIVATE)


def apply_edits(segs: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (rec_id, seg_id, ordinal, text): the last of a segment counts, if it is not blank and says
    something else; an edited segment loses its word times."""
    last = edits.groupBy("rec_id", "seg_id").agg(F.max_by("text", "ordinal").alias("__t"))
    joined = segs.join(last, ["rec_id", "seg_id"], "left").withColumn("__t", T.clean_text(F.col("__t")))
    on = F.coalesce((F.col("__t") != "") & (F.col("__t") != F.col("text")), F.lit(False))
    out = joined.withColumn("editado", on).withColumn("text", F.when(F.col("editado"), F.col("__t")).otherwise(F.col("text")))
    if "words" in segs.columns:
        out = out.withColumn("words", F.when(~F.col("editado"), F.col("words")))
    return out.drop("__t")


def segment_at(segs: DataFrame, at_ms: int) -> DataFrame:
    """The first segment of each recording that holds an instant."""
    return segs.filter((F.col("start_ms") <= at_ms) & (F.col("end_ms") >= at_ms)).groupBy("rec_id").agg(F.min("seg_id").alias("seg_id"))


def uploads(files: DataFrame, extensions: list[str], most_bytes: int) -> DataFrame:
    """Files with ``motivo``, null for those accepted; of files with one name and size the first counts."""
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
    first = F.row_number().over(W.partitionBy("filename", "size_bytes").orderBy("ordinal"))
    why = F.when(~ext.isin(extensions), "formato").when(F.col("size_bytes") <= 0, "vazio").when(F.col("size_bytes") > most_bytes, "grande").when(F.col("__f") > 1, "repetido")
    return files.withColumn("__f", first).withColumn("motivo", why).drop("__f")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)
