"""Canonical relations, and how the driver's tables stand in for transcripts.

Every relation carries its order: (rec_id, seg_id).  Times are whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from jatoba.functions import text as T

WORD = "struct<word:string,start_ms:bigint,end_ms:bigint,probability:double>"
SEGMENT = f"rec_id bigint, seg_id bigint, speaker string, start_ms bigint, end_ms bigint, text string, confidence double, words array<{WORD}>"
STEP_MS = 400

#: Sentences put after some turns, so that questions, commitments and hesitations occur.
ADDED = (
    "Você pode enviar o contrato hoje?", "Ficou de confirmar o prazo, né?", "Vamos revisar a proposta até sexta.", "Então tá, obrigado por assistir.",
    "Precisamos agendar a entrega do relatório pendente.",
)
#: The adapter in SQL, for both engines: base texts with a sentence of ADDED after two turns in three.
SEGMENTS_SQL = """
said AS (SELECT conv_id AS rec_id, turn + 1 AS seg_id, role AS speaker,
  CASE WHEN (conv_id * 3 + turn) % 8 < {n} THEN concat(text, ' ', {pick}) ELSE text END AS text FROM conversations),
counted AS (SELECT *, {count} AS n_words FROM said),
timed AS (SELECT *, CAST(coalesce(sum(n_words * 400 + ((rec_id * 7 + (seg_id - 1) * 13) % 5) * 400)
  OVER (PARTITION BY rec_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM counted),
segments AS (SELECT rec_id, seg_id, speaker, start_ms, CAST(start_ms + n_words * 400 AS BIGINT) AS end_ms, text,
  ((rec_id * 31 + (seg_id - 1) * 17) % 100) / CAST(100.0 AS DOUBLE) AS confidence FROM timed)"""
_PICK = "CASE (conv_id * 3 + turn) % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(ADDED)) + " END"
#: For DuckDB: WITH-list entries ending in ``segments``.
SEGMENTS_DUCKDB = SEGMENTS_SQL.format(n=len(ADDED), pick=_PICK, count=r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_words(text: Column, start_ms: Column) -> Column:
    """Words of STEP_MS each, one after the other."""
    at = lambda i: (start_ms + i * STEP_MS).cast("bigint")
    return F.transform(T.ws_words(text), lambda w, i: F.struct(w.alias("word"), at(i).alias("start_ms"), at(i + 1).alias("end_ms"), F.lit(0.94).alias("probability")))


def segments(spark: SparkSession, sf_dir: str, words: bool = False) -> DataFrame:
    """Conversations as recordings: a turn is a segment, its role the speaker."""
    c = table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") * 3 + F.col("turn")) % 8
    more = F.get(F.array(*[F.lit(x) for x in ADDED]), k.cast("int"))
    said = c.select(F.col("conv_id").alias("rec_id"), (F.col("turn") + 1).alias("seg_id"), F.col("role").alias("speaker"), F.when(k < len(ADDED), F.concat("text", F.lit(" "), more)).otherwise(F.col("text")).alias("text"))
    # dealt over all shuffle partitions: what is made of texts later is made in these tasks
    counted = said.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rec_id").withColumn("n", T.word_count(F.col("text")))
    before = W.partitionBy("rec_id").orderBy("seg_id").rowsBetween(W.unboundedPreceding, -1)
    took = F.col("n") * STEP_MS + ((F.col("rec_id") * 7 + (F.col("seg_id") - 1) * 13) % 5) * STEP_MS
    start = F.coalesce(F.sum(took).over(before), F.lit(0)).cast("bigint")
    out = counted.withColumn("start_ms", start).select(
        "rec_id", "seg_id", "speaker", "start_ms", (F.col("start_ms") + F.col("n") * STEP_MS).cast("bigint").alias("end_ms"), "text",
        (((F.col("rec_id") * 31 + (F.col("seg_id") - 1) * 17) % 100) / F.lit(100.0)).alias("confidence"),
    )
    return out.withColumn("words", timed_words(F.col("text"), F.col("start_ms"))) if words else out


def recordings(segs: DataFrame) -> DataFrame:
    """One row per recording, as the history keeps them."""
    return segs.groupBy("rec_id").agg(
        F.max("end_ms").alias("duration_ms"), F.sum(T.word_count(F.col("text"))).alias("word_count"), F.count(F.lit(1)).alias("segment_count"),
        F.countDistinct("speaker").alias("speakers"), F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("avg_confidence"),
    ).select("rec_id", F.concat(F.lit("gravacao_"), F.col("rec_id").cast("string"), F.lit(".wav")).alias("filename"), F.when(F.col("rec_id") % 7 == 3, "erro").otherwise("concluido").alias("status"), (F.lit(1_700_000_000) + F.col("rec_id") * 3600).cast("bigint").alias("created_at"), (F.col("rec_id") % 50 + 1).cast("bigint").alias("elapsed_s"), "duration_ms", "word_count", "segment_count", "speakers", "avg_confidence")
