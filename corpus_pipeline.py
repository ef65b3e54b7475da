"""Corpus pipeline: toxic documents go, one of each group of near copies stays, documents that hold benchmark
items go, personal data is masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept, read again from Parquet.

Edge cases: null and empty texts are clean, near nothing, hold no item and no personal data, and are packed as
their separator alone; a very long text is read whole; of rows that repeat, or that share a text and a null
doc_id, the near-copy stage keeps one, as it does of any group, but all rows without words; a doc_id with two texts
is two documents; other columns, whatever their names, pass through all stages but the last; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jatoba.llm import decontam, jaccard, packing, pii, toxicity
from jatoba.llm.common import bound_batches, pick, stash, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fitted(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a similarity of 0.8; the least doc_id of a group stays."""
    bound_batches(spark)
    return jaccard.keep_one(docs, shingle=5, num=8, den=10)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, pick(table(spark, sf_dir, "benchmark"), item_id="bigint", text="string"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    masked = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.best_fit_pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: No stage but the joins can be said in SQL.  The tests hold the near-copy stage against brute force, the packing against
#: the tokenizer, and the others against what they say they drop or mask.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
