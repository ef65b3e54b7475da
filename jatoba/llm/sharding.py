"""Rendezvous (highest random weight) hashing of record keys over weighted shards, in column expressions.

Every shard draws a number in (0, 1) from a hash of the key and its own name; with weight w the
score is -w / ln(u), and the highest score takes the key.  Another shard changes only the keys that
it wins itself, so about w_new / sum(w) of the rows move.

Edge cases: a null key is a key like any other (the empty name), so all its rows share a shard;
rows that repeat get the same shard and different slots; a null text has size 1 and checksum 0; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import documents, table

#: Hex digits of the hash that make the draw: 52 bits are exact in a double.
DIGITS = 13
#: Rows that one slot bucket is meant to hold; buckets, not shards, are sorted.
BUCKET_ROWS = 20_000


def draw(key: Column, shard: str) -> Column:
    """A uniform number in (0, 1) from the key and the shard's name."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(shard)).cast("binary"))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def winner(key: Column, names: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Index of the shard that takes the key.  Weights need not be equal; all must be positive."""
    weights = list(weights) if weights is not None else [1.0] * len(names)
    if not names or len(weights) != len(names) or min(weights) <= 0:
        raise ValueError("one positive weight for each of at least one shard")
    draws = [draw(key, n) for n in names]
    # at equal weights the largest draw has the largest score; no logarithm is needed
    scores = draws if len(set(weights)) == 1 else [-F.lit(float(w)) / F.log(u) for w, u in zip(weights, draws, strict=True)]
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("shard")) for i, s in enumerate(scores)]))
    return (-best["shard"]).cast("int")


def assign(df: DataFrame, key: str, shards: int, weights: Sequence[float] | None = None, into: str = "shard") -> DataFrame:
    return df.withColumn(into, winner(F.col(key), [str(i) for i in range(shards)], weights))


def slots(df: DataFrame, shard: str, order: Sequence[str], buckets: int) -> DataFrame:
    """Gapless numbers from 0 in each shard without sorting a shard in one task.

    Rows are dealt to ``buckets`` sub-buckets of a shard; the counts of sub-buckets (one row each) give
    the offsets, and each sub-bucket numbers its own rows.  The row's place in the scan is part of what
    deals it, so rows that repeat do not gather either; call this on a scan, whose places are the same
    when a lost task runs again.
    """
    place = F.monotonically_increasing_id()
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*order, place), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(shard, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(shard).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = dealt.withColumn("__i", F.row_number().over(W.partitionBy(shard, "__b").orderBy(*order)) - 1)
    return numbered.join(offsets, [shard, "__b"]).withColumn("slot", (F.col("__before") + F.col("__i")).cast("bigint")).drop("__b", "__i", "__before")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    shards = 16
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = assign(assign(sized, "doc_id", shards), "doc_id", shards + 1, into="grown_shard")
    buckets = docs.count() // (shards * BUCKET_ROWS) * 2 + 64
    return slots(dealt, "shard", ["doc_id", "text_crc32", "size"], buckets).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
