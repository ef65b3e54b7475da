"""Importance resampling towards a target distribution: hashed n-gram weights, exact top k by radix selection.

1. Words are runs of digits, letters and everything beyond ASCII, A-Z in lower case; features are their runs of
   1 to ``most`` words.  A feature's bucket is the CRC-32 of its UTF-8 bytes, which is linear in the bytes: tables by the
   distance to the word's end give all words of a slice at once, and shifts give the runs of words.
2. Bucket counts of the corpus and of the target (one row a bucket and task, summed) make an array of gains, the log
   ratio of the smoothed shares in thousandths; a document's weight is the sum over its features, an array look-up.
3. A Gumbel draw from a hash of the id turns the k highest scores into a sample without replacement.  The k-th key
   (score, then id, then place in the table) is found digit by digit: each round counts the next twelve bits of
   the rows that still tie, at most 4,096 rows to the driver.
4. Only the drawn rows are range-sorted and numbered by prefix counts.

Edge cases: a null or empty text, or one without words, has no features and weight 0, and is never drawn unless
``least`` is 0; a null id draws as the empty name and loses ties; rows that repeat are drawn one by one, in the order of
their place; very long texts are read whole; an empty corpus gives no rows, an empty target gains the smoothed
ratio; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, pick, slices, stash, table
from .hashing import buffers
from .scan import scan

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Words of more bytes are hashed one by one.
_NEAR = 24
#: Bits of a key that one round of the selection counts.
DIGIT = 12
_INNER = np.zeros(256, bool)
_INNER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(_NEAR + 1)], np.uint32)
_BYTES = np.array([[zlib.crc32(bytes([b]) + bytes(d)) ^ int(_ZEROS[d + 1]) for b in range(256)] for d in range(_NEAR)], np.uint32)


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map with these images of the 32 bits."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def _shifts() -> list[np.ndarray]:
    """By power of two: what so many zero bytes make of each bit of a CRC."""
    one = np.array([zlib.crc32(b"\0", 1 << bit) ^ zlib.crc32(b"\0", 0) for bit in range(32)], np.uint32)
    out = [one]
    for _ in range(40):
        out.append(_apply(out[-1], out[-1]))
    return out


_SHIFTS = _shifts()


def joined(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of x + y from those of x and y and the length of y in bytes."""
    a = a.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        on = (length >> power) & 1 == 1
        a[on] = _apply(_SHIFTS[power], a[on])
    return a ^ b


def word_crcs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 and length in bytes of every word, and per text the index of its first word (and one more)."""
    raw, offsets = buffers(column)
    n = len(raw)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    data = _LOWER[raw]
    inner = _INNER[data]
    border = offsets[(offsets > 0) & (offsets < n)]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[border] = True
    begins = inner & (edge[:n] | ~np.concatenate(([False], inner[:-1])))
    stops = inner & (edge[1:] | ~np.concatenate((inner[1:], [False])))
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    length = ends - starts
    if not len(starts):
        return np.empty(0, np.uint32), length, np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(inner)
    far = np.repeat(ends, length) - 1 - at
    parts = _BYTES[np.minimum(far, _NEAR - 1), data[at]]
    crc = np.bitwise_xor.reduceat(parts, np.concatenate(([0], np.cumsum(length)[:-1])))
    crc ^= _ZEROS[np.minimum(length, _NEAR)]
    for i in np.flatnonzero(length > _NEAR):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return crc, length, np.searchsorted(starts, offsets)


def features(column: pa.Array, most: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of run: the CRC-32 of all runs, and per text the index of its first run (and one more)."""
    words, length, first = word_crcs(column)
    space = np.uint32(zlib.crc32(b" "))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    runs = words
    for k in range(1, most + 1):
        if k > 1:
            if len(words) < k:
                return
            tail = joined(np.full(len(words) - k + 1, space), words[k - 1 :], length[k - 1 :])
            runs = joined(runs[: len(tail)], tail, length[k - 1 :] + 1)
        whole = owner[: len(runs)] == owner[k - 1 :]
        yield runs[whole], np.searchsorted(owner[: len(runs)][whole], np.arange(len(first)))


def bucket_counts(df: DataFrame, buckets: int = BUCKETS, most: int = 1) -> DataFrame:
    """bucket, n: the features of all texts; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches):
            for crc, _ in features(part.column(0), most):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["bucket", "n"])

    return df.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floors."""
    s, t, size = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weigh(df: DataFrame, gain: np.ndarray, most: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    size = np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, weight, words = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            for k, (crc, first) in enumerate(features(part.column(1), most)):
                sums = np.concatenate(([0], np.cumsum(gain[crc % size])))
                weight += sums[first[1:]] - sums[first[:-1]]
                n += np.diff(first)
                words = n.copy() if k == 0 else words
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw by the hash of seed and key, floors."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("bigint")


def smallest(rows: DataFrame, key: Sequence[str], k: int) -> Column:
    """The rows that hold the ``k`` smallest keys of a stored table, as a condition on its bigint columns ``key``.

    Most significant digits first: a round counts one digit of the rows between two bounds, and the bounds close in on
    the digit where the k-th row lies.  Where the rows that share a value are all wanted, or the last column of
    the key is through, it ends.
    """
    chosen, same = F.lit(False), F.lit(True)
    for name in key:
        col, left = F.col(name), k
        low, high, n = rows.filter(same).agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
        if k <= 0 or not n:
            return chosen
        if k >= n:
            return chosen | same
        while low < high:
            shift = max(0, (high - low).bit_length() - DIGIT)
            wide = "bigint" if high - low < 1 << 63 else "decimal(20,0)"
            digit = F.floor((col.cast(wide) - F.lit(low).cast(wide)) / F.lit(1 << shift).cast(wide)) if wide != "bigint" else F.shiftright(col - F.lit(low), shift)
            counts = rows.filter(same & (col >= low) & (col <= high)).groupBy(digit.cast("bigint").alias("digit")).count().collect()
            for r in sorted(counts, key=lambda r: r["digit"]):
                if left <= r["count"]:
                    low, high = low + (r["digit"] << shift), min(high, low + ((r["digit"] + 1) << shift) - 1)
                    break
                left -= r["count"]
        chosen, same, k = chosen | (same & (col < low)), same & (col == low), left
    return chosen | same


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, most: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents; ``percent`` of those with ``least`` words are drawn."""
    gain = gains(_array(bucket_counts(docs, buckets, most), buckets), _array(bucket_counts(target, buckets, most), buckets))
    scored = weigh(docs, gain, most).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    order = (-F.col("score")).alias("__score"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("__doc"), F.monotonically_increasing_id().alias("__place")
    rows = stash(scored.select("*", *order))
    fit = rows.filter(F.col("n_words") >= least)
    key = ["__score", "__doc", "__place"]
    drawn = (F.col("n_words") >= least) & smallest(fit, key, fit.count() * percent // 100)
    ranked = scan(rows.filter(drawn).select("doc_id", "n_features", "weight", "score", *key[1:]), [F.desc("score"), *key[1:]])
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, (F.col("position") + 1).alias("rank")).unionByName(rows.filter(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(table(spark, sf_dir, "documents")), pick(table(spark, sf_dir, "benchmark"), text="string"))


#: The CRC-32 in SQL: a table by rule, then a fold over the bytes.
CRC_TABLE = "(SELECT list(c ORDER BY b) FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(b)))"


def crc_sql(hex_text: str) -> str:
    """Unsigned CRC-32 of the bytes in a hex string of one byte or more; ``crc.t`` is the table."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length({hex_text}) // 2), lambda i: ('0x' || substr({hex_text}, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1])))"


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH crc AS (SELECT {CRC_TABLE} AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest({_SQL_WORDS}) AS w FROM benchmark),
k AS (SELECT w, {crc_sql('h')} % {BUCKETS} AS bucket FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)), crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (w) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + {BUCKETS}) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + {BUCKETS})))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), z),
w AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
sc AS (SELECT d.r, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
f AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {PERCENT} // 100 THEN rank END AS rank FROM sc LEFT JOIN f USING (r)
"""
