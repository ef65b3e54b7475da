"""Ranks, summaries, positions and folds against plain versions."""

import datetime
import math
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from jatoba.operators import analytics, sequence
from jatoba.functions import text as T
from jatoba.sources import adapters


def plain_vectors(lists):
    n, df = len(lists), {}
    for words in lists:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = []
    for words in lists:
        v = {w: (1 + math.log(words.count(w))) * math.log(1 + n / df[w]) for w in set(words)}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append({w: x / norm for w, x in v.items()})
    return out, df


def plain_ranks(vectors, df):
    """The dense graph, all pairs."""
    n = len(vectors)
    if n <= 1:
        return [1.0] * n
    ok = {w for w, c in df.items() if c <= max(2, int(0.35 * n))}
    a = np.array([[0.0 if i == j else sum(x * v.get(w, 0.0) for w, x in u.items() if w in ok) for j, v in enumerate(vectors)] for i, u in enumerate(vectors)])
    total, r = a.sum(1), np.full(n, 1 / n)
    flow = np.divide(a, total[:, None], out=np.zeros_like(a), where=total[:, None] > 0)
    for _ in range(32):
        r = 0.15 / n + 0.85 * (r @ flow)
    return r


def sentences(spark, sf_dir):
    """Longer recordings: all turns of ten conversations are one."""
    segs = adapters.segments(spark, sf_dir).select((F.col("rec_id") % 3).alias("rec_id"), (F.col("rec_id") * 1000 + F.col("seg_id")).alias("seg_id"), F.explode(F.split("text", r"(?<=[.?]) ")).alias("text"))
    return segs.groupBy("rec_id", "seg_id").agg(F.first("text").alias("text")).filter("text <> ''")


def test_ranks_and_summary_against_all_pairs(spark, sf_dir):
    units = sentences(spark, sf_dir).cache()
    rows = units.select("rec_id", "seg_id", "text", T.tokens(F.col("text")).alias("t"), T.word_count(F.col("text")).alias("n")).collect()
    ranks = {(r["rec_id"], r["seg_id"]): r["rank"] for r in analytics.textrank(units).collect()}
    got = {(r["rec_id"], r["seg_id"]) for r in analytics.summarize(units).collect()}
    want = set()
    for rec in {r["rec_id"] for r in rows}:
        own = sorted((r for r in rows if r["rec_id"] == rec), key=lambda r: r["seg_id"])
        assert len(own) > 20
        vectors, df = plain_vectors([list(r["t"]) for r in own])
        assert np.allclose(plain_ranks(vectors, df), [ranks[rec, r["seg_id"]] for r in own], atol=1e-12)
        usable = [r for r in own if r["n"] >= 5]
        vectors, df = plain_vectors([list(r["t"]) for r in usable])
        score = [round(x * min(1, r["n"] / 14) * (0.7 if r["n"] > 45 else 1), 12) for x, r in zip(plain_ranks(vectors, df), usable, strict=True)]
        chosen = []
        for _, k in sorted(zip(score, range(len(usable)), strict=True), reverse=True):
            if len(chosen) < 7 and all(sum(x * vectors[c].get(w, 0) for w, x in vectors[k].items()) <= 0.55 for c in chosen):
                chosen.append(k)
        want |= {(rec, usable[k]["seg_id"]) for k in chosen}
    assert got == want


def test_units_without_neighbours_or_terms():
    none = analytics._Vectors(np.array([], int), np.array([], np.int64), np.array([]), 3)
    assert np.allclose(none.ranks(), 0.15 / 3) and none.choose(np.array([1.0, 3.0, 2.0]), 2) == [1, 2]
    alone = analytics._Vectors(np.array([0, 1, 1, 2, 2]), np.array([7, 1, 2, 1, 3]), np.array([1.0, 0.6, 0.8, 0.6, 0.8]), 4)
    r = alone.ranks()
    assert np.isclose(r[0], 0.15 / 4) and np.isclose(r[3], 0.15 / 4) and np.isclose(r[1], r[2]) and r[1] > r[0]


def test_a_long_recording_stays_small():
    """50,000 sentences of twelve terms; some terms are in a third of them."""
    rng = np.random.default_rng(2)
    n = 50_000
    term = np.concatenate([rng.zipf(1.3, (n, 11)) % 60_000, (rng.random((n, 1)) < 0.33).astype(int) * 70_000 + 1], axis=1)
    unit = np.repeat(np.arange(n), 12)
    pair = np.unique(unit * 100_000 + term.ravel())
    v = analytics._Vectors(pair // 100_000, pair % 100_000, rng.random(len(pair)), n)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    r = v.ranks()
    assert abs(r.sum() - 1) < 0.05 and len(v.choose(r, 7)) == 7
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


def test_positions_without_gathering(spark):
    rng = np.random.default_rng(5)
    day = datetime.date(2024, 1, 1)
    for ranges, spread in ((4, 3), (16, 200), (5, 1)):
        rows = [(int(i), day + datetime.timedelta(days=int(d)), "na_fila") for i, d in enumerate(rng.integers(0, spread, 500))]
        rows += [(500 + i, day, "na_fila") for i in range(250)] + [(800 + i, None, "na_fila") for i in range(3)]
        rng.shuffle(rows)
        df = spark.createDataFrame([(int(a), b, c) for a, b, c in rows], "job_id bigint, created_at date, status string").repartition(5)
        got = sequence.positions(df, "created_at", "job_id", ranges).collect()
        want = sorted(((b is not None, b, a) if b else (False, day, a) for a, b, _ in rows))
        assert {r["job_id"]: r["position"] for r in got} == {a: i + 1 for i, (_, _, a) in enumerate(want)}
    plan = sequence.queue_position(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert sequence.queue_position(df.filter("status = 'x'")).count() == 0


@pytest.mark.parametrize("what", [analytics.keywords, analytics.vectors, analytics.document_frequency])
def test_words_are_made_in_all_partitions(spark, what):
    """Texts are few bytes to a shuffle, and their words many rows: the partitions they are made in are not put together by bytes."""
    units = spark.createDataFrame([(r, i, f"nota fiscal {r} contrato") for r in range(40) for i in range(3)], "rec_id bigint, seg_id bigint, text string")
    before = what(units)
    at = before.select("rec_id", F.spark_partition_id().alias("p"))
    used = {p for _, p in at.collect()}
    assert len(used) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_segments_stay_in_all_partitions(spark, sf_dir):
    """What chapters, summaries and documents make of a recording is made where its segments are."""
    from jatoba.plans import registry

    segs = adapters.segments(spark, sf_dir)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (segs, registry._sentences(spark, sf_dir), analytics.topic_blocks(registry._sentences(spark, sf_dir))):
        assert rows.select(F.spark_partition_id().alias("p"), F.col("text")).select("p").distinct().count() == parts
