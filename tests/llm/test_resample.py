"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_llm import odd_docs

from jatoba.llm import resample
from jatoba.llm.scan import folded, scan

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, most):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, percent, least, buckets, most, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for g in grams(x, most)[1]:
                counts[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, x in rows:
        w, f = grams(x, most)
        weight = sum(gain[bucket(g)] for g in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = i + 1
    return sorted((str(r[:5]) for r in out))


@pytest.mark.parametrize(("percent", "least", "buckets", "most"), [(10, 20, 10_000, 1), (50, 0, 64, 3), (100, 5, 1000, 2), (0, 20, 10, 1)])
def test_resampling_against_a_plain_version(spark, percent, least, buckets, most):
    docs, rows = odd_docs(spark)
    target = ["w1 W2-w3 w4", None, "", "É w7 w8 " + "x" * 70]
    got = resample.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent, least, buckets, most, 7)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(str(list(r)) for r in got.collect()) == plain(rows, target, percent, least, buckets, most, 7)


def test_query_equals_a_plain_version(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(str(list(r)) for r in resample.query(spark, sf_dir).collect()) == plain(rows, target, 10, 20, 10_000, 1, 2024)


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resample.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert [list(r) for r in resample.resample(one, none.select("text"), least=0).select("doc_id", "n_features", "rank").collect()] == [[1, 2, None]]


def test_crcs_of_words_and_runs():
    texts = ["Ab c", None, "", "é" * 40 + " z", "x" * 25, "...", "q " * 300, "a"]
    at, want = [0] * 5, [[] for _ in range(5)]
    for k, (crc, first) in enumerate(resample.features(pa.array(texts), 5)):
        for t, a, b in zip(texts, first, first[1:], strict=False):
            w = grams(t, 1)[0]
            assert crc[a:b].tolist() == [zlib.crc32(" ".join(w[i : i + k + 1]).encode()) for i in range(len(w) - k)]
            at[k] += b - a
            want[k].append(max(0, len(w) - k))
    assert at == [sum(x) for x in want]


def test_smallest_keys_with_extremes_and_ties(spark):
    rng = np.random.default_rng(3)
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(int(a), int(b)) for a, b in zip(rng.choice([low, -1, 0, 7, high], 400), rng.integers(-5, 5, 400), strict=True)] + [(low, low), (high, high)]
    rows = [(a, b, i) for i, (a, b) in enumerate(rows)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, i bigint").cache()
    for k in (0, 1, 57, 200, 333, 402, 500):
        assert sorted(map(tuple, df.filter(resample.smallest(df, ["a", "b", "i"], k)).collect())) == sorted(rows)[:k]


def test_scan_adds_up_in_order(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(-9, 9, 500))]
    df = spark.createDataFrame(rows, "i bigint, v bigint").repartition(7)
    got = scan(df, ["i"], sums=["v"], xors=["i"]).orderBy("i").collect()
    assert [r["position"] for r in got] == list(range(500))
    assert [r["v_upto"] for r in got] == np.cumsum([v for _, v in rows]).tolist()
    assert [r["i_upto"] for r in got] == np.bitwise_xor.accumulate(np.arange(500)).tolist()
    assert scan(df.limit(0), ["i"], sums=["v"]).count() == 0


def test_arrays_of_tasks_are_folded(spark):
    rng = np.random.default_rng(4)
    rows = [(int(p), rng.integers(0, 255, 40).astype("u1").tobytes()) for p in rng.integers(0, 5, 300)]
    df = spark.createDataFrame(rows, "part int, v binary").repartition(9)
    for combine in (np.bitwise_or, np.add):
        got = folded(df, combine, "u1").collect()
        want = {p: combine.reduce([np.frombuffer(v, "u1") for q, v in rows if q == p], dtype="u1") for p in {p for p, _ in rows}}
        assert {r["part"]: r["v"] for r in got} == {p: bytearray(v.tobytes()) for p, v in want.items()}
    assert folded(df.limit(0), np.add, "u1").count() == 0
