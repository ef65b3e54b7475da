"""The registered queries of the operators: columns, types and rows, against plain versions where these are short."""

import hashlib
import re
import zlib

import pytest
from test_llm import WORD, brute_labels

from jatoba.llm.registry import QUERIES

TYPES = {
    "op1_toxicity_segments": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_rendezvous_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_fm_index_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7_semi_markov_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_random_indexing_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_jaccard_metric_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_p_stable_near_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
}


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


@pytest.mark.parametrize("name", TYPES)
def test_columns_and_rows(spark, rows, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    kinds = dict(df.dtypes)
    assert [(c, kinds.get(c)) for c, _ in (x.split() for x in TYPES[name].split(", "))] == [tuple(x.split()) for x in TYPES[name].split(", ")]
    got = df.collect()
    ids = [r[0] for r in got]
    if name == "op10_p_stable_near_vectors":
        assert len(set(ids)) == len(ids) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    else:
        assert set(ids) == set(rows) and (name == "op6_best_fit_packing" or len(ids) == len(rows))
    check = CHECKS.get(name)
    if check:
        check(got, rows)


def sharding(got, rows):
    crc = lambda s: zlib.crc32(s.encode())
    slots: dict[int, list[int]] = {}
    for r in got:
        text = rows[r["doc_id"]] or ""
        best = lambda n, d=r["doc_id"]: max(range(n), key=lambda s: (int(hashlib.md5(f"{d}:{s}".encode()).hexdigest()[:13], 16), -s))
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text.encode()) + 1, crc(text), "key")
        assert (r["shard"], r["grown_shard"]) == (best(16), best(17)) and r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16


def substrings(got, rows):
    words = {d: WORD.findall(t or "") for d, t in rows.items()}
    least: dict[tuple, int] = {}
    for d, w in words.items():
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(d, least.get(key, d))
    for r in got:
        w = words[r["doc_id"]]
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < r["doc_id"]:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def near_sets(got, rows):
    names = list(rows.items())
    label = brute_labels(names, 3, 90, 100)
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    for (d, t), c in zip(names, label, strict=True):
        w = WORD.findall(low(t))
        n = len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) >= 3 else int(bool(w))
        r = next(x for x in got if x["doc_id"] == d)
        group = [names[i][0] for i, x in enumerate(label) if x == c]
        assert (r["n_shingles"], r["component_id"]) == (n, min(group) if n else d)


def held(parts, rest, cut):
    def check(got, rows):
        for r in got:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)

    return check


CHECKS = {"op1_toxicity_segments": held(4, 2, 0.3), "op8_random_indexing_quality": held(3, 1, 0.5), "op2_rendezvous_sharding": sharding, "op4_fm_index_dedup": substrings, "op9_jaccard_metric_join": near_sets}


CLASHES = ("score", "shard", "slot", "size", "label", "held_out", "predicted", "bucket", "position", "rank", "segments", "TEXT_", "n")


@pytest.mark.parametrize("name", ["op1_toxicity_segments", "op2_rendezvous_sharding", "op8_random_indexing_quality", "op11_importance_resampling", "op12_string_kernel_language"])
def test_clashing_columns_and_empty_tables(spark, tmp_path, name):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for kind, rows in (("more", docs.select("*", *(F.lit("x").alias(c) for c in CLASHES))), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{kind}/documents.parquet")
        for other in ("labels", "benchmark"):
            t = spark.read.parquet(f"{sf}/{other}.parquet")
            (t if kind == "more" else t.limit(0)).write.parquet(f"{tmp_path}/{kind}/{other}.parquet")
    show = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.drop("slot").collect())
    assert show(QUERIES[name](spark, f"{tmp_path}/more")) == show(QUERIES[name](spark, sf))
    assert QUERIES[name](spark, f"{tmp_path}/none").count() == 0
