"""The pipeline against its stages done by plain means on the small table."""

import corpus_pipeline as cp
from jatoba.llm import pii
from jatoba.llm.common import table


def test_stages_keep_columns_and_drop_what_they_say(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0 < len(kept) < len(before) and set(kept) < set(before)
    assert all("@mail" not in t for t in kept.values() if t)
    same = [d for d, t in kept.items() if t == before[d]]
    assert all(not pii.base_spans(before[d]) for d in same)


def test_run_packs_what_is_left(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert rows and max(map(sum, by.values())) <= 2048


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty, long and repeated texts, clashing columns; the near-copy stage equals brute force."""
    import hashlib

    from test_llm import WORD, brute_labels, odd_docs

    docs, rows = odd_docs(spark)
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "DOC_LEN", "score"]
        kept[name] = sorted(str((r["doc_id"], r["text"])) for r in docs.collect())
    assert kept["toxicity"] == sorted(map(str, rows))  # none of these is toxic
    want = []
    label = brute_labels(rows, 5, 8, 10)
    for c in set(label):
        group = [r for r, x in zip(rows, label, strict=True) if x == c]
        want += [min(group, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))] if WORD.findall(group[0][1] or "") else group
    assert kept["near_copies"] == kept["decontamination"] == kept["personal_data"] == sorted(map(str, want))
    packed = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in want}


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir) if docs is not None else docs
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_texts_reach_workers_in_bounded_batches(spark, sf_dir):
    """After any stage that makes workers read texts, a partition of 32 MB is not one batch; a longer text is one."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from jatoba.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    docs = spark.range(4000).coalesce(1).select(F.col("id").alias("doc_id"), F.expr("repeat('abcdefg ', 1000 + if(id = 3999, 1000000, 0))").alias("text"))
    for name in ("toxicity", "near_copies", "personal_data", "packing"):
        spark.conf.unset(common._BATCH_CONF)
        dict(cp.STAGES)[name](spark, table(spark, sf_dir, "documents").limit(50), sf_dir)
        rows = docs.mapInArrow(sizes, "n bigint, bytes bigint").collect()
        assert sum(r["n"] for r in rows) == 4000 and len(rows) >= 8
        assert max(r["bytes"] for r in rows[:-1]) < 2 * common.BATCH_BYTES
    spark.conf.set(common._BATCH_CONF, "1000000")
    common.bound_batches(spark)
    assert spark.conf.get(common._BATCH_CONF) == "1000000"
    spark.conf.unset(common._BATCH_CONF)


def test_packing_plan_is_no_job_of_rdd_workers(spark):
    """Rows from the driver are local relations: no Python RDD starts workers that idle beside those of Arrow."""
    from jatoba.llm import packing

    cut = spark.range(100).selectExpr("id as doc_id", "cast(0 as int) as piece", "0L as start", "10 + id % 7 as length", "id as ids_crc32")
    packed = packing.pack(cut)
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()
    assert packed.count() == 100 and packing.pack(cut.limit(0)).count() == 0


def test_sets_are_hashed_in_little_memory():
    """Hashing 4 MB of texts takes less than 16 MB at a time, and the sets are those of each text alone."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from jatoba.llm import hashing, jaccard

    texts = [" ".join(f"w{(i * 7 + j) % 9973}" for j in range(350)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    hashing._powers = (np.empty(0, np.uint64), np.empty(0, np.uint64))
    tracemalloc.start()
    try:
        sizes = [len(h) for _, h in jaccard._distinct_sets(iter([batch]), 5)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes == [len(next(jaccard.set_hashes(batch.slice(i, 1), 5))) for i in range(2000)]
    assert peak < 16 << 20, peak
