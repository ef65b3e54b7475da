from jatoba.streaming import live

EVENTS = [("a", 1, "processando", 1, "x", "y"), ("a", 2, "processando", 1, "x", "y"), ("a", 3, "processando", 2, "x", "y"), ("b", 1, "na_fila", 0, "", ""), ("a", 4, "concluido", 100, "x", "y"), ("a", 5, "concluido", 100, "x", "y")]
SCHEMA = "job_id string, seq bigint, status string, percent bigint, stage string, detail string"


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in (0, 3):
        spark.createDataFrame(EVENTS[i : i + 3], SCHEMA).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    q = live.status_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in live.status_changes_batch(spark.createDataFrame(EVENTS, SCHEMA)).collect())
    assert [r[:2] for r in want] == [("a", 1), ("a", 3), ("a", 4), ("a", 5), ("b", 1)]
    assert {r[:3] for r in got} == {r[:3] for r in want}


def test_pacing_never_goes_back(spark):
    rows = [("a", i, float(p), 100.0) for i, p in enumerate((1, 50, 20, 99))]
    out = [r["progress"] for r in live.paced(spark.createDataFrame(rows, "job_id string, seq bigint, position_s double, total_s double")).orderBy("seq").collect()]
    assert out == sorted(out) and out[-1] <= 94
