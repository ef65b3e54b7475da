"""Streams with a clock against their batch forms, and the queue."""

import threading
import time

import pytest
from pyspark.sql import Window as W, functions as F

from jatoba.operators import view
from jatoba.streaming import feed, live
from jatoba.streaming.queue import JobQueue

START = 1_700_000_000_000
EVENT = "job_id string, seq bigint, at timestamp, status string, percent bigint, stage string, detail string, started_ms bigint, position_s double, total_s double, removed boolean"


def played(spark, rows, tmp_path, files=3, **limits):
    """All rows of the feed over a log that arrives in so many files, by event time."""
    src = f"{tmp_path}/in"
    bounds = rows.agg(F.min("at"), F.max("at")).first()
    span = (bounds[1] - bounds[0]).total_seconds() + 1
    part = F.least(F.floor((F.unix_millis("at") - START) / 1000 / span * files), F.lit(files - 1)).cast("int").alias("p")
    cut = rows.withColumn("p", part).cache()
    schema = rows.schema
    for i in range(files):
        cut.filter(F.col("p") == i).drop("p").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken by time
    stream = feed.feed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), event_time=True, **limits)
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    return spark.read.schema(feed.OUT).parquet(f"{tmp_path}/out")


def log_of(spark, sf_dir):
    """Polls every three seconds, a confirmation at one in four."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id % 3 = 0")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), (n * 3.0).alias("elapsed_s"), F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("position_s"), F.lit(1000.0).alias("total_s"))


def test_progress_runs_on_as_in_the_batch_form(spark, sf_dir, tmp_path):
    log = log_of(spark, sf_dir)
    at = F.timestamp_millis((F.col("elapsed_s") * 1000).cast("bigint") + START)
    rows = log.select("job_id", "seq", at.alias("at"), F.lit("processando").alias("status"), F.lit(None).cast("bigint").alias("percent"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("detail"), F.lit(START).alias("started_ms"), "position_s", "total_s", F.lit(None).cast("boolean").alias("removed"))
    out = played(spark, rows, tmp_path).filter("kind = 'progress'")
    want = live.paced_ahead(log)
    key = lambda df: sorted((r["job_id"], r["seq"], round(r["progress"], 6)) for r in df.collect())
    a, b = key(out), key(want)
    assert len(a) == len(b) > 50, (len(a), len(b))
    assert a == b


def beats(times, end, beat=15.0):
    out, sent = [], times[0]
    for t in [*times[1:], end]:
        while sent + beat < t:
            sent += beat
            out.append(sent)
        sent = t
    return out


def test_pings_statuses_and_removals(spark, tmp_path):
    T0 = START / 1000
    said = {"a": [0, 4, 50, 51], "b": [2, 9, 12], "c": [1, 90], "clock": [0, 60, 118, 119]}
    rows = []
    for job, times in said.items():
        for k, t in enumerate(times):
            end = job == "a" and k == 3
            rows.append((job, k, float(t), "concluido" if end else "processando", k, None, None, None, None, None, job == "b" and k == 2))
    df = spark.createDataFrame(rows, EVENT.replace("at timestamp", "t double")).select("job_id", "seq", F.timestamp_seconds(F.col("t") + T0).alias("at"), "status", "percent", "stage", "detail", "started_ms", "position_s", "total_s", "removed")
    got = [r for r in played(spark, df, tmp_path).collect()]
    pings = {j: sorted(r["at_ms"] / 1000 - T0 for r in got if r["job_id"] == j and r["kind"] == "ping") for j in said}
    assert pings["a"] == beats([0, 4, 50, 51], 51) and pings["b"] == [] and pings["c"] == beats([1, 90], 119)
    assert [(r["job_id"], r["message"]) for r in got if r["kind"] == "removida"] == [("b", "Tarefa removida.")]
    assert [(r["job_id"], r["status"]) for r in got if r["kind"] == "fim"] == [("a", "concluido")]
    assert sum(r["kind"] == "status" for r in got) == 4 + 2 + 2 + 4


def test_removed_jobs_as_in_the_batch_form(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("job_id")).distinct()
    there = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("job_id"))
    want = sorted((r["job_id"], r["message"]) for r in view.removed(orders, there).collect())
    gone = orders.join(there, "job_id", "left_anti").select("job_id", F.lit(2).alias("seq"), F.lit(START + 9000).alias("ms"), F.lit(True).alias("removed"))
    seen = orders.select("job_id", F.lit(1).alias("seq"), F.lit(START).alias("ms"), F.lit(None).cast("boolean").alias("removed"))
    rows = seen.unionByName(gone).select("job_id", F.col("seq").cast("bigint").alias("seq"), F.timestamp_millis("ms").alias("at"), F.lit("processando").alias("status"), *(F.lit(None).cast(k).alias(c) for c, k in (("percent", "bigint"), ("stage", "string"), ("detail", "string"), ("started_ms", "bigint"), ("position_s", "double"), ("total_s", "double"))), "removed")
    out = played(spark, rows, tmp_path, files=2)
    assert sorted((r["job_id"], r["message"]) for r in out.filter("kind = 'removida'").collect()) == want and want


def test_three_jobs_in_order_the_second_cancelled(spark, tmp_path):
    queue, order, running = JobQueue(spark, f"{tmp_path}/queue"), [], threading.Event()

    def run(session, job):
        order.append(job["job_id"])
        if job["job_id"] == "dois":
            running.set()
            session.range(8).repartition(2).rdd.foreachPartition(lambda _: time.sleep(60))
        session.range(10).write.mode("overwrite").parquet(f"{tmp_path}/out/{job['job_id']}")

    for job in ("um", "dois", "tres", "quatro"):
        queue.submit(job, {"n": 1})
    with pytest.raises(FileExistsError):
        queue.submit("um")
    assert queue.cancel("quatro") and queue.status("tres") == "na_fila" and not queue.cancel("nenhum")
    began = time.time()
    stream = queue.work(run, None)
    assert running.wait(60)
    time.sleep(0.5)
    assert queue.status("dois") == "processando" and queue.cancel("dois") and not queue.cancel("dois")
    assert stream.awaitTermination(90) and time.time() - began < 50
    assert order == ["um", "dois", "tres"]
    assert {j: queue.status(j) for j in ("um", "dois", "tres", "quatro")} == {"um": "concluido", "dois": "cancelado", "tres": "concluido", "quatro": "cancelado"}
    assert queue.how("dois")["message"] == "" and not queue.cancel("um")
    queue.submit("cinco")
    queue.submit("erro")

    def broken(session, job):
        order.append(job["job_id"])
        if job["job_id"] == "erro":
            raise ValueError("no audio")

    assert queue.work(broken, None).awaitTermination(60)  # goes on where it stopped
    assert order[3:] == ["cinco", "erro"] and queue.how("erro")["message"] == "no audio" and queue.status("cinco") == "concluido"
