"""A queue of jobs, first come first served, one at a time, that can be cancelled.

A job is a file; one stream with one consumer admits one file a trigger, so a waiting job holds no executor, and a
restart goes on where the checkpoint ends.  Its work runs under a job tag: cancelling cancels the Spark jobs of that
tag, or, while the job waits, keeps it from starting.  How a job ended is written once, by whoever comes first.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery

from jatoba.operators.snapshot import Folder
from jatoba.streaming.live import TERMINAL

JOB = "job_id string, created_ms bigint, payload string"


class JobQueue:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)

    def submit(self, job_id: str, payload: dict | None = None) -> None:
        """Put a job at the end; an error if there is one of that name."""
        created = time.time_ns()
        self.folder.publish(f"known/{job_id}", str(created))
        self.folder.publish(f"jobs/{created:020d}-{job_id}.json", json.dumps({"job_id": job_id, "created_ms": created // 1_000_000, "payload": json.dumps(payload or {})}))

    def work(self, run: Callable[[SparkSession, Row], None], every: str | None = "1 second") -> StreamingQuery:
        """Start the consumer.  ``run`` does one job; with ``every`` None it stops when the queue is empty."""
        waiting = self.spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).json(f"{self.root}/jobs")
        trigger = {"processingTime": every} if every else {"availableNow": True}

        def one(batch: DataFrame, _: int) -> None:
            for job in batch.collect():  # one file, one job
                self._run(batch.sparkSession, job, run)

        return waiting.writeStream.foreachBatch(one).option("checkpointLocation", f"{self.root}/progress").trigger(**trigger).start()

    def _run(self, spark: SparkSession, job: Row, run: Callable[[SparkSession, Row], None]) -> None:
        if self.status(job["job_id"]) in TERMINAL:  # cancelled while it waited, or done before a restart
            return
        tag, sc = self.tag(job["job_id"]), spark.sparkContext
        if not self.folder.names(f"started/{job['job_id']}"):
            self.folder.publish(f"started/{job['job_id']}/at", str(time.time_ns()))
        sc.addJobTag(tag)
        try:
            run(spark, job)
            self._end(job["job_id"], "concluido")
        except Exception as e:  # the next job has its turn
            self._end(job["job_id"], "erro", str(e)[:500])
        finally:
            sc.removeJobTag(tag)

    def cancel(self, job_id: str) -> bool:
        """False if the job is unknown or has ended."""
        if self.status(job_id) in (None, *TERMINAL) or not self._end(job_id, "cancelado"):
            return False
        self.spark.sparkContext.cancelJobsWithTag(self.tag(job_id))
        return True

    def status(self, job_id: str) -> str | None:
        if self.folder.names(f"ended/{job_id}"):
            return json.loads(self.folder.read(f"ended/{job_id}/how"))["status"]
        if self.folder.names(f"started/{job_id}"):
            return "processando"
        return "na_fila" if job_id in self.folder.names("known") else None

    def how(self, job_id: str) -> dict:
        return json.loads(self.folder.read(f"ended/{job_id}/how"))

    def _end(self, job_id: str, status: str, message: str = "") -> bool:
        try:
            self.folder.publish(f"ended/{job_id}/how", json.dumps({"status": status, "message": message, "at_ms": time.time_ns() // 1_000_000}))
        except FileExistsError:
            return False
        return True

    @staticmethod
    def tag(job_id: str) -> str:
        return f"job-{job_id}"
