"""Driver-side orchestration: tagged jobs with progress and cancel (UD10), review sessions (UD13)."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescribe.functions.numeric import fingerprint, table_fingerprint
from tidescribe.operators import mapping
from tidescribe.sources.sinks import BoundedLog


@dataclass
class Job:
    name: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    state: str = "queued"
    progress: float = 0.0
    error: str | None = None
    log: BoundedLog = field(default_factory=BoundedLog)


class JobRunner:
    """UD10: runs steps one job at a time; a cancel stops the Spark jobs under its tag."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs, self._lock = spark, {}, threading.Lock()

    def submit(self, name: str, steps: list[Callable[[], object]]) -> Job:
        job = Job(name)
        self.jobs[job.id] = job
        threading.Thread(target=self._run, args=(job, steps), daemon=True).start()
        return job

    def _run(self, job: Job, steps: list[Callable[[], object]]) -> None:
        with self._lock:
            if job.state == "cancelled":
                return
            job.state = "running"
            self.spark.addTag(job.id)
            try:
                for i, step in enumerate(steps, 1):
                    if job.state == "cancelled":
                        return
                    job.log.emit(f"step {i} of {len(steps)}")
                    step()
                    job.progress = i / len(steps)
                job.state = "done" if job.state == "running" else job.state
            except Exception as e:  # the error belongs to the job, not to the runner
                if job.state != "cancelled":
                    job.state, job.error = "failed", str(e)[:2000]
            finally:
                self.spark.removeTag(job.id)

    def cancel(self, job_id: str) -> None:
        self.jobs[job_id].state = "cancelled"
        self.spark.interruptTag(job_id)


@dataclass(frozen=True)
class ReviewSession:
    """UD13: reviews bound to the metadata and the manifest they were made for."""

    metadata_key: str
    manifest_key: str
    reviews: DataFrame

    def current(self) -> DataFrame:
        return mapping.current_reviews(self.reviews)


def open_session(metadata: DataFrame, manifest: DataFrame, reviews: DataFrame | None, bound: dict | None, order: str = "key") -> ReviewSession:
    """UD13: create or resume; reviews bound to other metadata or another manifest raise."""
    keys = table_fingerprint(metadata, [order]), table_fingerprint(manifest, [order])
    if bound and (bound["metadata"], bound["manifest"]) != keys:
        raise ValueError("the reviews belong to other metadata or another manifest")
    if reviews is None:
        reviews = metadata.sparkSession.createDataFrame([], "line long, key string, saved_at string, reviewer string, action string, label string")
    return ReviewSession(*keys, reviews)


def migrate_keys(reviews: DataFrame, metadata: DataFrame) -> DataFrame:
    """UD13, JN12: reviews of the first version (``source_uri`` only) get the key of the record with that uri."""
    known = metadata.groupBy(F.col("uri").alias("source_uri")).agg(F.min("key").alias("new_key"), F.count("*").alias("n")).filter("n = 1")
    return reviews.join(known, "source_uri", "left").withColumn("key", F.coalesce("key", "new_key")).drop("new_key", "n")


def session_name(settings: dict) -> str:
    """A stable name of a run's settings."""
    return f"run-{fingerprint(settings)}"
