"""Background jobs: a bounded registry with progress, results and waiting."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schema
from tessera.plans.catalog import now_iso

KEPT = 100
ACTIVE = ("pending", "running")


@dataclass
class Job:
    kind: str
    project: str
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    status: str = "pending"
    progress: int = 0
    total: int = 0
    message: str = ""
    result: dict | None = None
    error: str | None = None
    started_at: str = field(default_factory=now_iso)
    updated_at: str = field(default_factory=now_iso)
    completed_at: str | None = None


def newest(jobs: DataFrame, active, by: str = "project", at: str = "started_at", key: str = "id", status: str = "status") -> DataFrame:
    """Of each project the newest of the jobs whose status is among the active ones (a list, or a table with that column)."""
    live = jobs.where(F.col(status).isin(*active)) if isinstance(active, (list, tuple)) else jobs.join(active, status, "left_semi")
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(key))
    return live.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


class Cancelled(Exception):
    """Raised in a job's work once it is cancelled."""


class Jobs:
    """notify(title, message) is told of ends; its failures are ignored. spark: its session, whose work a cancelled job interrupts."""

    def __init__(self, notify: Callable[[str, str], None] | None = None, spark: SparkSession | None = None):
        self._spark, self._stopped = spark, set[str]()
        self._jobs: dict[str, Job] = {}
        self._ends: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        self._busy: dict[str, threading.Lock] = {}
        self._notify = notify

    def start(self, kind: str, project: str, work: Callable[[Callable[[int, int, str], None]], dict]) -> Job:
        """Run work(progress) in a thread of its own; jobs on one project wait for each other."""
        job = Job(kind, project)
        with self._lock:
            self._jobs[job.id] = job
            self._ends[job.id] = threading.Event()
            self._evict()
        threading.Thread(target=self._run, args=(job, work), daemon=True).start()
        return job

    def _evict(self) -> None:
        finished = sorted((j for j in self._jobs.values() if j.status not in ACTIVE), key=lambda j: j.started_at)
        for j in finished[: max(0, len(self._jobs) - KEPT)]:
            del self._jobs[j.id], self._ends[j.id]

    def _set(self, job: Job, **changes) -> None:
        with self._lock:
            for k, v in changes.items():
                setattr(job, k, v)
            job.updated_at = now_iso()

    @contextmanager
    def alone(self, project: str) -> Iterator[None]:
        """While no job works on the project."""
        with self._lock:
            busy = self._busy.setdefault(project, threading.Lock())
        with busy:
            yield

    def cancel(self, job_id: str) -> dict:
        """Stop a job that has not ended: its Spark work is interrupted, and what it hasn't committed is not seen."""
        with self._lock:
            job = self._jobs.get(job_id)
            if job and job.status in ACTIVE:
                self._stopped.add(job_id)
        if job_id in self._stopped and self._spark:
            self._spark.sparkContext.cancelJobsWithTag(job_id)
        return self.get(job_id)

    def _run(self, job: Job, work) -> None:
        end = self._ends[job.id]

        def progress(done: int, total: int, message: str) -> None:
            self._go_on(job)
            self._set(job, progress=done, total=total, message=message)

        try:
            with self.alone(job.project):
                self._go_on(job)
                if self._spark:
                    self._spark.sparkContext.addJobTag(job.id)  # of this thread
                self._set(job, status="running")
                result = work(progress)
            self._set(job, status="completed", result=result, completed_at=now_iso())
            self._tell(f"{job.kind} finished", f"{job.project}: {result}")
        except Exception as e:  # the job reports it
            stopped = job.id in self._stopped
            self._set(job, status="cancelled" if stopped else "failed", error=None if stopped else f"{type(e).__name__}: {e}", completed_at=now_iso())
            self._tell(f"{job.kind} {job.status}", f"{job.project}: {'' if stopped else str(e)[:160]}")
        finally:
            self._stopped.discard(job.id)
            end.set()

    def _go_on(self, job: Job) -> None:
        if job.id in self._stopped:
            raise Cancelled(job.id)

    def _tell(self, title: str, message: str) -> None:
        try:
            if self._notify:
                self._notify(title[:60], message[:240])
        except Exception:  # a notice is no part of the job
            pass

    def get(self, job_id: str) -> dict:
        with self._lock:
            job = self._jobs.get(job_id)
            return asdict(job) if job else {"error": f"unknown job: {job_id}"}

    def wait(self, job_id: str, timeout: float = 25) -> dict:
        """The job when it ends, or as it stands after the timeout, which is held to 0.5 .. 60 seconds."""
        end = self._ends.get(job_id)
        if end:
            end.wait(min(60.0, max(0.5, timeout)))
        return self.get(job_id)

    def list(self, active_only: bool = False) -> list[dict]:
        """Newest first."""
        with self._lock:
            jobs = [asdict(j) for j in self._jobs.values() if not active_only or j.status in ACTIVE]
        return sorted(jobs, key=lambda j: j["started_at"], reverse=True)

    def table(self, spark: SparkSession, active_only: bool = False) -> DataFrame:
        kind = schema.struct(schema.JOBS)
        rows = [{**j, "result": None if j["result"] is None else {k: str(v) for k, v in j["result"].items()}} for j in self.list(active_only)]
        return spark.createDataFrame([tuple(r[n] for n in kind.names) for r in rows], kind)
