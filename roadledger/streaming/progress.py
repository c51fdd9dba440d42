"""Progress of streaming jobs: a listener that hands every micro-batch to a callback, and a table of job states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from roadledger.operators import ledger

UPDATES = "job_id string, seq bigint, status string, done bigint, error string"


class JobTable:
    """The states of jobs as a table of updates: any session can poll it while a job runs.

    report is made for Progress. Updates are numbered in the order that this object got them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seq = spark, path, 0

    def report(self, job: str, status: str, done: int, error: str | None) -> None:
        self.seq += 1
        self.spark.createDataFrame([(job, self.seq, status, done, error)], UPDATES).coalesce(1).write.mode("append").parquet(self.path)

    def states(self) -> DataFrame:
        """(job_id, status, done, error): the newest of each job."""
        return ledger.latest_jobs(self.spark.read.schema(UPDATES).parquet(self.path))


class Progress(StreamingQueryListener):
    """Calls report(job, status, rows so far, error) as a query starts, advances and ends."""

    def __init__(self, report: Callable[[str, str, int, str | None], None]):
        self.report = report
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = 0
        self.report(str(event.id), "running", 0, None)

    def onQueryProgress(self, event) -> None:
        job = str(event.progress.id)
        self.rows[job] = self.rows.get(job, 0) + event.progress.numInputRows
        self.report(job, "running", self.rows[job], None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        job = str(event.id)
        self.report(job, "error" if event.exception else "done", self.rows.pop(job, 0), event.exception)
