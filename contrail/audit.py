"""Audit rows of jobs, of those that fail too, in a table that is only appended to."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from contrail.sources.payloads import job_run_record


def _now() -> datetime:
    return datetime.now(timezone.utc)


@contextmanager
def audited(spark: SparkSession, path: str, run_type: str, now: Callable[[], datetime] = _now) -> Iterator[dict]:
    """Appends a row to the audit table at path when the block ends; the block puts its counters into the dictionary it gets.

    A block that raises still leaves a row, of status 'error' with the counters so far and the error's text, and goes on raising.
    """
    counters, began, error = {}, now(), None
    try:
        yield counters
    except BaseException as raised:
        error = str(raised) or type(raised).__name__
        raise
    finally:
        job_run_record(spark, run_type, began, now(), counters, error).coalesce(1).write.mode("append").parquet(path)


class StreamAudit(StreamingQueryListener):
    """Turns streaming queries into audit rows; spark.streams.addListener takes it.

    A named query is a run type; others and those not in `run_types`, if given, are left out. Each batch that has rows leaves
    a row with what df.observe(`metrics`, ...) counted under the names of job_run_record's counters; a query that fails leaves one with its error.
    """

    def __init__(self, spark: SparkSession, path: str, run_types: tuple[str, ...] | None = None, metrics: str = "audit"):
        self.spark, self.path, self.run_types, self.metrics, self.names = spark, path, run_types, metrics, {}

    def onQueryStarted(self, event) -> None:
        if event.name and (self.run_types is None or event.name in self.run_types):
            self.names[str(event.runId)] = event.name, _now()

    def onQueryProgress(self, event) -> None:
        run = event.progress
        if str(run.runId) in self.names and run.numInputRows:
            began = datetime.fromisoformat(run.timestamp.replace("Z", "+00:00"))
            seen = run.observedMetrics.get(self.metrics)
            self.write(run.name, began, seen.asDict() if seen else {}, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name, began = self.names.pop(str(event.runId), (None, None))
        if name and event.exception:
            self.write(name, began, {}, event.exception)

    def write(self, name: str, began: datetime, counters: dict, error: str | None) -> None:
        counters = {k: v or 0 for k, v in counters.items()}
        job_run_record(self.spark, name, began, _now(), counters, error).coalesce(1).write.mode("append").parquet(self.path)
