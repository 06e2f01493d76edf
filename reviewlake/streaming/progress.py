"""Progress of streams, as a table that a listener fills from Spark's events."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .store import read_rows

METRICS = "review"
PROGRESS = ("run string, epoch long, rows long, done long, failed long, rows_per_second double, "
            "duration_ms long")


def watched(reviewed: DataFrame) -> DataFrame:
    """`reviewed`, counted while it is written: every epoch's event carries done and failed."""
    return reviewed.observe(METRICS, F.count_if(F.col("error").isNull()).alias("done"),
                            F.count_if(F.col("error").isNotNull()).alias("failed"))


class ProgressListener(StreamingQueryListener):
    """Keeps one row per epoch of every stream of a session; events come in the order of epochs.

    An epoch that is replayed replaces its row. Rows are small, and the last `keep` runs stay.
    """

    def __init__(self, spark: SparkSession, keep: int = 100):
        self.spark, self.keep = spark, keep
        self.rows: dict[str, dict[int, tuple]] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def __enter__(self) -> ProgressListener:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)

    def _end(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.rows[str(event.runId)] = {}
            for run in list(self.rows)[:-self.keep]:
                del self.rows[run]

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = p.observedMetrics.get(METRICS)
        row = (str(p.runId), p.batchId, p.numInputRows,
               counts["done"] if counts else None, counts["failed"] if counts else None,
               p.processedRowsPerSecond, p.durationMs.get("triggerExecution"))
        with self.lock:
            if counts:  # an event without an epoch of its own brings no counts
                self.rows.setdefault(str(p.runId), {})[p.batchId] = row

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Whether the last event of a stream that has ended came within `seconds`."""
        return self._end(str(query.runId)).wait(seconds)

    def table(self) -> DataFrame:
        """PROGRESS: a row per run and epoch."""
        with self.lock:
            rows = [row for run in self.rows.values() for row in run.values()]
        return self.spark.createDataFrame(rows, PROGRESS)


def repo_progress(spark: SparkSession, path: str, progress: DataFrame) -> DataFrame:
    """(repo, epoch, done, failed) of a review store, for the epochs that events have reported."""
    told = progress.select("epoch").distinct()
    return read_rows(spark, path).join(told, "epoch", "left_semi").groupBy("repo", "epoch").agg(
        F.count_if(F.col("error").isNull()).alias("done"),
        F.count_if(F.col("error").isNotNull()).alias("failed"))
