"""Samples of a running job and its table, taken between batches."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.streaming.ledger import LedgerTable
from tidemark.workspace import Files

SAMPLE_SCHEMA = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("checkpoint_id", T.LongType()),
    T.StructField("watermark", T.LongType()),
    T.StructField("rows_visible", T.LongType()),
    T.StructField("snapshots", T.LongType()),
    T.StructField("consumer_lag", T.LongType()),
    T.StructField("job_state", T.StringType()),
    T.StructField("checkpoints_failed", T.LongType()),
    T.StructField("writing_lineage", T.StringType()),
])


class ProgressLog(StreamingQueryListener):
    """Query progress as it is reported: batch, input rows, and how runs ended."""

    def __init__(self):
        self.progress, self.ended, self.started = [], [], {}

    def onQueryStarted(self, event):
        self.started[str(event.id)] = str(event.runId)

    def seen(self, lineage: str | None) -> tuple[str | None, int | None]:
        """State of a query's newest run, and how many of its runs have failed so far."""
        if lineage not in self.started:
            return None, None
        runs = {run: error for query, run, error in self.ended if query == lineage}
        newest = self.started[lineage]
        state = "RUNNING" if newest not in runs else "FAILED" if runs[newest] else "FINISHED"
        return state, sum(1 for error in runs.values() if error)

    def onQueryProgress(self, event):
        p = event.progress
        self.progress.append((str(p.id), str(p.runId), p.batchId, p.timestamp, p.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.append((str(event.id), str(event.runId), event.exception))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.progress,
            "lineage string, run_id string, batch_id long, reported_at string, input_rows long",
        )

    def failures(self, spark: SparkSession) -> DataFrame:
        """Runs that ended with an exception, in the shape `failure_causes` reads."""
        rows = [(i, "", text) for i, (_, _, text) in enumerate(self.ended) if text]
        return spark.createDataFrame(rows, "seen long, exception_name string, stacktrace string")


@dataclass
class Sampler:
    """One row per completed batch, written to storage as it is taken.

    Used as a sink's `after_batch`. `watermark` is the table's watermark when
    sampling began, the one the job has to clear. The lag is the end of the log
    at that moment less what the job has read; with nobody to ask for the end
    of the log there is no lag to read, and it stays NULL. State and failed runs
    are what the listener has seen of the query, NULL without one.
    """

    table: LedgerTable
    path: str
    stage: str = "run"
    log_end: Callable[[], int] | None = None
    rows_read: int = 0
    watermark: int | None = None
    progress: ProgressLog | None = None
    _started: float = field(default_factory=time.monotonic)
    _count: int = 0

    def __post_init__(self):
        if self.watermark is None and self.table.exists():
            self.watermark = self.table.watermark()

    def __call__(self, lineage: str, batch_id: int, rows: int) -> None:
        self.rows_read += rows
        self.observe(batch_id, lineage)

    def observe(self, batch_id: int | None = None, lineage: str | None = None) -> dict:
        held = self.table.state()
        state, failed = (None, None) if self.progress is None else self.progress.seen(lineage)
        row = {
            "stage": self.stage,
            "seconds": round(time.monotonic() - self._started, 1),
            "checkpoint_id": batch_id,
            "watermark": self.watermark,
            "rows_visible": held["rows_visible"],
            "snapshots": held["snapshots"],
            "consumer_lag": self.log_end() - self.rows_read if self.log_end else None,
            "job_state": state,
            "checkpoints_failed": failed,
            "writing_lineage": held["lineage"],
        }
        files = Files(self.table.spark)
        files.mkdirs(self.path)
        files.write_text(f"{self.path}/{self.stage}-{self._count:08d}.json", json.dumps(row) + "\n")
        self._count += 1
        return row


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMA).json(path)
