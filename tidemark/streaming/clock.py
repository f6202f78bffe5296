"""Several runs over one arriving feed, each committing on a clock of its own."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQuery

from tidemark.errors import Refused
from tidemark.streaming.arrivals import Arrivals
from tidemark.streaming.landing import PartitionLanding
from tidemark.streaming.progress import BatchProgress


@dataclass
class ClockedRun:
    """A run of `interval` seconds; Spark begins a batch at whole multiples of it."""

    name: str
    interval: float
    landing: PartitionLanding
    checkpoint: str
    progress: BatchProgress = field(init=False)
    query: StreamingQuery | None = None

    def __post_init__(self):
        self.progress = BatchProgress(self.name)

    def start(self, arrivals: Arrivals) -> None:
        self.query = (
            arrivals.stream().writeStream.queryName(self.name).option("checkpointLocation", self.checkpoint)
            .trigger(processingTime=f"{round(self.interval * 1000)} milliseconds").foreachBatch(self.landing).start())

    def wait_for(self, rows: int, timeout: float) -> None:
        """Until so many rows are committed; a failed query raises its own error."""
        end = time.time() + timeout
        while True:
            self.progress.note(self.query)
            if self.progress.rows >= rows:
                return
            if self.query.exception() is not None:
                raise self.query.exception()
            if time.time() > end:
                raise Refused(f"{self.name} has committed {self.progress.rows} of {rows} rows after {timeout:g}s")
            time.sleep(0.02)


def feed_on_clock(runs: list[ClockedRun], arrivals: Arrivals, chunks: int, timeout: float = 600) -> None:
    """Let `chunks` chunks arrive, the first before any run starts, then one in the middle of each short interval.

    The shortest run's intervals divide those of all others. A round of chunks fills the
    longest interval, begins with it, and the next begins when all runs have committed.
    """
    short, long = min(r.interval for r in runs), max(r.interval for r in runs)
    if any(abs(r.interval / short - round(r.interval / short)) > 1e-9 for r in runs):
        raise Refused("the shortest interval does not divide the others")
    arrivals.arrive(0)
    try:
        for run in runs:
            run.start(arrivals)
        for run in runs:
            run.wait_for(arrivals.rows_arrived, timeout)
        each, done = round(long / short), 1
        while done < chunks:
            begin = (time.time() // long + 1) * long
            for k in range(min(each, chunks - done)):
                time.sleep(max(0.0, begin + (k + 0.5) * short - time.time()))
                arrivals.arrive(done)
                done += 1
            for run in runs:
                run.wait_for(arrivals.rows_arrived, timeout)
    finally:
        for run in runs:
            if run.query is not None:
                run.query.stop()
