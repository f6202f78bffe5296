"""Waiting for a running job, always with an end: a timeout refuses."""

from __future__ import annotations

import time

from pyspark.sql.streaming import StreamingQuery

from tidemark.errors import Refused
from tidemark.streaming.ledger import LedgerTable, wait_until


def wait_for_rows(table: LedgerTable, expected: int, timeout: float, poll: float = 0.5) -> float:
    """Seconds until a reader of the table sees `expected` rows."""
    started = time.monotonic()

    def seen():
        return True if table.exists() and table.rows_visible() >= expected else None

    wait_until(seen, timeout, f"{table.root} did not reach {expected} rows", poll)
    return round(time.monotonic() - started, 1)


def wait_for_watermark(table: LedgerTable, target: int, timeout: float, poll: float = 0.5) -> int:
    """The table's watermark once it reaches `target`. Only commits move it: on an
    idle feed a job's own batch counter says nothing about the table."""

    def reached():
        now = table.watermark() if table.exists() else None
        return now if now is not None and now >= target else None

    return wait_until(reached, timeout, f"the watermark of {table.root} did not reach {target}", poll)


def wait_for_batches(query: StreamingQuery, count: int, timeout: float, poll: float = 0.2) -> int:
    """The newest batch id once `count` batches of this run are complete. A query
    that has ended completes no more and is refused at once."""
    first = []

    def done():
        progress = query.lastProgress
        if progress is not None:
            first.append(progress["batchId"])
            if progress["batchId"] - first[0] + 1 >= count:
                return progress["batchId"]
        if not query.isActive:
            raise Refused(f"{query.name} ended while waiting for {count} batches")
        return None

    return wait_until(done, timeout, f"{query.name} did not complete {count} batches", poll)


def wait_until_stable(
    table: LedgerTable, quiet_polls: int, poll: float, timeout: float, commit_interval: float
) -> tuple[int, float]:
    """Rows and seconds once the same count came back `quiet_polls` more times.

    The quiet window has to outlast the commit interval: between commits a
    table does not move, settled or not. A table that does not exist has no
    count to settle.
    """
    if quiet_polls * poll <= commit_interval:
        raise Refused(
            f"{quiet_polls} polls span {quiet_polls * poll:g}s, not more than the interval of a table that "
            f"commits every {commit_interval:g}s"
        )
    started, seen = time.monotonic(), []

    def settled():
        seen.append(table.rows_visible() if table.exists() else None)
        recent = seen[-(quiet_polls + 1):]
        quiet = len(recent) == quiet_polls + 1 and len(set(recent)) == 1
        return recent[-1] if quiet and recent[-1] is not None else None

    rows = wait_until(settled, timeout, f"{table.root} did not settle", poll)
    return rows, round(time.monotonic() - started, 1)
