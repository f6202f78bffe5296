"""Sinks for foreachBatch: what happens to a batch that comes back."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.functions import fingerprint_columns, fingerprint_text
from tidemark.operators.audit import latest_per_key
from tidemark.streaming.ledger import LedgerTable, StagedBatch

POLICIES = ("hold", "reject", "dedupe", "skip")
# Batch ids whose fingerprints are looked up together.
LOOK_AHEAD = 63
# The folder under data/ that holds compacted bases.
BASE = "base-compaction"


@dataclass
class LedgerSink:
    """Appends batches through the ledger.

    The lineage is the id of the streaming query, which lives in its
    checkpoint: a restart and a restored copy keep it, a fresh start does not.
    For a batch id above the lineage's watermark the batch is committed, with
    everything held, as one snapshot. At or below the watermark:

    * the content committed under that id comes back unchanged: an ordinary
      restart, and the replay is suppressed;
    * other content: a stale restore. `hold` keeps it until an id clears the
      watermark (nothing lost, re-read records land twice), `dedupe` holds and
      then drops sequence numbers already in the table, `reject` refuses,
      `skip` drops the batch.

    `delivery="at_least_once"` guards nothing: every batch is committed.
    """

    table: LedgerTable
    seq: str = "seq"
    policy: str = "reject"
    delivery: str = "exactly_once"
    writers: int | None = None
    max_records_per_file: int | None = None
    fault: Callable[[str, int], None] | None = None
    after_batch: Callable[[str, int, int], None] | None = None
    outcomes: list[tuple[int, str]] = field(default_factory=list)
    rows_read: int = 0
    _watermarks: dict = field(default_factory=dict, repr=False)
    _known: tuple = field(default=(), repr=False)

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise Refused(f"unknown policy {self.policy!r}, one of {POLICIES}")
        if self.delivery not in ("exactly_once", "at_least_once"):
            raise Refused(f"unknown delivery {self.delivery!r}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        lineage = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if lineage is None:
            raise Refused("the sink runs inside a streaming query only")
        outcome, rows = self._take(batch, batch_id, lineage)
        self.outcomes.append((batch_id, outcome))
        self.rows_read += rows
        if self.after_batch is not None:
            self.after_batch(lineage, batch_id, rows)

    def _take(self, batch: DataFrame, batch_id: int, lineage: str) -> tuple[str, int]:
        if self.delivery == "at_least_once":
            staged = self._stage(batch, batch_id, lineage)
            self._reached("staged", batch_id)
            self._publish([staged], batch_id, lineage, guarded=False)
            return "committed", staged.rows
        watermark = self._watermark(lineage)
        if watermark is None or batch_id > watermark:
            staged = self._stage(batch, batch_id, lineage)
            self._reached("staged", batch_id)
            markers = self.table.held(lineage)
            lump = self._uncommitted(markers, batch_id) + [staged]
            if self.policy == "dedupe":
                lump = self._without_known(lump, batch_id, lineage)
            self._publish(lump, batch_id, lineage, guarded=True)
            if markers:
                self.table.release(lineage)
            return "committed", staged.rows
        return self._take_again(batch, batch_id, lineage, watermark)

    def _take_again(
        self, batch: DataFrame, batch_id: int, lineage: str, watermark: int
    ) -> tuple[str, int]:
        """A batch id the table already has. Where it may have to be held it is
        written at once, so that it is computed only once."""
        keeps = self.policy in ("hold", "dedupe")
        if keeps:
            staged = self._stage(batch, batch_id, lineage)
            seen, rows = staged.fingerprint, staged.rows
        else:
            values = batch.agg(*fingerprint_columns(batch, self.seq)).first().asDict()
            seen, rows = fingerprint_text(values), values["rows"]
        if (batch_id, seen) in self._known_fingerprints(lineage, batch_id, watermark):
            if keeps:
                self.table.fs.delete(f"{self.table.root}/{staged.path}")
            return "suppressed", rows
        if self.policy == "reject":
            raise Refused(
                f"batch {batch_id} of lineage {lineage} was committed with other content: "
                f"the job was restored from a point older than the table (watermark {watermark})"
            )
        if not keeps:
            return "skipped", rows
        self.table.hold(staged)
        return "held", rows

    def _known_fingerprints(self, lineage: str, batch_id: int, watermark: int) -> set[tuple[int, str]]:
        """Looked up for a stretch of committed batch ids at a time; what is above
        the watermark may still be committed and is not remembered."""
        if not self._known or not self._known[0] <= batch_id <= self._known[1]:
            last = min(batch_id + LOOK_AHEAD, watermark)
            self._known = (batch_id, last, self.table.fingerprints(lineage, batch_id, last))
        return self._known[2]

    def _reached(self, point: str, batch_id: int) -> None:
        if self.fault is not None:
            self.fault(point, batch_id)

    def _watermark(self, lineage: str, below: int | None = None) -> int | None:
        """Watermark of a lineage over the commits below a number (the next one
        by default); what an earlier call has read is not read again."""
        below = self.table.next_id() if below is None else below
        if lineage in self._watermarks:
            now = self.table.watermark_before(lineage, below, self._watermarks[lineage])
        else:
            now = self.table.watermark(lineage) if below else None
        self._watermarks[lineage] = (below, now)
        return now

    def _stage(self, batch: DataFrame, batch_id: int, lineage: str) -> StagedBatch:
        return stage(
            self.table, batch, batch_id, lineage, self.seq, self.writers, self.max_records_per_file
        )

    def _publish(self, lump: list[StagedBatch], batch_id: int, lineage: str, guarded: bool) -> None:
        def recheck(commit_id: int) -> None:
            now = self._watermark(lineage, commit_id)
            if now is not None and now >= batch_id:
                raise Refused(f"lineage {lineage} is written by two queries at once")

        if any(b.rows for b in lump):
            self.table.commit(lump, recheck=recheck if guarded else None)
        self._reached("committed", batch_id)

    def _uncommitted(self, held: list[StagedBatch], batch_id: int) -> list[StagedBatch]:
        """Held batches still to be committed: a crash right after the commit
        of a lump leaves their markers behind."""
        held = [b for b in held if b.batch_id < batch_id]
        if not held:
            return []
        done = self.table.fingerprints(held[0].lineage, held[0].batch_id, held[-1].batch_id)
        return [b for b in held if (b.batch_id, b.fingerprint) not in done]

    def _without_known(self, lump, batch_id: int, lineage: str) -> list[StagedBatch]:
        """The held batches and the new one, rewritten without sequence numbers
        the table has, each number once. Only directories overlapping their range
        are read; a batch that overlaps none and repeats none is not rewritten,
        which takes one pass over its numbers."""
        paths = [f"{self.table.root}/{b.path}" for b in lump if b.rows]
        if not paths:
            return lump
        low = min(b.min_seq for b in lump if b.rows)
        high = max(b.max_seq for b in lump if b.rows)
        overlap = (F.col("max_seq") >= low) & (F.col("min_seq") <= high)
        rows = self.table.spark.read.schema(self.table.schema).parquet(*paths)
        if len(lump) == 1 and self.table.live_paths().where(overlap).isEmpty():
            if rows.select(self.seq).distinct().count() == lump[0].rows:
                return lump
        known = self.table.read(low, high).where(F.col(self.seq).between(low, high)).select(self.seq)
        fresh = rows.dropDuplicates([self.seq]).join(known, self.seq, "left_anti")
        merged = self._stage(fresh.select(*self.table.schema.names), batch_id, lineage)
        empty = [
            StagedBatch(b.lineage, b.batch_id, b.path, 0, None, None, b.fingerprint)
            for b in lump if b.batch_id != batch_id
        ]
        merged.fingerprint = lump[-1].fingerprint
        return empty + [merged]


def stage(
    table: LedgerTable,
    batch: DataFrame,
    batch_id: int,
    lineage: str,
    seq: str,
    writers: int | None = None,
    max_records_per_file: int | None = None,
) -> StagedBatch:
    """Write a batch and describe it in the same pass.

    The fingerprint is observed on the rows being written, in the last stage of
    the job, so the batch is computed once; each finished write task counts
    once however often tasks are retried.
    """
    path = table.new_path(lineage, batch_id)
    # a shuffle, so that as many tasks write whatever the number of input files, and the scan stays wide
    out = batch if writers is None else batch.repartition(writers)
    seen = Observation()
    out = out.observe(seen, *fingerprint_columns(batch, seq))
    writer = out.write
    if max_records_per_file is not None:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(f"{table.root}/{path}")
    values = seen.get
    sizes = table.fs.sizes(f"{table.root}/{path}") if values["rows"] else {}
    return StagedBatch(
        lineage, batch_id, path, values["rows"], values["min_seq"], values["max_seq"],
        fingerprint_text(values), len(sizes), sum(sizes.values()),
    )


@dataclass
class UpsertSink(LedgerSink):
    """Keeps one row per key, the last assertion winning by sequence number.

    Each batch is first reduced to its latest record per key, then appended as
    a delta; readers merge by key (`read_upsert`). A replayed or late record
    changes nothing, so any policy gives the same table. Deltas are folded into
    one base once they outweigh `compact_ratio` of it, which keeps the
    total rewriting proportional to what was written.
    """

    key: str | None = None
    compact_ratio: float | None = None

    def __post_init__(self):
        super().__post_init__()
        if not self.key:
            raise Refused("an upsert needs the key it upserts on")

    def _take(self, batch: DataFrame, batch_id: int, lineage: str) -> tuple[str, int]:
        outcome = super()._take(latest_per_key(batch, self.key, self.seq), batch_id, lineage)
        if outcome[0] == "committed" and self.compact_ratio is not None:
            compact_upsert(self.table, self.key, self.seq, self.compact_ratio)
        return outcome


def read_upsert(table: LedgerTable, key: str, seq: str = "seq") -> DataFrame:
    """The keyed table: the latest record of each key.

    A freshly compacted table is one base with one row per key, and is read as
    it is; deltas on top of it are merged by key.
    """
    live = [r["path"] for r in table.live_paths().select("path").collect()]
    rows = table.read()
    if len(live) == 1 and is_base(live[0]):
        return rows
    return latest_per_key(rows, key, seq)


def is_base(path: str) -> bool:
    return path.startswith(f"data/{BASE}/")


def compact_upsert(table: LedgerTable, key: str, seq: str, ratio: float = 0.5) -> bool:
    """Fold deltas into one base when they outweigh it `ratio` times.

    Before there is a base, the largest delta stands in for it.
    """
    live = table.live_paths().collect()  # one row per live directory
    deltas = [r["rows"] for r in live if not is_base(r["path"])]
    base = sum(r["rows"] for r in live) - sum(deltas)
    if not deltas or sum(deltas) <= ratio * max(base, max(deltas)):
        return False
    merged = read_upsert(table, key, seq)
    started = time.time_ns()
    staged = stage(table, merged, started, BASE, seq)
    staged.lineage, newest = _newest(table)
    staged.batch_id = newest
    table.commit([staged], operation="replace", removed=[r["path"] for r in live])
    return True


def _newest(table: LedgerTable) -> tuple[str, int]:
    row = table.entries().where(F.col("kind") == "commit").agg(
        F.max_by(F.struct("lineage", "batch_id"), "commit_id").alias("n")
    ).first()["n"]
    return row["lineage"], row["batch_id"]
