"""A Parquet table whose content is what its commit ledger says it is.

    <root>/data/<lineage>/<batch>-<attempt>/part-*.parquet   written by Spark
    <root>/ledger/<commit id>.json                           one commit each
    <root>/ledger/base-<commit id>-<n>/                      folded older commits
    <root>/held/<lineage>/<batch>.json                       batches not committed yet

A data file nobody's commit names is not part of the table. A commit is one
small file that appears whole or not at all, so a batch is visible entirely or
not. The ledger grows with the number of commits, never with rows; `fold`
turns its older part into one base, written by Spark.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Refused
from tidemark.workspace import Files

LEDGER_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),  # commit | batch | add | remove
    T.StructField("commit_id", T.LongType()),
    T.StructField("committed_at", T.TimestampType()),
    T.StructField("operation", T.StringType()),
    T.StructField("lineage", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("min_seq", T.LongType()),
    T.StructField("max_seq", T.LongType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("summary", T.MapType(T.StringType(), T.StringType())),
])

DATA, POSITION_DELETES, EQUALITY_DELETES = 0, 1, 2


@dataclass
class StagedBatch:
    """One batch on storage: written, described, not yet part of the table."""

    lineage: str
    batch_id: int
    path: str
    rows: int
    min_seq: int | None
    max_seq: int | None
    fingerprint: str
    files: int = 0
    bytes: int = 0


def _number(name: str) -> int:
    """The commit id in the name of a commit file or of a base."""
    return int(name.split("-")[1] if name.startswith("base-") else name.split(".")[0])


@dataclass
class LedgerTable:
    spark: SparkSession
    root: str
    schema: T.StructType

    def __post_init__(self):
        self.root = self.root.rstrip("/")
        self.fs = Files(self.spark)

    # -- reading -----------------------------------------------------------

    def _ledger_paths(self) -> list[str]:
        names = self.fs.names(f"{self.root}/ledger")
        bases = sorted(n for n in names if n.startswith("base-"))
        floor = _number(bases[-1]) if bases else -1
        commits = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
        live = [n for n in commits if _number(n) > floor]
        return [f"{self.root}/ledger/{n}" for n in bases[-1:] + live]

    def exists(self) -> bool:
        return bool(self._ledger_paths())

    def entries(self) -> DataFrame:
        """Every ledger row in force."""
        paths = self._ledger_paths()
        if not paths:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).json(paths)

    def snapshots(self) -> DataFrame:
        """Snapshot history, oldest first."""
        return (
            self.entries().where(F.col("kind") == "commit")
            .select("commit_id", "committed_at", "operation", "lineage", "batch_id", "summary")
            .orderBy("committed_at", "commit_id")
        )

    def live_paths(self) -> DataFrame:
        """The batch directories the newest snapshot consists of."""
        moved = self.entries().where(F.col("kind").isin("add", "remove"))
        return moved.groupBy("path").agg(
            F.count_if(F.col("kind") == "remove").alias("removed"),
            F.max("rows").alias("rows"),
            F.min("min_seq").alias("min_seq"),
            F.max("max_seq").alias("max_seq"),
            F.max("commit_id").alias("commit_id"),
        ).where(F.col("removed") == 0).drop("removed")

    def read(self, min_seq: int | None = None, max_seq: int | None = None) -> DataFrame:
        """The table, through the ledger only. Directories whose sequence range
        lies outside the bounds are not even listed."""
        live = self.live_paths()
        if min_seq is not None:
            live = live.where(F.col("max_seq").isNull() | (F.col("max_seq") >= min_seq))
        if max_seq is not None:
            live = live.where(F.col("min_seq").isNull() | (F.col("min_seq") <= max_seq))
        return self._rows_in(self._folders(live))

    def _folders(self, live: DataFrame) -> list[str]:
        return sorted(f"{self.root}/{r['path']}" for r in live.select("path").collect())

    def _rows_in(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def state(self) -> dict:
        """Rows visible, snapshots, newest lineage and watermark, from the ledger
        alone and in one pass over it."""
        if not self.exists():
            return {"rows_visible": 0, "snapshots": 0, "lineage": None, "watermark": None}
        is_commit = F.col("kind") == "commit"
        per_path = self.entries().where(F.col("kind") != "batch").groupBy(
            F.coalesce("path", F.format_string("commit %d", F.col("commit_id"))).alias("p")
        ).agg(
            F.max(F.when(F.col("kind") == "add", F.col("rows"))).alias("rows"),
            F.count_if(F.col("kind") == "remove").alias("removed"),
            F.max(F.when(is_commit, F.struct("committed_at", "commit_id", "lineage"))).alias("newest"),
            F.max_by("summary", F.when(is_commit, F.col("commit_id"))).alias("summary"),
        )
        row = per_path.agg(
            F.coalesce(F.sum(F.when(F.col("removed") == 0, F.col("rows"))), F.lit(0)).alias("rows_visible"),
            F.count("newest").alias("snapshots"),
            F.max("newest")["lineage"].alias("lineage"),
            F.max_by("summary", "newest")["max-committed-batch-id"].alias("watermark"),
        ).first().asDict()
        row["watermark"] = int(row["watermark"]) if row["watermark"] is not None else None
        return row

    def rows_visible(self) -> int:
        return self.state()["rows_visible"]

    def files(self) -> DataFrame:
        """File manifest of the newest snapshot (S18); Parquet answers from footers.

        A batch whose first task had no rows holds a file without any. No row names
        that file, so the listing of the live folders does, which reads no content.
        """
        folders = self._folders(self.live_paths())
        if not folders:
            return self.spark.createDataFrame(
                [], "file_path string, file_size_in_bytes long, record_count long, content int"
            )
        place = [
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_size").alias("file_size_in_bytes"),
        ]
        listed = self.spark.read.format("binaryFile").load(folders)
        known = self._rows_in(folders).select(*place, F.lit(1).alias("__row")).unionByName(
            listed.select(*place, F.lit(None).cast("int").alias("__row"))
        )
        return known.groupBy("file_path", "file_size_in_bytes").agg(
            F.count("__row").alias("record_count")
        ).withColumn("content", F.lit(DATA))

    def watermark(self, lineage: str | None = None) -> int | None:
        """Greatest committed batch id of a lineage, or of the newest snapshot.

        With no lineage named this is the newest snapshot's value, NULL when
        that snapshot carries none, not the last one that did (W2).
        """
        if lineage is None or not self.exists():
            return self.state()["watermark"]
        batches = self.entries().where((F.col("kind") == "batch") & (F.col("lineage") == lineage))
        return batches.agg(F.max("batch_id")).first()[0]

    def watermark_before(self, lineage: str, commit_id: int, known: tuple[int, int | None]) -> int | None:
        """Watermark of a lineage over all commits below `commit_id`, from one over
        the commits below `known[0]`: only the files in between are read, however
        long the ledger is. Files a fold has taken meanwhile are asked of the base."""
        first, watermark = known
        for number in range(first, commit_id):
            path = f"{self.root}/ledger/{number:020d}.json"
            if not self.fs.exists(path):
                return self.watermark(lineage)
            for line in self.fs.read_text(path).splitlines():
                entry = json.loads(line)
                if entry["kind"] == "batch" and entry["lineage"] == lineage:
                    watermark = max(entry["batch_id"], -1 if watermark is None else watermark)
        return watermark

    def fingerprints(self, lineage: str, first: int, last: int) -> set[tuple[int, str]]:
        """(batch id, fingerprint) of the committed batches first..last of a lineage."""
        known = self.entries().where(
            (F.col("kind") == "batch") & (F.col("lineage") == lineage)
            & F.col("batch_id").between(first, last)
        )
        return {(r["batch_id"], r["fingerprint"]) for r in
                known.select("batch_id", "fingerprint").collect()}

    # -- writing -----------------------------------------------------------

    def next_id(self) -> int:
        names = self.fs.names(f"{self.root}/ledger")
        return max((_number(n) for n in names if not n.startswith(".")), default=-1) + 1

    def commit(
        self,
        batches: list[StagedBatch],
        operation: str = "append",
        removed: list[str] = (),
        recheck=None,
        extra: dict[str, str] | None = None,
    ) -> int:
        """Publish one snapshot.

        The number is taken first and the check reads the ledger after that, so
        whatever is committed between the check and the rename has taken the
        number: the rename fails, and number and check are made again.
        """
        newest = max(batches, key=lambda b: b.batch_id)
        summary = {
            "added-data-files": str(sum(b.files for b in batches)),
            "added-files-size": str(sum(b.bytes for b in batches)),
            "added-records": str(sum(b.rows for b in batches)),
            "max-committed-batch-id": str(newest.batch_id),
            "lineage": newest.lineage,
            **(extra or {}),
        }
        while True:
            commit_id = self.next_id()
            if recheck is not None:
                recheck(commit_id)
            stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
            head = {"commit_id": commit_id, "committed_at": stamp, "operation": operation}
            lines = [{**head, "kind": "commit", "lineage": newest.lineage,
                      "batch_id": newest.batch_id, "summary": summary}]
            for b in batches:
                span = {"rows": b.rows, "min_seq": b.min_seq, "max_seq": b.max_seq}
                if operation != "replace":
                    lines.append({**head, **span, "kind": "batch", "lineage": b.lineage,
                                  "batch_id": b.batch_id, "fingerprint": b.fingerprint})
                if b.rows:
                    lines.append({**head, **span, "kind": "add", "path": b.path})
            lines += [{**head, "kind": "remove", "path": p} for p in removed]
            text = "\n".join(json.dumps(line) for line in lines) + "\n"
            if self.fs.publish_text(f"{self.root}/ledger/{commit_id:020d}.json", text):
                return commit_id

    def new_path(self, lineage: str, batch_id: int) -> str:
        return f"data/{lineage}/{batch_id:012d}-{uuid.uuid4().hex[:12]}"

    # -- held batches ------------------------------------------------------

    def hold(self, batch: StagedBatch) -> None:
        """Remember a batch that may not be committed yet.

        Anything held at this id or above stems from an abandoned run of the
        same lineage; this run reads those records again, so it is replaced.
        """
        folder = f"{self.root}/held/{batch.lineage}"
        for name in self.fs.names(folder):
            if int(name.split(".")[0]) >= batch.batch_id:
                self.fs.delete(f"{folder}/{name}")
        self.fs.mkdirs(folder)
        self.fs.write_text(f"{folder}/{batch.batch_id:012d}.json", json.dumps(asdict(batch)))

    def held(self, lineage: str) -> list[StagedBatch]:
        folder = f"{self.root}/held/{lineage}"
        return [
            StagedBatch(**json.loads(self.fs.read_text(f"{folder}/{name}")))
            for name in sorted(self.fs.names(folder)) if name.endswith(".json")
        ]

    def release(self, lineage: str) -> None:
        self.fs.delete(f"{self.root}/held/{lineage}")

    # -- folding -----------------------------------------------------------

    def fold(self, expire_before: datetime | None = None) -> int:
        """Fold the ledger into one base; with a cutoff, expire older snapshots.

        The newest snapshot always stays, and with it the watermark; so do all
        batch fingerprints and the paths in use. Returns the snapshots expired.
        Files replaced by an earlier base are removed, those replaced by this
        one stay until the next fold, so a reader under way still finds them.
        """
        names = self.fs.names(f"{self.root}/ledger")
        paths = self._ledger_paths()
        if not paths:
            raise Refused("the table has no snapshot to fold")
        top = max(_number(p.rsplit("/", 1)[1]) for p in paths)
        entries = self.spark.read.schema(LEDGER_SCHEMA).json(paths)
        commits = entries.where(F.col("kind") == "commit")
        kept, expired = commits, 0
        if expire_before is not None:
            cutoff = F.lit(expire_before.astimezone(timezone.utc).isoformat()).cast("timestamp")
            newest = commits.agg(F.max(F.struct("committed_at", "commit_id"))["commit_id"]).first()[0]
            old = (F.col("committed_at") < cutoff) & (F.col("commit_id") != newest)
            kept, expired = commits.where(~old), commits.where(old).count()
        gone = Window.partitionBy("path")
        live = (
            entries.where(F.col("kind").isin("add", "remove"))
            .withColumn("__gone", F.count_if(F.col("kind") == "remove").over(gone))
            .where(F.col("__gone") == 0).drop("__gone")
        )
        base = kept.unionByName(entries.where(F.col("kind") == "batch")).unionByName(live)
        staged = f"{self.root}/ledger/.base-{uuid.uuid4().hex}"
        base.coalesce(8).write.json(staged)
        bases = sorted(n for n in names if n.startswith("base-"))
        again = sum(1 for n in bases if _number(n) == top)
        if not self.fs.rename_new(staged, f"{self.root}/ledger/base-{top:020d}-{again:06d}"):
            raise Refused("the ledger was folded by somebody else meanwhile")
        for name in names:
            if bases and not name.startswith(".") and name != bases[-1]:
                if _number(name) <= _number(bases[-1]):
                    self.fs.delete(f"{self.root}/ledger/{name}")
        return expired


def wait_until(check, timeout: float, what: str, poll: float = 0.2):
    """Poll until `check()` returns something other than None; refuse on timeout."""
    deadline = time.monotonic() + timeout
    while True:
        value = check()
        if value is not None:
            return value
        if time.monotonic() >= deadline:
            raise Refused(f"{what} within {timeout:g}s")
        time.sleep(poll)
