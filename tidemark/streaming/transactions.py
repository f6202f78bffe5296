"""A transactional log-to-log copy: staged writes and marker rows.

Spark's own log sink delivers at least once, so a copy is made in two phases.
Every commit interval's records are written under a transaction id, and a
marker row then says what became of the transaction. A reader who takes only
committed transactions sees each record once; one who takes everything also
sees what expired.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.isolation import ABORTED, COMMITTED, ONGOING, latest_states
from tidemark.workspace import Files

MARKER_SCHEMA = T.StructType([
    T.StructField("txn_id", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("timeout_ms", T.IntegerType()),
    T.StructField("version", T.LongType()),
])


@dataclass
class TransactionalLog:
    """A log directory with one folder per transaction and a marker folder.

    The id of a transaction is <prefix>-<batch>, so a batch that comes back
    after a failure writes the same folder again instead of another copy. The
    prefix must name the job and its shape: a reused one would meet the states
    of an older run.
    """

    spark: SparkSession
    root: str
    schema: T.StructType

    def _mark(self, txn_id: str, state: str, timeout_ms: int, version: int) -> None:
        files = Files(self.spark)
        files.mkdirs(f"{self.root}/markers")
        row = {"txn_id": txn_id, "state": state, "timeout_ms": timeout_ms, "version": version}
        files.write_text(f"{self.root}/markers/{txn_id}.{version}.json", json.dumps(row) + "\n")

    def writer(self, prefix: str, interval_ms: int, timeout_ms: int):
        """A foreachBatch function. A transaction stays open for the commit
        interval, or for as long as its batch takes if that is longer; with a
        shorter timeout it is aborted by the time it would commit."""

        def write(batch: DataFrame, batch_id: int) -> None:
            txn_id, opened = f"{prefix}-{batch_id:012d}", time.monotonic()
            self._mark(txn_id, ONGOING, timeout_ms, 0)
            batch.write.mode("overwrite").parquet(f"{self.root}/records/{txn_id}")
            open_ms = max(interval_ms, (time.monotonic() - opened) * 1000)
            outcome = ABORTED if open_ms > timeout_ms else COMMITTED
            self._mark(txn_id, outcome, timeout_ms, 1)

        return write

    def markers(self) -> DataFrame:
        if not Files(self.spark).exists(f"{self.root}/markers"):
            return self.spark.createDataFrame([], MARKER_SCHEMA)
        return self.spark.read.schema(MARKER_SCHEMA).json(f"{self.root}/markers")

    def states(self, prefix: str = "") -> DataFrame:
        return latest_states(self.markers(), prefix)

    def read(self, isolation: str = "read_committed") -> DataFrame:
        """Records of the transactions an isolation level lets a reader see.

        Transactions are folders, so what is invisible is not even opened.
        """
        ids = self.states()
        if isolation == "read_committed":
            ids = ids.where(F.col("state") == COMMITTED)
        paths = [f"{self.root}/records/{r['txn_id']}" for r in ids.select("txn_id").collect()]
        files = Files(self.spark)
        paths = sorted(p for p in paths if files.exists(p))
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)
