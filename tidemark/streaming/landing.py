"""Landing by Spark's own writer: a batch overwrites its own partition, so a replay changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Refused
from tidemark.workspace import Files

LINEAGE, BATCH = "landed_by", "landed_batch"


class PartitionLanding:
    """A `foreachBatch` function over a Parquet table partitioned by (query id, batch id).

    Dynamic partition overwrite replaces the partitions a batch writes and no others: the
    batch that comes back after a kill, before or after its write, replaces itself. A fresh
    checkpoint is another query id and lands beside. What a killed write leaves is hidden
    from readers. `writers` sets the tasks that write a batch; `bytes_per_file` asks for
    files of about that many bytes instead. `fault` is called with ('staged', batch) before
    the write and ('committed', batch) after it.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, writers: int | None = None,
        bytes_per_file: int | None = None, fault: Callable[[str, int], None] | None = None,
    ):
        if writers is not None and bytes_per_file is not None:
            raise Refused("either writers or bytes a file, not both")
        taken = {f.name.lower() for f in schema} & {LINEAGE, BATCH}
        if taken:
            raise Refused(f"columns {sorted(taken)} are the landing's own")
        self.spark, self.path, self.schema = spark, path, schema
        self.writers, self.bytes_per_file, self.fault = writers, bytes_per_file, fault
        self.attempts: list[tuple[str, int]] = []
        self.fs = Files(spark)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        self.attempts.append((query, batch_id))
        self._at("staged", batch_id)
        if self.bytes_per_file is None:
            self._write(batch if self.writers is None else batch.repartition(self.writers), query, batch_id)
        else:
            self._write_by_size(batch, query, batch_id)
        self._at("committed", batch_id)

    def _write(self, rows: DataFrame, query: str, batch_id: int) -> None:
        rows.withColumns({LINEAGE: F.lit(query), BATCH: F.lit(batch_id).cast("long")}).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(LINEAGE, BATCH).parquet(self.path)

    def _write_by_size(self, batch: DataFrame, query: str, batch_id: int) -> None:
        """Even files of about `bytes_per_file` (S12): rows of the batch times the bytes a row had so far.

        The first batch has nothing to go by; it is written as it comes, measured, and written
        again over itself. A batch of less than a file is one file.
        """
        measured = self.bytes_per_row()
        if measured is None:
            self._write(batch, query, batch_id)
            measured = self.bytes_per_row()
            if measured is None:
                return
        files = max(1, round(batch.count() * measured / self.bytes_per_file))
        self._write(batch.repartition(files), query, batch_id)

    def _at(self, point: str, batch_id: int) -> None:
        if self.fault is not None:
            self.fault(point, batch_id)

    def bytes_per_row(self) -> float | None:
        """Measured on what has landed so far; None before the first batch."""
        if not self.fs.exists(self.path):
            return None
        files = self.files().agg(F.sum("file_size"), F.sum("rows")).first()
        return files[0] / files[1] if files[1] else None

    def rows(self) -> DataFrame:
        """All landed rows with the partition they lie in; none where nothing has landed."""
        kept = T.StructType([*self.schema.fields, T.StructField(LINEAGE, T.StringType()), T.StructField(BATCH, T.LongType())])
        if not self.fs.exists(self.path):
            return self.spark.createDataFrame([], kept)
        return self.spark.read.schema(kept).parquet(self.path)

    def read(self) -> DataFrame:
        return self.rows().select(*self.schema.names)

    def files(self) -> DataFrame:
        """One row per landed file: its batch, bytes and rows."""
        place = self.rows().select(LINEAGE, BATCH, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))
        return place.groupBy(LINEAGE, BATCH, "file_path", "file_size").agg(F.count(F.lit(1)).alias("rows"))

    def counts_by_batch(self) -> DataFrame:
        return self.rows().groupBy(LINEAGE, BATCH).agg(F.count(F.lit(1)).alias("rows"))

