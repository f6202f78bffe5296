"""A feed that keeps arriving: chunks are staged by one Spark job and appear in a watched folder one at a time."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Refused
from tidemark.session import SHUFFLE_BYTES
from tidemark.workspace import Files

# What a value of fixed width or the frame of a longer one counts in memory.
VALUE_BYTES = 16


def row_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row in memory: a word or two a column, and what strings, binaries and nested values hold."""
    total = F.lit(VALUE_BYTES * len(schema.fields)).cast("long")
    for field in schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        total += F.coalesce(F.octet_length(value), F.lit(0))
    return total


class Arrivals:
    """Chunks of a feed, each a folder of files that appears whole by one rename.

    `chunk` numbers the rows from 0; a chunk of no rows has no folder and arrives as nothing.
    A chunk is spread over `files` writers, or over more where one of them would get more
    than `task_bytes`: what a task sorts to write does not grow with the feed.
    """

    def __init__(self, records: DataFrame, root: str, chunk: Column, files: int = 1, task_bytes: int = SHUFFLE_BYTES):
        self.spark, self.root = records.sparkSession, root
        self.fs = Files(self.spark)
        self.schema = T.StructType([*records.schema.fields, T.StructField("chunk", T.IntegerType())])
        numbered = records.withColumn("chunk", chunk.cast("int"))
        sizes = numbered.groupBy("chunk").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(numbered.schema)).alias("bytes")).collect()  # one row per chunk
        self.counts = {r["chunk"]: r["rows"] for r in sizes}
        # every writer of a chunk is a task of its own: `first` and the following ones
        dealt, writers = [], 0
        for r in sizes:
            if r["chunk"] is not None:
                share = max(files, -(-r["bytes"] // task_bytes))
                dealt.append((r["chunk"], writers, share))
                writers += share
        task = F.lit(0)
        for number, first, share in dealt:
            task = F.when(F.col("chunk") == number, first + F.pmod(F.monotonically_increasing_id(), F.lit(share))).otherwise(task)
        staged = numbered.withColumn("__folder", F.col("chunk")).repartitionById(max(1, writers), task.cast("int"))
        staged.write.partitionBy("__folder").parquet(f"{root}/staged")
        self.fs.mkdirs(self.watched)
        self.at: dict[int, float] = {}

    @property
    def watched(self) -> str:
        return f"{self.root}/watched"

    def arrive(self, chunk: int) -> None:
        """One chunk becomes visible; when it did is kept, for freshness."""
        if chunk in self.at:
            raise Refused(f"chunk {chunk} has arrived before")
        folder = f"{self.root}/staged/__folder={chunk}"
        if self.fs.exists(folder) and not self.fs.rename_new(folder, f"{self.watched}/chunk-{chunk:06d}"):
            raise Refused(f"chunk {chunk} is already there")
        self.at[chunk] = time.time()

    @property
    def rows_arrived(self) -> int:
        return sum(self.counts.get(c, 0) for c in self.at)

    def stream(self) -> DataFrame:
        """All that arrives, each row with its `chunk`."""
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.watched)

    def times(self) -> DataFrame:
        """(chunk, arrived_at): one row per chunk, when the driver made it visible."""
        return self.spark.createDataFrame(sorted(self.at.items()), "chunk int, seconds double").select(
            "chunk", F.timestamp_seconds("seconds").alias("arrived_at"))
