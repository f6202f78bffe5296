"""Committed offsets of consumer groups, kept outside any checkpoint.

Like a consumer group's own topic, the store is append-only and the newest
entry of a partition counts. A checkpoint never reads it; a fresh job may.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Refused
from tidemark.workspace import Files

OFFSET_SCHEMA = T.StructType([
    T.StructField("group", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("version", T.LongType()),
])


def newest_offsets(history: DataFrame) -> DataFrame:
    """The committed offset of each (group, topic, partition)."""
    return history.groupBy("group", "topic", "partition").agg(
        F.max_by("offset", "version").alias("offset")
    )


def rewound(committed: DataFrame, log: DataFrame, to: str = "earliest") -> DataFrame:
    """Committed offsets moved to one end of the log, per partition."""
    if to not in ("earliest", "latest"):
        raise Refused(f"cannot reset offsets to {to!r}")
    target = F.min("offset") if to == "earliest" else F.max("offset") + 1
    ends = log.groupBy("partition").agg(target.alias("offset"))
    return committed.drop("offset").join(ends, "partition")


@dataclass
class OffsetStore:
    spark: SparkSession
    path: str

    def history(self) -> DataFrame:
        if not Files(self.spark).exists(self.path):
            return self.spark.createDataFrame([], OFFSET_SCHEMA)
        return self.spark.read.schema(OFFSET_SCHEMA).parquet(self.path)

    def commit(self, group: str, topic: str, offsets: DataFrame) -> None:
        """Append (partition, offset) rows as the group's position."""
        offsets.select(
            F.lit(group).alias("group"), F.lit(topic).alias("topic"),
            F.col("partition").cast("int").alias("partition"),
            F.col("offset").cast("long").alias("offset"),
            F.lit(time.time_ns()).alias("version"),
        ).coalesce(1).write.mode("append").parquet(self.path)

    def group_offsets(self, group: str) -> DataFrame:
        """(topic, partition, offset) of a group. A group nobody committed for
        is an empty answer; a store that cannot be read raises."""
        return newest_offsets(self.history().where(F.col("group") == group)).drop("group")

    def reset(self, group: str, topic: str, log: DataFrame, to: str = "earliest") -> DataFrame:
        committed = self.group_offsets(group).where(F.col("topic") == topic)
        self.commit(group, topic, rewound(committed, log, to).select("partition", "offset"))
        return self.group_offsets(group)

    def as_map(self, group: str, topic: str) -> dict[int, int]:
        """partition -> offset; one entry per partition of the topic."""
        rows = self.group_offsets(group).where(F.col("topic") == topic).collect()
        return {r["partition"]: r["offset"] for r in rows}


def from_position(offsets: dict[int, int]) -> Column:
    """Keep the records at or after a starting position; unnamed partitions from 0.

    Plain comparisons of `partition` and `offset`, so that the scan skips row
    groups below the position. A position without any offset is refused: a
    group that never committed has none, and reading all is another request.
    """
    if not offsets:
        raise Refused("no committed offsets to start from")
    unnamed = ~F.col("partition").isin(sorted(offsets))
    return reduce(or_, [
        (F.col("partition") == int(p)) & (F.col("offset") >= F.lit(int(o)).cast("long"))
        for p, o in sorted(offsets.items())
    ], unnamed)
