"""Consumer lag: what a group still has to read, or NULL when nobody knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """Per committed partition: offset, end of the log (0 if unknown), lag."""
    return committed.join(ends.select("partition", "end_offset"), "partition", "left").select(
        *committed.columns,
        F.coalesce("end_offset", F.lit(0)).cast("long").alias("end_offset"),
        (F.coalesce("end_offset", F.lit(0)) - F.col("offset")).cast("long").alias("lag"),
    )


def consumer_lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """One row: `consumer_lag`.

    A sum over nothing stays NULL: no committed offset is no reading, and a 0
    here would be the very claim that everything was read.
    """
    return partition_lag(committed, ends).agg(F.sum("lag").alias("consumer_lag"))


def lag_and_staleness(committed: DataFrame, ends: DataFrame, visible: DataFrame) -> DataFrame:
    """Lag beside the rows a reader of the table cannot see yet.

    `visible` is one row with `rows_visible`. A lag of 0 says the records were
    read, not that they can be seen.
    """
    landed = ends.agg(F.sum("end_offset").alias("rows_in_log"))
    parts = [consumer_lag(committed, ends), landed, visible.select("rows_visible")]
    names = [p.columns[0] for p in parts]
    one = None
    for part in parts:
        row = part.select(*[
            F.col(n).cast("long") if n in part.columns else F.lit(None).cast("long").alias(n)
            for n in names
        ])
        one = row if one is None else one.unionByName(row)
    return one.agg(*[F.max(n).alias(n) for n in names]).withColumn(
        "rows_behind", F.col("rows_in_log") - F.col("rows_visible")
    )
