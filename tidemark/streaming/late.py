"""Late rows: what a watermark drops, and what keys and sequence numbers keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_within(stream: DataFrame, at: str, delay: str, keys: list[str]) -> DataFrame:
    """Each key's first row, as long as it is not older than the watermark; state is forgotten `delay` after a row's time."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def lateness(rows: DataFrame, batch: str, at: str, delay_ms: int) -> DataFrame:
    """Rows with `late`: whether a watermark of `delay_ms` drops them, given the batch each came in.

    A batch is judged by the watermark the batch before it began with: the greatest time of
    the batches up to the last but one, less the delay, in whole milliseconds. A time equal
    to it is late, so the first two batches lose nothing.
    """
    newest = rows.groupBy(batch).agg(F.max(F.unix_millis(F.col(at).cast("timestamp"))).alias("__newest"))
    # one row per batch
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -2)
    marks = newest.select(batch, (F.max("__newest").over(before) - delay_ms).alias("__mark"))
    late = F.unix_micros(F.col(at).cast("timestamp")) <= F.col("__mark") * 1000
    return rows.join(marks, batch).withColumn("late", F.coalesce(late, F.lit(False))).drop("__mark")
