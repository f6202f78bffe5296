"""Sessions as transactions: rows of a key belong together until a pause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.isolation import ABORTED, COMMITTED, ONGOING


def sessions(rows: DataFrame, key: str, at: str, gap: Column, block_seconds: int = 86_400) -> DataFrame:
    """One row per session: key, `opened_at`, `last_at`, `open_until`, `records`.

    A row keeps its session open for `gap`, an interval that may differ from row to row; one
    that comes by the end of it belongs to the session. Sessions are first made inside blocks
    of time, so a key with a large share of all rows is not one task's work, and what the
    blocks give, a row per session, is joined over their borders in a second step.
    """
    timed = rows.select(key, F.col(at).cast("timestamp").alias("__at"), gap.alias("__gap")).where(F.col("__at").isNotNull())
    block = F.floor(F.unix_micros("__at") / (block_seconds * 1_000_000))
    inside = timed.withColumn("__block", block).groupBy(F.session_window("__at", F.col("__gap")).alias("w"), key, "__block").agg(
        F.min("__at").alias("opened_at"), F.max("__at").alias("last_at"), F.count(F.lit(1)).alias("records"))
    pieces = inside.select(key, "opened_at", "last_at", F.col("w.end").alias("open_until"), "records")
    order = Window.partitionBy(key).orderBy("opened_at", "open_until")
    before = F.max("open_until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.col("__until").isNull() | (F.col("opened_at") > F.col("__until"))).cast("int")
    numbered = pieces.withColumn("__until", before).withColumn("__session", F.sum(begins).over(order))
    return numbered.groupBy(key, "__session").agg(
        F.min("opened_at").alias("opened_at"), F.max("last_at").alias("last_at"), F.max("open_until").alias("open_until"),
        F.sum("records").alias("records")).drop("__session")


def as_transactions(found: DataFrame, now: Column, timeout_ms: Column) -> DataFrame:
    """What a timeout makes of sessions: `state` and `lost` records of each.

    A session that may still go on at `now` is ongoing, whatever its length so far; one open
    for longer than the timeout is aborted and its records are lost; the others committed.
    """
    open_ms = (F.unix_micros("last_at") - F.unix_micros("opened_at")) / 1000
    state = F.when(F.col("open_until") >= now, ONGOING).when(open_ms > timeout_ms, ABORTED).otherwise(COMMITTED)
    return found.withColumn("state", state).withColumn("lost", F.when(F.col("state") == ABORTED, F.col("records")).otherwise(0))
