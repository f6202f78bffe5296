"""What a streaming query says of itself: one row per batch that had rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = (
    "run string, batch_id long, input_rows long, started_at timestamp, committed_at timestamp, trigger_ms long,"
    " watermark timestamp, dropped_rows long")


class BatchProgress:
    """Collects the progress of a run's batches; call `note` while it runs, more often than 100 batches."""

    def __init__(self, run: str):
        self.run = run
        self.seen: dict[int, dict] = {}

    def note(self, query: StreamingQuery) -> None:
        for progress in query.recentProgress:
            found = json.loads(progress.json if hasattr(progress, "json") else json.dumps(progress))
            if "triggerExecution" in found["durationMs"] and "addBatch" in found["durationMs"]:
                self.seen[found["batchId"]] = found

    @property
    def rows(self) -> int:
        return sum(p["numInputRows"] for p in self.seen.values())

    @property
    def batches_with_rows(self) -> int:
        return sum(p["numInputRows"] > 0 for p in self.seen.values())


def progress_rows(spark: SparkSession, runs: list[BatchProgress]) -> DataFrame:
    """The batches of some runs. A commit is seen when its trigger ends: begin of the trigger and its whole duration."""
    found = [
        (r.run, p["batchId"], p["numInputRows"], p["timestamp"], int(p["durationMs"]["triggerExecution"]),
         p.get("eventTime", {}).get("watermark"), sum(s.get("numRowsDroppedByWatermark", 0) for s in p["stateOperators"]))
        for r in runs for p in r.seen.values()]
    raw = spark.createDataFrame(
        found, "run string, batch_id long, input_rows long, began string, trigger_ms long, mark string, dropped_rows long")
    began = F.col("began").cast("timestamp")
    return raw.select(
        "run", "batch_id", "input_rows", began.alias("started_at"),
        F.timestamp_millis(F.unix_millis(began) + F.col("trigger_ms")).alias("committed_at"), "trigger_ms",
        F.col("mark").cast("timestamp").alias("watermark"), "dropped_rows")


def freshness(progress: DataFrame, landed: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Seconds from a chunk's arrival to the end of the commit that shows it, one row per (run, batch, chunk).

    `landed` holds (run, batch_id, chunk) of every landed row; it is reduced before it meets anything.
    """
    shown = landed.groupBy("run", "batch_id", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    wait = (F.unix_micros("committed_at") - F.unix_micros("arrived_at")) / 1e6
    return shown.join(progress.select("run", "batch_id", "committed_at"), ["run", "batch_id"]).join(
        arrivals, "chunk").select("run", "batch_id", "chunk", "rows", wait.alias("waited_seconds"))


def run_metrics(progress: DataFrame) -> DataFrame:
    """How long a run's feed took and how fast it went, over the batches with rows."""
    micros = F.max(F.unix_micros("committed_at")) - F.min(F.unix_micros("started_at"))
    whole = progress.where("input_rows > 0").groupBy("run").agg(
        F.count(F.lit(1)).alias("commits"), F.sum("input_rows").alias("events"), (micros / 1e6).alias("feed_seconds"),
        (F.sum("trigger_ms") / 1e3).alias("busy_seconds"))
    return whole.withColumn("events_per_second", F.col("events") / F.col("feed_seconds"))
