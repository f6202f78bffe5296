"""The given tables in the shapes the operators take, and the same as SQL.

`events` is the change feed: event_id its sequence number, user_id its key.
Commits, files and samples are derived from it by the hour, so their number
follows the time covered and their content the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
WRITERS = 4
# The last hour of a day at or below the watermark of that day's samples.
FROZEN_UNTIL = 11


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("key"),
        F.col("event_type").alias("source"), "value", "props", "ts",
    )


def highest(rows: DataFrame, column: str) -> int:
    """Greatest value of a column: one number, answered from Parquet statistics."""
    return rows.agg(F.max(column)).first()[0]


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def hour(column: str = "ts"):
    return F.call_function("div", micros(column), F.lit(HOUR_US))


def hour_end(column: str):
    """End of an hour number, as a time stamp without zone."""
    return F.timestamp_seconds((F.col(column) + 1) * 3600).cast("timestamp_ntz")


def files_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per hour, writer and event type that has records."""
    events = read(spark, sf_dir, "events").select(
        hour().alias("h"), (F.col("user_id") % WRITERS).alias("writer"), "event_type",
        F.length("props").alias("bytes"), "ts",
    )
    name = F.concat_ws("-", F.col("h"), F.col("writer"), F.col("event_type"))
    return events.groupBy("h", "writer", "event_type").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum("bytes").cast("long").alias("file_size_in_bytes"),
        F.max("ts").alias("modified_at"),
    ).select(
        F.concat(F.lit("lake/events/data/"), name, F.lit(".parquet")).alias("file_path"),
        "file_size_in_bytes", "record_count",
        F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 1)
        .otherwise(0).alias("content"),
        "event_type", "modified_at", "h",
    )


FILES_SQL = """files AS (
  SELECT 'lake/events/data/' || h || '-' || writer || '-' || event_type || '.parquet' AS file_path,
         bytes AS file_size_in_bytes, n AS record_count,
         CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS content,
         event_type, newest AS modified_at, h
  FROM (SELECT epoch_us(ts) // 3600000000 AS h, user_id % 4 AS writer, event_type,
               CAST(sum(length(props)) AS BIGINT) AS bytes, count(*) AS n, max(ts) AS newest
        FROM events GROUP BY ALL))"""


def commits_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per hour with records, in the shape of a snapshot history.

    As in a real history some summaries lack an entry: the watermark is stamped
    in hours with a signup only, the file count in hours with a purchase.
    """
    events = read(spark, sf_dir, "events").select(
        hour().alias("h"), (F.col("user_id") % WRITERS).alias("writer"), "event_type", "ts"
    )
    per_writer = events.groupBy("h", "writer").agg(
        F.count(F.lit(1)).alias("rows"), F.max("ts").alias("newest"),
        F.count_if(F.col("event_type") == "signup").alias("signups"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    hours = per_writer.groupBy("h").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"),
        F.max("newest").alias("newest_record_at"), F.sum("signups").alias("signups"),
        F.sum("purchases").alias("purchases"), F.sum("errors").alias("errors"),
    )
    entries = F.create_map(
        F.lit("max-committed-batch-id"),
        F.when(F.col("signups") > 0, (F.col("h") % 24).cast("string")),
        F.lit("added-data-files"),
        F.when(F.col("purchases") > 0, F.col("files").cast("string")),
    )
    return hours.select(
        F.col("h").alias("commit_id"), hour_end("h").alias("committed_at"),
        F.call_function("div", F.col("h"), F.lit(24)).alias("run"),
        F.when(F.col("errors") > F.col("purchases"), "overwrite").otherwise("append").alias("operation"),
        F.map_filter(entries, lambda k, v: v.isNotNull()).alias("summary"),
        "rows", "files", "errors", "newest_record_at",
    )


HOURS_SQL = """hours AS (
  SELECT epoch_us(ts) // 3600000000 AS h, count(*) AS rows, count(DISTINCT user_id % 4) AS files,
         max(ts) AS newest, count(*) FILTER (event_type = 'signup') AS signups,
         count(*) FILTER (event_type = 'purchase') AS purchases,
         count(*) FILTER (event_type = 'error') AS errors
  FROM events GROUP BY 1)"""

COMMITS_SQL = HOURS_SQL + """, commits AS (
  SELECT h AS commit_id, make_timestamp((h + 1) * 3600000000) AS committed_at, h // 24 AS run,
         CASE WHEN errors > purchases THEN 'overwrite' ELSE 'append' END AS operation,
         CASE WHEN signups > 0 THEN h % 24 END AS watermark,
         CASE WHEN purchases > 0 THEN files END AS added,
         rows, files, errors, newest AS newest_record_at
  FROM hours)"""


def samples_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly samples, one run per day, frozen until noon.

    The table shows what it held at midnight until the watermark is cleared,
    then everything so far. The lag is read in every frozen hour, and not
    always later.
    """
    hours = commits_by_hour(spark, sf_dir).select(
        "run", (F.col("commit_id") % 24).alias("checkpoint_id"), "commit_id", "rows", "errors",
        "newest_record_at",
    )
    # one row per hour of the covered time
    so_far = Window.orderBy("commit_id").rowsBetween(Window.unboundedPreceding, 0)
    today = Window.partitionBy("run").orderBy("commit_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = hours.withColumn("total", F.sum("rows").over(so_far)).withColumn(
        "of_today", F.sum("rows").over(today)
    )
    frozen = F.col("checkpoint_id") <= FROZEN_UNTIL
    return counted.select(
        "run", "checkpoint_id",
        F.round((micros("newest_record_at") - F.col("run") * (24 * HOUR_US)) / F.lit(1_000_000), 1).alias("seconds"),
        F.lit(FROZEN_UNTIL).cast("long").alias("watermark"),
        F.when(frozen, F.col("total") - F.col("of_today")).otherwise(F.col("total")).alias("rows_visible"),
        F.when(F.col("errors") > 5, "RESTARTING").otherwise("RUNNING").alias("job_state"),
        F.col("errors").alias("checkpoints_failed"),
        F.when(frozen | (F.col("errors") > 0), F.col("errors")).alias("consumer_lag"),
    )


SAMPLES_SQL = HOURS_SQL + """, counted AS (
  SELECT *, h // 24 AS run, h % 24 AS checkpoint_id,
         CAST(sum(rows) OVER (ORDER BY h) AS BIGINT) AS total,
         CAST(sum(rows) OVER (PARTITION BY h // 24 ORDER BY h) AS BIGINT) AS of_today
  FROM hours), samples AS (
  SELECT run, checkpoint_id, round((epoch_us(newest) - run * 86400000000) / 1000000.0, 1) AS seconds,
         11 AS watermark,
         CASE WHEN checkpoint_id <= 11 THEN total - of_today ELSE total END AS rows_visible,
         CASE WHEN errors > 5 THEN 'RESTARTING' ELSE 'RUNNING' END AS job_state,
         errors AS checkpoints_failed,
         CASE WHEN checkpoint_id <= 11 OR errors > 0 THEN errors END AS consumer_lag
  FROM counted)"""


def log_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a log of four partitions with an offset in each."""
    from tidemark.sources.log import with_offsets

    events = read(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", (F.col("user_id") % WRITERS).cast("int").alias("partition")
    )
    return with_offsets(events, "partition", "event_id")


LOG_SQL = """log AS (
  SELECT event_id, ts, event_type, CAST(user_id % 4 AS INTEGER) AS "partition",
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS "offset"
  FROM events)"""
