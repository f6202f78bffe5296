"""Files and commits: how a table is laid out and how fresh it is."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import floor_average

WATERMARK_KEY = "max-committed-batch-id"
ADDED_FILES_KEY = "added-data-files"


def summary_value(key: str, default=None, summary: str = "summary") -> Column:
    """One entry of a snapshot summary, with a default when absent."""
    value = F.try_element_at(F.col(summary), F.lit(key)).cast("long")
    return value if default is None else F.coalesce(value, F.lit(default).cast("long"))


def files_summary(files: DataFrame, by: list[str] = ()) -> DataFrame:
    """Data and delete files, bytes, whole-number average.

    Whatever is not data counts as a delete file, never as data.
    """
    data = F.col("content") == 0
    size = F.col("file_size_in_bytes")
    zero = F.lit(0).cast("long")
    sums = files.groupBy(*by).agg(
        F.count_if(data).alias("data_files"),
        F.count_if(~data).alias("delete_files"),
        F.coalesce(F.sum(F.when(data, size)), zero).alias("data_bytes"),
        F.coalesce(F.sum(F.when(~data, size)), zero).alias("delete_bytes"),
    )
    return sums.withColumn(
        "avg_data_file_bytes", floor_average(F.col("data_bytes"), F.col("data_files"))
    )


def newest_watermark(snapshots: DataFrame, by: list[str] = ()) -> DataFrame:
    """The watermark on the newest snapshot.

    NULL when that snapshot does not carry one: an older snapshot's value is
    not the table's watermark.
    """
    newest = snapshots.groupBy(*by).agg(
        F.max_by("summary", "committed_at").alias("summary"),
        F.max("committed_at").alias("committed_at"),
    )
    return newest.select(*by, "committed_at", summary_value(WATERMARK_KEY).alias("watermark"))


def added_files(snapshots: DataFrame) -> DataFrame:
    """Files each commit added, 0 where the summary does not say."""
    return snapshots.withColumn("added_files", summary_value(ADDED_FILES_KEY, 0))


def commit_layout(snapshots: DataFrame, by: list[str] = ()) -> DataFrame:
    """Commits and files per commit (A16). Snapshots hold data commits only."""
    return added_files(snapshots).groupBy(*by).agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("added_files").alias("data_files"),
        F.round(F.sum("added_files") / F.count(F.lit(1)), 2).alias("files_per_commit"),
        F.max("added_files").alias("max_files_in_one_commit"),
        F.min("added_files").alias("min_files_in_one_commit"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """end - start in seconds, from whole microseconds."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000)


def freshness(commits: DataFrame, by: list[str] = ()) -> DataFrame:
    """Seconds from a commit's newest record to the commit, and of the last one.

    Needs `committed_at` and `newest_record_at` per commit.
    """
    wait = seconds_between(F.col("newest_record_at"), F.col("committed_at"))
    timed = commits.withColumn("__wait", wait)
    return timed.groupBy(*by).agg(
        F.round(F.max("__wait"), 1).alias("worst_seconds_to_visible"),
        F.round(F.max_by("__wait", "committed_at"), 1).alias("last_seconds_to_visible"),
    )


def interval_layout(
    records: DataFrame, at: str, interval_seconds: list[int], writer: Column, size: Column
) -> DataFrame:
    """What each commit interval makes of the same feed.

    Every commit closes one file per writer that got records. Records are summed
    per common step of all intervals and writer first, so the feed is scanned
    once and only those sums are placed into every interval.
    """
    step = math.gcd(*interval_seconds)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    steps = records.select(
        F.call_function("div", micros, F.lit(step * 1_000_000)).alias("__step"),
        micros.alias("__us"), writer.alias("__writer"), size.cast("long").alias("__size"),
    ).groupBy("__step", "__writer").agg(
        F.count(F.lit(1)).alias("__rows"), F.sum("__size").alias("__bytes"),
        F.max("__us").alias("__newest"),
    )
    lengths = F.array(*[F.lit(s).cast("long") for s in interval_seconds])
    files = steps.withColumn("interval_seconds", F.explode(lengths)).withColumn(
        "__commit",
        F.call_function("div", F.col("__step"), F.call_function("div", F.col("interval_seconds"), F.lit(step))),
    ).groupBy("interval_seconds", "__commit", "__writer").agg(
        F.sum("__rows").alias("__rows"), F.sum("__bytes").alias("__bytes"),
        F.max("__newest").alias("__newest"),
    )
    commits = files.groupBy("interval_seconds", "__commit").agg(
        F.count(F.lit(1)).alias("__files"), F.sum("__rows").alias("__rows"),
        F.sum("__bytes").alias("__bytes"), F.max("__newest").alias("__newest"),
    )
    closes = (F.col("__commit") + 1) * F.col("interval_seconds")
    runs = commits.withColumn("__wait", closes - F.col("__newest") / F.lit(1_000_000)).groupBy(
        "interval_seconds"
    ).agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("__files").alias("data_files"),
        F.sum("__bytes").alias("data_bytes"),
        F.sum("__rows").alias("rows"),
        F.max("__files").alias("max_files_in_one_commit"),
        F.min("__files").alias("min_files_in_one_commit"),
        F.round(F.max_by("__wait", "__commit"), 1).alias("seconds_to_visible"),
    )
    return runs.withColumn(
        "files_per_commit", F.round(F.col("data_files") / F.col("commits"), 2)
    ).withColumn("avg_data_file_bytes", floor_average(F.col("data_bytes"), F.col("data_files")))
