"""Snapshots, files and commit intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import layout
from tidemark.plans.registry import Registry
from tidemark.plans.tables import (
    COMMITS_SQL, FILES_SQL, WRITERS, commits_by_hour, files_by_hour, read,
)

REGISTRY = Registry()


@REGISTRY.add(
    "snapshot_history",
    f"""WITH {COMMITS_SQL} SELECT commit_id, committed_at, operation, watermark, coalesce(added, 0) AS added_files
   FROM commits ORDER BY committed_at""",
)
def snapshot_history(spark, sf_dir):
    commits = layout.added_files(commits_by_hour(spark, sf_dir))
    return commits.select(
        "commit_id", "committed_at", "operation",
        layout.summary_value(layout.WATERMARK_KEY).alias("watermark"), "added_files",
    ).orderBy("committed_at")


@REGISTRY.add(
    "committed_watermark",
    f"""WITH {COMMITS_SQL} SELECT run, committed_at, watermark FROM commits
   QUALIFY row_number() OVER (PARTITION BY run ORDER BY committed_at DESC) = 1""",
)
def committed_watermark(spark, sf_dir):
    """Per day, the newest snapshot's watermark, NULL where it carries none."""
    return layout.newest_watermark(commits_by_hour(spark, sf_dir), ["run"])


FILES_SUMMARY_SQL = """count(*) FILTER (content = 0) AS data_files, count(*) FILTER (content <> 0) AS delete_files,
  CAST(coalesce(sum(file_size_in_bytes) FILTER (content = 0), 0) AS BIGINT) AS data_bytes,
  CAST(coalesce(sum(file_size_in_bytes) FILTER (content <> 0), 0) AS BIGINT) AS delete_bytes,
  CAST(coalesce(coalesce(sum(file_size_in_bytes) FILTER (content = 0), 0) // nullif(count(*) FILTER (content = 0), 0), 0) AS BIGINT)
    AS avg_data_file_bytes"""


@REGISTRY.add("files_summary", f"WITH {FILES_SQL} SELECT {FILES_SUMMARY_SQL} FROM files")
def files_summary(spark, sf_dir):
    return layout.files_summary(files_by_hour(spark, sf_dir))


@REGISTRY.add(
    "files_summary_by_type",
    f"WITH {FILES_SQL} SELECT event_type, {FILES_SUMMARY_SQL} FROM files GROUP BY event_type",
)
def files_summary_by_type(spark, sf_dir):
    """Per event type; some have delete files only, whose average is 0."""
    return layout.files_summary(files_by_hour(spark, sf_dir), ["event_type"])


@REGISTRY.add(
    "commit_layout",
    f"""WITH {COMMITS_SQL} SELECT run, count(*) AS commits, CAST(sum(coalesce(added, 0)) AS BIGINT) AS data_files,
   round(sum(coalesce(added, 0)) / count(*), 2) AS files_per_commit,
   max(coalesce(added, 0)) AS max_files_in_one_commit, min(coalesce(added, 0)) AS min_files_in_one_commit
   FROM commits GROUP BY run""",
)
def commit_layout(spark, sf_dir):
    return layout.commit_layout(commits_by_hour(spark, sf_dir), ["run"])


@REGISTRY.add(
    "freshness",
    f"""WITH {COMMITS_SQL}, waits AS (SELECT run, committed_at,
     (epoch_us(committed_at) - epoch_us(newest_record_at)) / 1000000.0 AS wait FROM commits)
   SELECT run, round(max(wait), 1) AS worst_seconds_to_visible,
          round(max_by(wait, committed_at), 1) AS last_seconds_to_visible FROM waits GROUP BY run""",
)
def freshness(spark, sf_dir):
    return layout.freshness(commits_by_hour(spark, sf_dir), ["run"])


INTERVALS = [300, 3600, 21600, 86400]
INTERVAL_SQL = """placed AS (
  SELECT i.s AS interval_seconds, epoch_us(ts) // (i.s * 1000000) AS c, user_id % 4 AS w,
         count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS b, max(epoch_us(ts)) AS newest
  FROM events, (SELECT unnest([300, 3600, 21600, 86400])::BIGINT AS s) i GROUP BY ALL),
per_commit AS (SELECT interval_seconds, c, count(*) AS f, sum(n) AS n, sum(b) AS b, max(newest) AS newest
  FROM placed GROUP BY ALL),
layout AS (SELECT interval_seconds, count(*) AS commits, CAST(sum(f) AS BIGINT) AS data_files,
  CAST(sum(b) AS BIGINT) AS data_bytes, CAST(sum(n) AS BIGINT) AS rows, max(f) AS max_files_in_one_commit,
  min(f) AS min_files_in_one_commit,
  round(max_by((c + 1) * interval_seconds - newest / 1000000.0, c), 1) AS seconds_to_visible,
  round(sum(f) / count(*), 2) AS files_per_commit, CAST(sum(b) // sum(f) AS BIGINT) AS avg_data_file_bytes
  FROM per_commit GROUP BY 1)"""


def interval_runs(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return layout.interval_layout(
        events, "ts", INTERVALS, F.col("user_id") % WRITERS, F.length("props")
    )


@REGISTRY.add("interval_layout", f"WITH {INTERVAL_SQL} SELECT * FROM layout")
def interval_layout(spark, sf_dir):
    """One feed under four commit intervals: fewer, larger, later."""
    return interval_runs(spark, sf_dir)
