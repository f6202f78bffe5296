"""Sampled job state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import samples
from tidemark.operators.layout import WATERMARK_KEY, summary_value
from tidemark.plans.registry import Registry
from tidemark.plans.tables import COMMITS_SQL, SAMPLES_SQL, commits_by_hour, read, samples_by_hour

REGISTRY = Registry()


@REGISTRY.add(
    "freeze_window",
    f"""WITH {SAMPLES_SQL}, g AS (
  SELECT run, count(*) FILTER (checkpoint_id <= watermark) AS frozen_samples,
    coalesce(round(max(seconds) FILTER (checkpoint_id <= watermark), 1), 0.0) AS seconds_frozen,
    list_sort(list(DISTINCT rows_visible) FILTER (checkpoint_id <= watermark)) AS rows_list,
    list_sort(list(DISTINCT job_state) FILTER (checkpoint_id <= watermark)) AS states_list,
    coalesce(max(checkpoints_failed) FILTER (checkpoint_id <= watermark), 0) AS checkpoints_failed_while_frozen,
    min(consumer_lag) FILTER (checkpoint_id <= watermark) AS min_consumer_lag_while_frozen,
    max_by(rows_visible, seconds) AS rows_at_clear
  FROM samples GROUP BY run)
SELECT run, frozen_samples, seconds_frozen, coalesce(array_to_string(rows_list, ','), '') AS rows_while_frozen,
  coalesce(array_to_string(states_list, ','), '') AS job_states_while_frozen, checkpoints_failed_while_frozen,
  min_consumer_lag_while_frozen, rows_at_clear, coalesce(len(rows_list), 0) = 1 AS never_moved,
  CASE WHEN frozen_samples > 0 THEN rows_at_clear - rows_list[1] ELSE 0 END AS rows_in_one_lump FROM g""",
)
def freeze_window(spark, sf_dir):
    window = samples.freeze_window(samples_by_hour(spark, sf_dir), ["run"])
    joined = F.array_join(F.col("rows_while_frozen").cast("array<string>"), ",")
    return window.withColumn("rows_while_frozen", joined).withColumn(
        "job_states_while_frozen", F.array_join("job_states_while_frozen", ",")
    )


@REGISTRY.add(
    "freeze_bounds",
    f"""WITH {SAMPLES_SQL}, g AS (
  SELECT run, max(seconds) FILTER (checkpoint_id <= watermark) AS last_frozen,
    min(seconds) FILTER (checkpoint_id > watermark) AS first_clear,
    min(checkpoint_id) FILTER (checkpoint_id > watermark) AS first_id_above,
    greatest(max(watermark) - min(checkpoint_id) + 1, 0) AS ids_below_watermark,
    min(rows_visible) FILTER (checkpoint_id <= watermark) AS lo, max(rows_visible) FILTER (checkpoint_id <= watermark) AS hi,
    min_by(rows_visible, seconds) FILTER (checkpoint_id > watermark) AS first_rows
  FROM samples GROUP BY run)
SELECT run, last_frozen, first_clear, first_id_above, CAST(ids_below_watermark AS BIGINT) AS ids_below_watermark,
  lo = hi AND first_rows <> hi AS boundary_holds FROM g""",
)
def freeze_bounds(spark, sf_dir):
    return samples.freeze_bounds(samples_by_hour(spark, sf_dir), ["run"])


@REGISTRY.add(
    "poll_gaps",
    f"""WITH {SAMPLES_SQL}, d AS (
  SELECT run, round(seconds - lag(seconds) OVER (PARTITION BY run ORDER BY seconds), 1) AS gap FROM samples),
r AS (SELECT run, gap, row_number() OVER (PARTITION BY run ORDER BY gap) - 1 AS i,
       count(*) OVER (PARTITION BY run) AS gaps FROM d WHERE gap IS NOT NULL)
SELECT run, gaps, gap AS typical_gap FROM r WHERE i = gaps // 2""",
)
def poll_gaps(spark, sf_dir):
    return samples.poll_gaps(samples_by_hour(spark, sf_dir), ["run"])


def daily_counts(spark, sf_dir):
    """Per user and day of the month, the rows visible so far; NULL before the first."""
    events = read(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("run"), F.unix_date(F.to_date("ts")).alias("day")
    ).agg(F.count(F.lit(1)).alias("n"))
    span = events.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    days = F.explode(F.sequence(F.lit(span["lo"]), F.lit(span["hi"])))
    grid = events.select("run").distinct().select("run", days.alias("day"))
    so_far = Window.partitionBy("run").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(events, ["run", "day"], "left").select(
        "run", F.col("day").cast("long").alias("day"), F.sum("n").over(so_far).alias("rows_visible")
    )


@REGISTRY.add(
    "settled_at",
    """WITH d AS (SELECT user_id AS run, CAST(ts AS DATE) - DATE '1970-01-01' AS day, count(*) AS n FROM events GROUP BY ALL),
grid AS (SELECT run, day FROM (SELECT DISTINCT run FROM d),
         (SELECT unnest(generate_series(min(day), max(day))) AS day FROM d)),
s AS (SELECT run, day, CAST(sum(n) OVER (PARTITION BY run ORDER BY day) AS BIGINT) AS rows_visible
      FROM grid LEFT JOIN d USING (run, day)),
q AS (SELECT *, rows_visible IS NOT NULL
        AND rows_visible IS NOT DISTINCT FROM lag(rows_visible, 1) OVER w
        AND rows_visible IS NOT DISTINCT FROM lag(rows_visible, 2) OVER w
        AND rows_visible IS NOT DISTINCT FROM lag(rows_visible, 3) OVER w AS quiet
      FROM s WINDOW w AS (PARTITION BY run ORDER BY day))
SELECT run, min(day) FILTER (quiet) AS settled_at, min_by(rows_visible, day) FILTER (quiet) AS settled_rows,
       max(rows_visible) AS last_rows FROM q GROUP BY run""",
)
def settled_at(spark, sf_dir):
    """The day by which a user's row count had repeated three times."""
    return samples.settled_at(
        daily_counts(spark, sf_dir), ["run"], quiet_polls=3, poll_seconds=86400,
        commit_interval_seconds=86400, at="day",
    )


@REGISTRY.add(
    "asof_watermark",
    f"""WITH {COMMITS_SQL} SELECT e.event_id, c.commit_id, c.watermark, c.rows AS commit_rows
   FROM events e ASOF LEFT JOIN commits c ON e.ts >= c.committed_at""",
)
def asof_watermark(spark, sf_dir):
    """Each event beside the newest commit at that moment."""
    commits = commits_by_hour(spark, sf_dir).select(
        "commit_id", "committed_at", summary_value(WATERMARK_KEY).alias("watermark"),
        F.col("rows").alias("commit_rows"),
    )
    asked = read(spark, sf_dir, "events").select("event_id", "ts")
    payload = ["commit_id", "watermark", "commit_rows"]
    return samples.as_of(asked, commits, "ts", "committed_at", payload).drop("ts")
