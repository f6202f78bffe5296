"""Offsets, lag and landing proofs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lag
from tidemark.plans.registry import Registry
from tidemark.plans.tables import LOG_SQL, highest, hour, log_of_events
from tidemark.sources.log import end_offsets, landed
from tidemark.sources.offsets import newest_offsets, rewound

REGISTRY = Registry()
# The group had read the records of the first half of the numbers, the table shows the first sixth.
NUMBERS_SQL = "(SELECT max(event_id) + 1 FROM events)"

COMMITTED_SQL = LOG_SQL + f""", ends AS (SELECT "partition", max("offset") + 1 AS end_offset FROM log GROUP BY 1),
committed AS (SELECT "partition", max("offset") + 1 AS "offset" FROM log
  WHERE event_id * 2 < {NUMBERS_SQL} GROUP BY 1)"""


def _part(log, share: int):
    """The records of the first 1/share of the numbers there are."""
    numbers = highest(log, "event_id") + 1
    return log.where(F.col("event_id") < -(-numbers // share))


def committed(log):
    """The group's history: one commit per hour, of which the newest counts."""
    hourly = _part(log, 2).groupBy("partition", hour().alias("h")).agg(
        (F.max("offset") + 1).alias("offset"), F.max("event_id").alias("version")
    )
    return newest_offsets(hourly.select(
        F.lit("readers").alias("group"), F.lit("feed").alias("topic"), "partition", "offset", "version",
    ))


@REGISTRY.add("end_offsets", f'WITH {COMMITTED_SQL} SELECT "partition", end_offset FROM ends')
def end_offsets_plan(spark, sf_dir):
    return end_offsets(log_of_events(spark, sf_dir))


@REGISTRY.add(
    "group_offsets",
    f"""WITH {COMMITTED_SQL} SELECT 'readers' AS "group", 'feed' AS topic, "partition", "offset" FROM committed""",
)
def group_offsets(spark, sf_dir):
    return committed(log_of_events(spark, sf_dir))


@REGISTRY.add(
    "partition_lag",
    f"""WITH {COMMITTED_SQL} SELECT "partition", "offset", coalesce(end_offset, 0) AS end_offset,
   coalesce(end_offset, 0) - "offset" AS lag FROM committed LEFT JOIN ends USING ("partition")""",
)
def partition_lag(spark, sf_dir):
    log = log_of_events(spark, sf_dir)
    return lag.partition_lag(committed(log).select("partition", "offset"), end_offsets(log))


@REGISTRY.add(
    "consumer_lag",
    f"""WITH {COMMITTED_SQL} SELECT CAST(sum(coalesce(end_offset, 0) - "offset") AS BIGINT) AS consumer_lag
   FROM committed LEFT JOIN ends USING ("partition")""",
)
def consumer_lag(spark, sf_dir):
    log = log_of_events(spark, sf_dir)
    return lag.consumer_lag(committed(log), end_offsets(log))


@REGISTRY.add(
    "lag_and_staleness",
    f"""WITH {COMMITTED_SQL}, visible AS (SELECT count(*) AS n FROM events WHERE event_id * 6 < {NUMBERS_SQL})
   SELECT CAST((SELECT sum(end_offset) FROM ends) AS BIGINT) AS rows_in_log,
     CAST((SELECT sum(end_offset - "offset") FROM ends JOIN committed USING ("partition")) AS BIGINT) AS consumer_lag,
     n AS rows_visible, CAST((SELECT sum(end_offset) FROM ends) - n AS BIGINT) AS rows_behind FROM visible""",
)
def lag_and_staleness(spark, sf_dir):
    """Half of the log read, a sixth of it in the table: the lag does not say how far the table is behind."""
    log = log_of_events(spark, sf_dir)
    visible = _part(log, 6).agg(F.count(F.lit(1)).alias("rows_visible"))
    return lag.lag_and_staleness(committed(log).select("partition", "offset"), end_offsets(log), visible)


@REGISTRY.add(
    "landed_check",
    f"""WITH fed AS (SELECT count(*) AS n FROM events WHERE event_id * 2 >= {NUMBERS_SQL})
   SELECT n AS landed, n AS fed, true AS proven FROM fed""",
)
def landed_check(spark, sf_dir):
    """The log grew by exactly the second half of the numbers."""
    log = log_of_events(spark, sf_dir)
    first = _part(log, 2)
    fed = log.join(first.select("event_id"), "event_id", "left_anti").agg(F.count(F.lit(1)).alias("fed"))
    return landed(end_offsets(first), end_offsets(log), fed)


@REGISTRY.add(
    "rewind_offsets",
    f"""WITH {COMMITTED_SQL} SELECT "partition", "offset" AS committed, CAST(0 AS BIGINT) AS earliest, end_offset AS latest
   FROM committed JOIN ends USING ("partition")""",
)
def rewind_offsets(spark, sf_dir):
    """The group's offsets moved to either end of the log."""
    log = log_of_events(spark, sf_dir)
    now = committed(log)
    moved = now.select("partition", F.col("offset").alias("committed"))
    for end in ("earliest", "latest"):
        there = rewound(now, log, end).select("partition", F.col("offset").alias(end))
        moved = moved.join(there, "partition")
    return moved
