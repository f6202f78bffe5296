"""Sessions of the feed as transactions, digests of the feed as a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hash_tree, sessions
from tidemark.plans.registry import Registry
from tidemark.plans.tables import highest, read
from tidemark.workspace import new_dir

REGISTRY = Registry()

# How long an event keeps its user's session open, and how long a session may be open.
LONG_HOURS, SHORT_HOURS, TIMEOUT_HOURS = 12, 4, 24

SESSIONS_SQL = f"""e AS (SELECT user_id, ts, ts + CASE event_type WHEN 'purchase' THEN INTERVAL {LONG_HOURS} HOUR ELSE INTERVAL {SHORT_HOURS} HOUR END AS until FROM events),
b AS (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY ts, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, until ROWS UNBOUNDED PRECEDING) AS session FROM b),
s AS (SELECT user_id, min(ts) AS opened_at, max(ts) AS last_at, max(until) AS open_until, count(*) AS records FROM n GROUP BY user_id, session),
t AS (SELECT *, CASE WHEN open_until >= (SELECT max(ts) FROM events) THEN 'Ongoing'
   WHEN (epoch_us(last_at) - epoch_us(opened_at)) / 1000.0 > {TIMEOUT_HOURS * 3_600_000} THEN 'CompleteAbort' ELSE 'CompleteCommit' END AS state FROM s)"""


def feed_sessions(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    gap = F.when(F.col("event_type") == "purchase", f"{LONG_HOURS} hours").otherwise(f"{SHORT_HOURS} hours")
    end = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    found = sessions.sessions(events, "user_id", "ts", gap)
    return sessions.as_transactions(found, F.lit(end), F.lit(TIMEOUT_HOURS * 3_600_000))


@REGISTRY.add(
    "session_transactions",
    f"WITH {SESSIONS_SQL} SELECT user_id, opened_at, last_at, records, state, CASE state WHEN 'CompleteAbort' THEN records ELSE 0 END AS lost FROM t",
)
def session_transactions(spark, sf_dir):
    """Each user's sessions as transactions: committed, aborted by the timeout, or still open."""
    return feed_sessions(spark, sf_dir).select(
        "user_id", F.col("opened_at").cast("timestamp_ntz").alias("opened_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"),
        "records", "state", "lost")


@REGISTRY.add(
    "session_states",
    f"""WITH {SESSIONS_SQL} SELECT state, count(*) AS transactions, CAST(sum(records) AS BIGINT) AS records,
   CAST(sum(CASE state WHEN 'CompleteAbort' THEN records ELSE 0 END) AS BIGINT) AS lost FROM t GROUP BY state""",
)
def session_states(spark, sf_dir):
    """Transactions and records by state, and what the timeout lost."""
    return feed_sessions(spark, sf_dir).groupBy("state").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("records").alias("records"), F.sum("lost").cast("long").alias("lost"))


BLOCK_ROWS, FAN = 256, 64
LINE_SQL = "concat_ws('|', event_id, user_id, event_type, props)"
TREE_SQL = f"""blocks AS (SELECT event_id // {BLOCK_ROWS} AS place, sha256(string_agg({LINE_SQL}, chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY 1),
middle AS (SELECT place // {FAN} AS place, sha256(string_agg(place || ' ' || digest, chr(10) ORDER BY place)) AS digest FROM blocks GROUP BY 1),
top AS (SELECT place // {FAN} AS place, sha256(string_agg(place || ' ' || digest, chr(10) ORDER BY place)) AS digest FROM middle GROUP BY 1)"""


def line():
    return F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props")


@REGISTRY.add(
    "ordered_digest",
    f"""WITH {TREE_SQL} SELECT 0 AS level, place, digest FROM blocks UNION ALL SELECT 1, place, digest FROM middle
   UNION ALL SELECT 2, place, digest FROM top""",
)
def ordered_digest(spark, sf_dir):
    """The feed in its order as a tree of SHA-256 digests."""
    return hash_tree.tree(read(spark, sf_dir, "events"), "event_id", line(), BLOCK_ROWS, FAN, levels=3)


@REGISTRY.add(
    "digest_difference",
    f"""WITH c AS (SELECT max(event_id) AS hi FROM events)
   SELECT CAST(unnest([hi // 3 // {BLOCK_ROWS}, (hi // 2) // {BLOCK_ROWS}, hi // {BLOCK_ROWS}]) AS BIGINT) AS place FROM c
   GROUP BY 1""",
)
def digest_difference(spark, sf_dir):
    """Blocks in which two feeds differ: one value altered, two neighbours swapped, the last row lost."""
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "trees")
    hi = highest(events, "event_id")
    swapped = hi // 2 // BLOCK_ROWS * BLOCK_ROWS
    number = F.when(F.col("event_id") == swapped, swapped + 1).when(F.col("event_id") == swapped + 1, swapped).otherwise(F.col("event_id"))
    other = events.where(F.col("event_id") < hi).withColumn(
        "event_type", F.when(F.col("event_id") == hi // 3, "altered").otherwise(F.col("event_type"))
    ).withColumn("place_in_feed", number)
    text = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props")
    trees = []
    for name, rows, seq in (("one", events, "event_id"), ("other", other, "place_in_feed")):
        made = hash_tree.tree(rows, seq, text, BLOCK_ROWS, FAN, levels=3)
        made.write.parquet(f"{root}/{name}")
        trees.append(spark.read.schema(hash_tree.DIGEST).parquet(f"{root}/{name}"))
    return hash_tree.differing_blocks(*trees, FAN)
