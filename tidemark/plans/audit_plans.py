"""Audits of what landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit
from tidemark.plans.registry import Registry
from tidemark.plans.tables import feed, highest, read

REGISTRY = Registry()

# A feed whose signups were read a second time.
REPLAYED_SQL = """replayed AS (
  SELECT event_id AS seq, user_id AS key FROM events
  UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'signup')"""
# The same without its errors: gaps as well as duplicates.
DAMAGED_SQL = """damaged AS (
  SELECT event_id AS seq, user_id AS key FROM events WHERE event_type <> 'error'
  UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'signup')"""
RUNS_SQL = """sentinels AS (
  SELECT DISTINCT seq FROM present WHERE seq BETWEEN 0 AND (SELECT hi FROM bounds)
  UNION ALL SELECT -1 UNION ALL SELECT hi + 1 FROM bounds),
steps AS (SELECT seq, lead(seq) OVER (ORDER BY seq) AS following FROM sentinels),
runs AS (SELECT seq + 1 AS run_start, following - 1 AS run_end FROM steps WHERE following - seq > 1)"""


def replayed(spark, sf_dir):
    rows = feed(spark, sf_dir)
    return rows.unionByName(rows.where(F.col("source") == "signup"))


def damaged(spark, sf_dir):
    return replayed(spark, sf_dir).where(F.col("source") != "error")


@REGISTRY.add(
    "duplicate_rows",
    f"""WITH {REPLAYED_SQL} SELECT count(*) AS rows, count(DISTINCT seq) AS distinct_seq,
        count(*) - count(DISTINCT seq) AS duplicate_seq_rows FROM replayed""",
)
def duplicate_rows(spark, sf_dir):
    return audit.seq_counts(replayed(spark, sf_dir))


@REGISTRY.add(
    "duplicate_keys",
    """SELECT count(*) AS rows, count(DISTINCT o_custkey) AS distinct_keys,
       count(*) - count(DISTINCT o_custkey) AS duplicate_key_rows FROM orders""",
)
def duplicate_keys(spark, sf_dir):
    return audit.key_counts(read(spark, sf_dir, "orders"), "o_custkey")


@REGISTRY.add(
    "key_readback",
    """SELECT count(DISTINCT o_custkey) AS distinct_keys, min(o_orderkey) AS min_seq,
       max(o_orderkey) AS max_seq FROM orders""",
)
def key_readback(spark, sf_dir):
    return audit.key_readback(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@REGISTRY.add("ordered_seqs", f"WITH {REPLAYED_SQL} SELECT seq FROM replayed ORDER BY seq")
def ordered_seqs(spark, sf_dir):
    """Every sequence number in order, copies kept (O1, P2). No audit needs it."""
    return replayed(spark, sf_dir).select("seq").orderBy("seq")


@REGISTRY.add(
    "missing_seq_runs",
    f"""WITH present AS (SELECT event_id AS seq FROM events WHERE event_type <> 'error'),
bounds AS (SELECT max(event_id) AS hi FROM events), {RUNS_SQL} SELECT run_start, run_end FROM runs""",
)
def missing_seq_runs(spark, sf_dir):
    rows = feed(spark, sf_dir)
    hi = highest(rows, "seq")
    return audit.missing_runs(rows.where(F.col("source") != "error"), 0, hi)


@REGISTRY.add(
    "missing_order_runs",
    f"""WITH present AS (SELECT l_orderkey AS seq FROM lineitem),
bounds AS (SELECT max(o_orderkey) AS hi FROM orders), {RUNS_SQL} SELECT run_start, run_end FROM runs""",
)
def missing_order_runs(spark, sf_dir):
    """Order numbers no line item refers to."""
    hi = highest(read(spark, sf_dir, "orders"), "o_orderkey")
    return audit.missing_runs(read(spark, sf_dir, "lineitem"), 0, hi, "l_orderkey")


@REGISTRY.add(
    "expected_state",
    """SELECT o_custkey, max(o_orderkey) AS latest_seq, count(*) AS assertions
       FROM orders GROUP BY o_custkey""",
)
def expected_state(spark, sf_dir):
    return audit.expected_state(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@REGISTRY.add(
    "latest_per_key",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
       FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
)
def latest_per_key(spark, sf_dir):
    return audit.latest_per_key(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


def _append_sql(table_sql: str, name: str) -> str:
    return f"""WITH {table_sql}, present AS (SELECT seq FROM {name}),
bounds AS (SELECT max(event_id) AS hi FROM events), {RUNS_SQL},
gaps AS (SELECT count(*) AS missing_runs, CAST(coalesce(sum(run_end - run_start + 1), 0) AS BIGINT) AS missing_seqs FROM runs),
counts AS (SELECT count(*) AS rows, count(DISTINCT seq) AS distinct_seq,
                  count(*) - count(DISTINCT seq) AS duplicate_seq_rows FROM {name})
SELECT rows, distinct_seq, duplicate_seq_rows, missing_runs, missing_seqs, hi + 1 AS events_expected,
       rows = hi + 1 AND duplicate_seq_rows = 0 AND missing_runs = 0 AS complete
FROM counts, gaps, bounds"""


CLEAN_SQL = "clean AS (SELECT event_id AS seq, user_id AS key FROM events)"


@REGISTRY.add("append_verdict", _append_sql(CLEAN_SQL, "clean"))
def append_verdict(spark, sf_dir):
    rows = feed(spark, sf_dir)
    return audit.append_verdict(rows, 0, highest(rows, "seq"))


@REGISTRY.add("append_verdict_damaged", _append_sql(DAMAGED_SQL, "damaged"))
def append_verdict_damaged(spark, sf_dir):
    hi = highest(feed(spark, sf_dir), "seq")
    return audit.append_verdict(damaged(spark, sf_dir), 0, hi)


# A keyed table built from a feed without its purchases: keys whose last
# record was one carry an older record; refunded keys got a second row.
HELD_SQL = """expected AS (SELECT user_id AS key, max(event_id) AS latest_seq FROM events GROUP BY 1),
held AS (
  SELECT user_id AS key, max(event_id) AS seq FROM events WHERE event_type <> 'purchase' GROUP BY 1
  UNION ALL SELECT user_id, max(event_id) FROM events WHERE event_type = 'error' AND value > 40 GROUP BY 1),
state AS (
  SELECT coalesce(h.key, e.key) AS key, h.seq AS held_seq, e.latest_seq AS expected_seq,
         coalesce(h.n, 0) AS held_rows,
         CASE WHEN h.seq IS NULL THEN 'missing' WHEN e.latest_seq IS NULL THEN 'unexpected'
              WHEN h.seq <> e.latest_seq THEN 'stale' ELSE 'latest' END AS status
  FROM (SELECT key, max(seq) AS seq, count(*) AS n FROM held GROUP BY 1) h
  FULL JOIN expected e ON h.key = e.key)"""


def held(spark, sf_dir):
    rows = feed(spark, sf_dir)
    first = audit.expected_state(rows.where(F.col("source") != "purchase"), "key", "seq")
    second = audit.expected_state(
        rows.where((F.col("source") == "error") & (F.col("value") > 40)), "key", "seq"
    )
    return first.unionByName(second).select("key", F.col("latest_seq").alias("seq"))


@REGISTRY.add(
    "held_against_expected",
    f"WITH {HELD_SQL} SELECT key, held_seq, expected_seq, held_rows, status FROM state",
)
def held_against_expected(spark, sf_dir):
    expected = audit.expected_state(feed(spark, sf_dir), "key", "seq")
    return audit.held_against_expected(held(spark, sf_dir), expected, "key", "seq")


UPSERT_SQL = """SELECT CAST(sum(held_rows) AS BIGINT) AS rows, count(expected_seq) AS keys_expected,
  count(*) FILTER (held_rows > 0) AS keys_held,
  count(*) FILTER (status IN ('stale', 'unexpected')) AS keys_not_latest,
  count(*) FILTER (status = 'missing') AS keys_missing,
  CAST(sum(held_rows) AS BIGINT) - count(*) FILTER (held_rows > 0) AS duplicate_key_rows,
  count(*) FILTER (held_rows > 0) = count(expected_seq)
    AND count(*) FILTER (status IN ('stale', 'unexpected')) = 0
    AND sum(held_rows) = count(*) FILTER (held_rows > 0) AS complete"""


@REGISTRY.add("upsert_verdict", f"WITH {HELD_SQL} {UPSERT_SQL} FROM state")
def upsert_verdict(spark, sf_dir):
    expected = audit.expected_state(feed(spark, sf_dir), "key", "seq")
    return audit.upsert_verdict(held(spark, sf_dir), expected, "key", "seq")


@REGISTRY.add(
    "measure_append",
    f"""SELECT a.*, (SELECT count(DISTINCT key) FROM (SELECT user_id AS key FROM events WHERE event_type <> 'error')) AS distinct_keys,
   a.rows - (SELECT count(DISTINCT user_id) FROM events WHERE event_type <> 'error') AS duplicate_key_rows
   FROM ({_append_sql(DAMAGED_SQL, 'damaged')}) a""",
)
def measure_append(spark, sf_dir):
    hi = highest(feed(spark, sf_dir), "seq")
    return audit.measure_append(damaged(spark, sf_dir), 0, hi, "key", "seq")


@REGISTRY.add(
    "measure_upsert",
    f"""WITH {HELD_SQL} {UPSERT_SQL},
   (SELECT count(*) - count(DISTINCT seq) FROM held) AS duplicate_seq_rows FROM state""",
)
def measure_upsert(spark, sf_dir):
    expected = audit.expected_state(feed(spark, sf_dir), "key", "seq")
    return audit.measure_upsert(held(spark, sf_dir), expected, "key", "seq")


@REGISTRY.add(
    "rows_lost",
    f"""WITH {DAMAGED_SQL}, n AS (SELECT count(*) AS rows, count(DISTINCT seq) AS distinct_seq FROM damaged),
   e AS (SELECT count(*) AS expected FROM events)
   SELECT expected, rows, distinct_seq, greatest(expected - distinct_seq, 0) AS lost,
          expected - (rows - (rows - distinct_seq)) AS lost_by_rows, expected - rows AS lost_if_copies_counted
   FROM n, e""",
)
def rows_lost(spark, sf_dir):
    """The three ways of stating loss, against one expected count."""
    rows = damaged(spark, sf_dir)
    expected = read(spark, sf_dir, "events").count()
    counts = audit.seq_counts(rows).withColumn("expected", F.lit(expected).cast("long"))
    once = F.col("rows") - F.col("duplicate_seq_rows")
    return counts.select(
        "expected", "rows", "distinct_seq",
        audit.rows_lost(F.col("expected"), F.col("distinct_seq")).alias("lost"),
        audit.rows_lost(F.col("expected"), once, clamp=False).alias("lost_by_rows"),
        audit.rows_lost(F.col("expected"), F.col("rows"), clamp=False).alias("lost_if_copies_counted"),
    )


@REGISTRY.add(
    "prediction_verdict",
    f"""WITH {REPLAYED_SQL}, runs AS (
  SELECT 'clean append' AS run_key, false AS upsert, false AS predicts_duplicates,
         count(*) - count(DISTINCT event_id) AS duplicate_seq_rows,
         count(*) - count(DISTINCT user_id) AS duplicate_key_rows FROM events
  UNION ALL SELECT 'replayed append', false, true, count(*) - count(DISTINCT seq), count(*) - count(DISTINCT key) FROM replayed
  UNION ALL SELECT 'replayed append, none predicted', false, false, count(*) - count(DISTINCT seq), count(*) - count(DISTINCT key) FROM replayed
  UNION ALL SELECT 'keyed', true, false, 0, 0 FROM (SELECT count(DISTINCT key) FROM replayed))
SELECT *, CASE WHEN upsert THEN duplicate_key_rows ELSE duplicate_seq_rows END AS duplicates_judged,
       predicts_duplicates = (CASE WHEN upsert THEN duplicate_key_rows ELSE duplicate_seq_rows END > 0) AS prediction_held
FROM runs""",
)
def prediction_verdict(spark, sf_dir):
    clean, twice = feed(spark, sf_dir), replayed(spark, sf_dir)
    keyed = audit.latest_per_key(twice.select("key", "seq"), "key", "seq")

    def run(name, rows, upsert, predicted):
        counts = audit.seq_counts(rows).select("duplicate_seq_rows", F.lit(None).cast("long").alias("duplicate_key_rows"))
        keys = audit.key_counts(rows, "key").select(F.lit(None).cast("long").alias("duplicate_seq_rows"), "duplicate_key_rows")
        return counts.unionByName(keys).agg(
            F.max("duplicate_seq_rows").alias("duplicate_seq_rows"),
            F.max("duplicate_key_rows").alias("duplicate_key_rows"),
        ).select(
            F.lit(name).alias("run_key"), F.lit(upsert).alias("upsert"),
            F.lit(predicted).alias("predicts_duplicates"), "duplicate_seq_rows", "duplicate_key_rows",
        )

    runs = run("clean append", clean, False, False)
    runs = runs.unionByName(run("replayed append", twice, False, True))
    runs = runs.unionByName(run("replayed append, none predicted", twice, False, False))
    runs = runs.unionByName(run("keyed", keyed, True, False))
    return audit.prediction_verdict(runs)


@REGISTRY.add(
    "table_difference",
    """WITH l AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
   r AS (SELECT user_id, event_type, count(*) AS n FROM (
     SELECT user_id, event_type FROM events WHERE value < 60
     UNION ALL SELECT user_id, event_type FROM events WHERE event_type = 'signup') GROUP BY ALL)
   SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.event_type, r.event_type) AS event_type,
          coalesce(l.n, 0) - coalesce(r.n, 0) AS surplus
   FROM l FULL JOIN r ON l.user_id = r.user_id AND l.event_type = r.event_type
   WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""",
)
def table_difference(spark, sf_dir):
    """Rows two copies of the feed do not share, with multiplicity."""
    events = read(spark, sf_dir, "events")
    left = events.select("user_id", "event_type")
    right = events.where(F.col("value") < 60).select("user_id", "event_type").unionByName(
        events.where(F.col("event_type") == "signup").select("user_id", "event_type")
    )
    return audit.two_way_difference(left, right)
