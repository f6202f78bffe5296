"""Transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import isolation
from tidemark.plans.ingest_plans import BATCHES, landed_stream
from tidemark.plans.registry import Registry
from tidemark.plans.tables import read
from tidemark.streaming.transactions import TransactionalLog
from tidemark.workspace import new_dir

REGISTRY = Registry()

# An order is a transaction, its line items the records written in it.
STATE_SQL = """txns AS (SELECT o_orderkey AS txn_id, o_orderdate, o_orderpriority,
  CASE o_orderstatus WHEN 'F' THEN 'CompleteCommit' WHEN 'P' THEN 'CompleteAbort' ELSE 'Ongoing' END AS state,
  CASE WHEN o_totalprice < 100000 THEN 5000 ELSE 300000 END AS timeout_ms FROM orders)"""


def transactions(spark, sf_dir):
    state = (
        F.when(F.col("o_orderstatus") == "F", isolation.COMMITTED)
        .when(F.col("o_orderstatus") == "P", isolation.ABORTED)
        .otherwise(isolation.ONGOING)
    )
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("txn_id"), state.alias("state"),
        F.when(F.col("o_totalprice") < 100_000, 5_000).otherwise(300_000).alias("timeout_ms"),
        "o_orderdate", "o_orderpriority",
    )


def records(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "txn_id")


@REGISTRY.add(
    "read_committed",
    f"""WITH {STATE_SQL} SELECT l_orderkey AS txn_id, l_linenumber, l_partkey, l_quantity FROM lineitem
   WHERE l_orderkey IN (SELECT txn_id FROM txns WHERE state = 'CompleteCommit')""",
)
def read_committed(spark, sf_dir):
    rows = records(spark, sf_dir).select("txn_id", "l_linenumber", "l_partkey", "l_quantity")
    return isolation.read_committed(rows, transactions(spark, sf_dir))


@REGISTRY.add(
    "isolation_gap",
    f"""WITH {STATE_SQL} SELECT l_returnflag, count(*) AS records_written,
   count(*) FILTER (state = 'CompleteCommit') AS records_readable,
   count(*) - count(*) FILTER (state = 'CompleteCommit') AS records_never_committed
   FROM lineitem LEFT JOIN txns ON l_orderkey = txn_id GROUP BY l_returnflag""",
)
def isolation_gap(spark, sf_dir):
    """Written against readable, per output."""
    return isolation.isolation_counts(
        records(spark, sf_dir), transactions(spark, sf_dir), ["l_returnflag"]
    )


@REGISTRY.add(
    "transaction_states",
    """WITH m AS (SELECT 'copy-' || l_orderkey AS txn_id, l_linenumber,
     CASE l_linestatus WHEN 'F' THEN 'CompleteCommit' ELSE 'Ongoing' END AS state, 1000 * l_linenumber AS timeout_ms, l_shipdate FROM lineitem)
   SELECT txn_id, max_by(state, (epoch_us(l_shipdate), l_linenumber, timeout_ms, state)) AS state,
     CAST(max_by(timeout_ms, (epoch_us(l_shipdate), l_linenumber, timeout_ms, state)) AS INTEGER) AS timeout_ms
   FROM m GROUP BY txn_id""",
)
def transaction_states(spark, sf_dir):
    """Newest marker of each of one job's transactions.

    Two jobs share the marker table; the id's prefix tells them apart.
    """
    state = F.when(F.col("l_linestatus") == "F", isolation.COMMITTED).otherwise(isolation.ONGOING)
    mine = read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.lit("copy"), F.col("l_orderkey")).alias("txn_id"), state.alias("state"),
        (F.col("l_linenumber") * 1000).cast("int").alias("timeout_ms"),
        F.struct(
            F.col("l_shipdate").alias("at"), "l_linenumber",
            (F.col("l_linenumber") * 1000).cast("int").alias("timeout_ms"), state.alias("state"),
        ).alias("version"),
    )
    theirs = transactions(spark, sf_dir).select(
        F.concat_ws("-", F.lit("ingest"), F.col("txn_id")).alias("txn_id"), "state",
        F.col("timeout_ms").cast("int").alias("timeout_ms"),
        F.struct(
            F.col("o_orderdate").alias("at"), F.lit(1).alias("l_linenumber"),
            F.col("timeout_ms").cast("int").alias("timeout_ms"), F.col("state").alias("state"),
        ).alias("version"),
    )
    return isolation.latest_states(mine.unionByName(theirs), "copy-")


SAMPLES_SQL = f"""{STATE_SQL}, samples AS (
  SELECT o_orderpriority AS run_key, o_orderdate AS polled, list_sort(list(DISTINCT state)) AS states,
         count(*) FILTER (state = 'Ongoing') AS ongoing, list_sort(list(DISTINCT timeout_ms)) AS timeouts
  FROM txns GROUP BY ALL)"""


def state_samples(spark, sf_dir):
    observed = transactions(spark, sf_dir).withColumnRenamed("o_orderpriority", "run_key").withColumnRenamed(
        "o_orderdate", "polled"
    )
    return isolation.sample_states(observed, ["run_key", "polled"])


@REGISTRY.add(
    "txn_state_summary",
    f"""WITH {SAMPLES_SQL}, c AS (SELECT run_key, count(*) AS samples_taken, count(*) FILTER (ongoing > 0) AS samples_with_one_ongoing
     FROM samples GROUP BY 1),
   s AS (SELECT run_key, array_to_string(list_sort(list(DISTINCT v)), ',') AS states_observed FROM (SELECT run_key, unnest(states) AS v FROM samples) GROUP BY 1),
   t AS (SELECT run_key, array_to_string(list_sort(list(DISTINCT v)), ',') AS timeouts_registered FROM (SELECT run_key, unnest(timeouts) AS v FROM samples) GROUP BY 1)
   SELECT run_key, samples_taken, samples_with_one_ongoing, states_observed, timeouts_registered
   FROM c JOIN s USING (run_key) JOIN t USING (run_key)""",
)
def txn_state_summary(spark, sf_dir):
    summary = isolation.summarise_samples(state_samples(spark, sf_dir), ["run_key"])
    return summary.withColumn("states_observed", F.array_join("states_observed", ",")).withColumn(
        "timeouts_registered", F.array_join(F.col("timeouts_registered").cast("array<string>"), ",")
    )


SHORT_MS, LONG_MS = 20 * 86_400_000, 400 * 86_400_000
# A transaction is opened with its first line item and committed with its last.
TIMEOUT_SQL = f"""opened AS (SELECT l_orderkey AS txn_id, min(l_shipdate) AS opened_at, max(l_shipdate) AS commit_at, count(*) AS n
  FROM lineitem GROUP BY 1),
timed AS (SELECT k.run_key, k.timeout_ms, o.*, CASE WHEN (epoch_us(commit_at) - epoch_us(opened_at)) / 1000.0 > k.timeout_ms
    THEN 'CompleteAbort' ELSE 'CompleteCommit' END AS state
  FROM opened o, (VALUES ('short', {SHORT_MS}::BIGINT), ('long', {LONG_MS}::BIGINT)) k(run_key, timeout_ms))"""


def timed_transactions(spark, sf_dir):
    """Every transaction under a short and under a long timeout."""
    opened = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("txn_id")).agg(
        F.min("l_shipdate").alias("opened_at"), F.max("l_shipdate").alias("commit_at"),
        F.count(F.lit(1)).alias("n"),
    )
    settings = F.array(*[
        F.struct(F.lit(k).alias("run_key"), F.lit(ms).cast("long").alias("timeout_ms"))
        for k, ms in (("short", SHORT_MS), ("long", LONG_MS))
    ])
    both = opened.withColumn("s", F.explode(settings)).select("*", "s.*").drop("s")
    return isolation.settle_by_timeout(both)


@REGISTRY.add(
    "txn_timeout_check",
    f"""WITH {TIMEOUT_SQL} SELECT run_key, timeout_ms, timeout_ms < 10368000000 AS below_interval,
   count(*) FILTER (state = 'CompleteAbort') AS aborted, count(*) FILTER (state = 'CompleteCommit') AS committed
   FROM timed GROUP BY ALL""",
)
def txn_timeout_check(spark, sf_dir):
    """Transactions open for longer than their timeout are aborted."""
    interval = F.lit(f"{120 * 24}h")
    return timed_transactions(spark, sf_dir).groupBy("run_key", "timeout_ms").agg(
        F.count_if(F.col("state") == isolation.ABORTED).alias("aborted"),
        F.count_if(F.col("state") == isolation.COMMITTED).alias("committed"),
    ).withColumn("below_interval", isolation.timeout_below_interval(F.col("timeout_ms"), interval))


@REGISTRY.add(
    "txn_findings",
    f"""WITH {TIMEOUT_SQL}, lost AS (SELECT run_key, CAST(coalesce(sum(n) FILTER (state <> 'CompleteCommit'), 0) AS BIGINT) AS n FROM timed GROUP BY 1)
   SELECT (SELECT n FROM lost WHERE run_key = 'short') AS lost_short, (SELECT n FROM lost WHERE run_key = 'long') AS lost_long,
     (SELECT n FROM lost WHERE run_key = 'short') - (SELECT n FROM lost WHERE run_key = 'long') AS recovered""",
)
def txn_findings(spark, sf_dir):
    """What raising the timeout gives back."""
    readable = F.sum(F.when(F.col("state") == isolation.COMMITTED, F.col("n")).otherwise(0))
    runs = timed_transactions(spark, sf_dir).groupBy("run_key").agg(
        F.sum("n").alias("events_in"), readable.alias("records_readable")
    )
    return isolation.timeout_findings(runs, "short", "long")


@REGISTRY.add(
    "txn_copy",
    f"""SELECT 'short' AS run_key, count(*) AS records_written, CAST(0 AS BIGINT) AS records_readable, {BATCHES} AS transactions, 'CompleteAbort' AS states FROM events
   UNION ALL SELECT 'long', count(*), count(*), {BATCHES}, 'CompleteCommit' FROM events""",
)
def txn_copy(spark, sf_dir):
    """A transactional copy of the feed under a short and a long timeout."""
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "copy")
    source = landed_stream(events, sf_dir, f"{root}/landing")
    rows = []
    for run_key, timeout_ms in (("short", 5_000), ("long", 3_600_000)):
        log = TransactionalLog(spark, f"{root}/{run_key}", events.schema)
        query = (
            source.writeStream.option("checkpointLocation", f"{root}/checkpoint-{run_key}")
            .trigger(availableNow=True)
            .foreachBatch(log.writer(f"copy-{run_key}-i120s", 120_000, timeout_ms)).start()
        )
        query.awaitTermination()
        states = log.states(f"copy-{run_key}").select("state").collect()  # one per batch
        rows.append((
            run_key, log.read("read_uncommitted").count(), log.read("read_committed").count(),
            len(states), ",".join(sorted({s["state"] for s in states})),
        ))
    return spark.createDataFrame(
        rows, "run_key string, records_written long, records_readable long, transactions int, states string"
    )
