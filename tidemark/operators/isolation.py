"""Transactions: which records a reader may see, and the timeout rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.functions import duration_ms
from tidemark.operators.audit import latest_per_key

COMMITTED, ABORTED, ONGOING = "CompleteCommit", "CompleteAbort", "Ongoing"


def latest_states(markers: DataFrame, prefix: str = "") -> DataFrame:
    """State and timeout of each transaction whose id starts with `prefix`.

    Needs `txn_id`, `state`, `timeout_ms` and an ordering column `version`.
    """
    mine = markers.where(F.col("txn_id").cast("string").startswith(prefix))
    return latest_per_key(mine, "txn_id", "version").select("txn_id", "state", "timeout_ms")


def read_committed(records: DataFrame, states: DataFrame) -> DataFrame:
    """Records whose transaction committed (J5). `states`: one row per txn_id.

    A semi join never multiplies rows, and AQE splits the partition of a
    transaction that wrote a large share of them.
    """
    committed = states.where(F.col("state") == COMMITTED).select("txn_id")
    return records.join(committed, "txn_id", "left_semi")


def isolation_counts(records: DataFrame, states: DataFrame, by: list[str] = ()) -> DataFrame:
    """Written, readable, never visible (S23). Records are counted per
    transaction before they meet the states, so no hot transaction is shuffled."""
    per_txn = records.groupBy("txn_id", *by).agg(F.count(F.lit(1)).alias("n"))
    seen = per_txn.join(states.select("txn_id", "state"), "txn_id", "left")
    readable = F.sum(F.when(F.col("state") == COMMITTED, F.col("n")))
    counts = seen.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records_written"),
        F.coalesce(readable, F.lit(0)).alias("records_readable"),
    )
    return counts.withColumn(
        "records_never_committed", F.col("records_written") - F.col("records_readable")
    )


def timeout_below_interval(timeout_ms: Column, interval: Column) -> Column:
    """Is the transaction timeout shorter than the commit interval?"""
    return timeout_ms < duration_ms(interval)


def check_timeout_rule(
    interval_ms: int, duration_ms_: int, restart_ms: int, timeout_ms: int, broker_max_ms: int
) -> None:
    """Refuse a configuration whose transactions can expire before they commit (I14):
    interval + checkpoint duration + restart < timeout <= broker maximum."""
    needed = interval_ms + duration_ms_ + restart_ms
    if not needed < timeout_ms:
        raise Refused(f"a transaction may stay open {needed} ms, its timeout is {timeout_ms} ms")
    if timeout_ms > broker_max_ms:
        raise Refused(f"timeout {timeout_ms} ms is above the maximum {broker_max_ms} ms")


def settle_by_timeout(transactions: DataFrame) -> DataFrame:
    """What the coordinator makes of each transaction.

    Needs `opened_at`, `commit_at` (NULL while open) and `timeout_ms`. One that
    stays open longer than its timeout is aborted, whatever its writer believes.
    """
    open_ms = (
        F.unix_micros(F.col("commit_at").cast("timestamp"))
        - F.unix_micros(F.col("opened_at").cast("timestamp"))
    ) / F.lit(1000)
    state = (
        F.when(F.col("commit_at").isNull(), ONGOING)
        .when(open_ms > F.col("timeout_ms"), ABORTED)
        .otherwise(COMMITTED)
    )
    return transactions.withColumn("state", state)


def sample_states(observed: DataFrame, by: list[str]) -> DataFrame:
    """One poll of the coordinator: states seen, how many ongoing, timeouts registered."""
    return observed.groupBy(*by).agg(
        F.sort_array(F.collect_set("state")).alias("states"),
        F.count_if(F.col("state") == ONGOING).alias("ongoing"),
        F.sort_array(F.collect_set("timeout_ms")).alias("timeouts"),
    )


def summarise_samples(samples: DataFrame, by: list[str]) -> DataFrame:
    """A run's polls: how many, how many with one ongoing, every state and timeout seen.

    One pass: what is collected are the different sets a poll can see, a handful
    for a handful of state names and configured timeouts.
    """
    def seen(column: str) -> Column:
        return F.sort_array(F.array_distinct(F.flatten(F.collect_set(column))))

    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples_taken"),
        F.count_if(F.col("ongoing") > 0).alias("samples_with_one_ongoing"),
        seen("states").alias("states_observed"),
        seen("timeouts").alias("timeouts_registered"),
    )


def timeout_findings(runs: DataFrame, short: str, long: str, key: str = "run_key") -> DataFrame:
    """Records lost under the short and the long timeout, and what raising it gave back."""
    lost = F.col("events_in") - F.col("records_readable")
    return runs.agg(
        F.max(F.when(F.col(key) == short, lost)).alias("lost_short"),
        F.max(F.when(F.col(key) == long, lost)).alias("lost_long"),
    ).withColumn("recovered", F.col("lost_short") - F.col("lost_long"))
