"""Time series of job and table samples: frozen, settled, as-of.

A sample is one poll, so a run has as many rows as it was polled, however large
the table is; the windows below run over one run's polls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.functions import clamp_zero
from tidemark.workspace import new_dir


def is_frozen(checkpoint: str = "checkpoint_id", watermark: str = "watermark") -> Column:
    """Was the sample taken at or below the watermark? No id, no answer."""
    return F.col(checkpoint).isNotNull() & (F.col(checkpoint) <= F.col(watermark))


def is_clear(checkpoint: str = "checkpoint_id", watermark: str = "watermark") -> Column:
    return F.col(checkpoint).isNotNull() & (F.col(checkpoint) > F.col(watermark))


def freeze_window(samples: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per run over its frozen samples.

    Reads `seconds`, `checkpoint_id`, `watermark`, `rows_visible`, `job_state`,
    `checkpoints_failed` and `consumer_lag`. The least lag is a minimum over frozen samples,
    which leaves NULLs out, so a NULL among them raises an error with its time.
    """
    frozen = is_frozen()
    rows = F.sort_array(F.collect_set(F.when(frozen, F.col("rows_visible"))))
    states = F.sort_array(F.collect_set(F.when(frozen, F.col("job_state"))))
    unread = frozen & F.col("consumer_lag").isNull()
    summed = samples.groupBy(*by).agg(
        F.count_if(frozen).alias("frozen_samples"),
        F.coalesce(F.round(F.max(F.when(frozen, F.col("seconds"))), 1), F.lit(0.0)).alias("seconds_frozen"),
        rows.alias("rows_while_frozen"),
        states.alias("job_states_while_frozen"),
        F.coalesce(F.max(F.when(frozen, F.col("checkpoints_failed"))), F.lit(0))
        .cast("long").alias("checkpoints_failed_while_frozen"),
        F.min(F.when(frozen, F.col("consumer_lag"))).alias("min_consumer_lag_while_frozen"),
        F.max_by("rows_visible", "seconds").alias("rows_at_clear"),
        F.min(F.when(unread, F.col("seconds"))).alias("__unread"),
    )
    refusal = F.raise_error(F.format_string(
        "consumer_lag is NULL in the frozen sample at %s s",
        F.col("__unread").cast("string"),
    )).cast("long")
    lag = F.when(F.col("__unread").isNotNull(), refusal).otherwise(
        F.col("min_consumer_lag_while_frozen")
    )
    return summed.withColumn("min_consumer_lag_while_frozen", lag).drop("__unread").withColumn(
        "never_moved", F.size("rows_while_frozen") == 1
    ).withColumn(
        "rows_in_one_lump",
        F.when(
            F.col("frozen_samples") > 0, F.col("rows_at_clear") - F.col("rows_while_frozen")[0]
        ).otherwise(F.lit(0)).cast("long"),
    )


def freeze_bounds(samples: DataFrame, by: list[str] = ()) -> DataFrame:
    """The freeze ended in [last_frozen, first_clear]; both ends are polls.

    `boundary_holds`: every sample up to the watermark shows the frozen row
    count and the first one above does not. `ids_below_watermark` counts the
    ids the run had to climb (A20).
    """
    first_id = F.min("checkpoint_id")
    frozen_rows = F.max(F.when(is_frozen(), F.col("rows_visible")))
    return samples.groupBy(*by).agg(
        F.max(F.when(is_frozen(), F.col("seconds"))).alias("last_frozen"),
        F.min(F.when(is_clear(), F.col("seconds"))).alias("first_clear"),
        F.min(F.when(is_clear(), F.col("checkpoint_id"))).alias("first_id_above"),
        clamp_zero((F.max("watermark") - first_id + 1).cast("long")).alias("ids_below_watermark"),
        (
            (F.min(F.when(is_frozen(), F.col("rows_visible"))) == frozen_rows)
            & (F.min_by(F.when(is_clear(), F.col("rows_visible")),
                        F.when(is_clear(), F.col("seconds"))) != frozen_rows)
        ).alias("boundary_holds"),
    )


def poll_gaps(samples: DataFrame, by: list[str], at: str = "seconds") -> DataFrame:
    """Seconds between polls, rounded to one place, and their upper median.

    The median is found by counting equal gaps, not by listing them.
    """
    order = Window.partitionBy(*by).orderBy(at)
    gaps = samples.select(*by, F.round(F.col(at) - F.lag(at).over(order), 1).alias("gap"))
    counted = gaps.where(F.col("gap").isNotNull()).groupBy(*by, "gap").agg(
        F.count(F.lit(1)).alias("n")
    )
    upto = Window.partitionBy(*by).orderBy("gap")
    all_of = Window.partitionBy(*by)
    placed = counted.withColumn("below", F.sum("n").over(upto)).withColumn(
        "total", F.sum("n").over(all_of)
    )
    middle = F.floor(F.col("total") / 2)
    return placed.groupBy(*by).agg(
        F.max("total").alias("gaps"),
        F.min(F.when(F.col("below") > middle, F.col("gap"))).alias("typical_gap"),
    )


def settled_at(
    samples: DataFrame,
    by: list[str],
    quiet_polls: int,
    poll_seconds: float,
    commit_interval_seconds: float,
    at: str = "seconds",
    rows: str = "rows_visible",
) -> DataFrame:
    """Per run the first sample that ends a stretch of `quiet_polls` repeats of one row count.

    Any change of the count, and a NULL, begins a new stretch. The stretch has to span more
    than one commit interval, or a count between two commits would pass for a final one.
    """
    if quiet_polls * poll_seconds <= commit_interval_seconds:
        raise Refused(
            f"{quiet_polls} polls span {quiet_polls * poll_seconds:g}s, not more than one commit "
            f"interval of {commit_interval_seconds:g}s"
        )
    order = Window.partitionBy(*by).orderBy(at)
    moved = (
        F.col(rows).isNull() | F.lag(rows).over(order).isNull()
        | (F.col(rows) != F.lag(rows).over(order))
    )
    stretches = samples.withColumn("__moved", moved.cast("int")).withColumn(
        "__stretch", F.sum("__moved").over(order)
    )
    inside = Window.partitionBy(*by, "__stretch").orderBy(at)
    repeats = stretches.withColumn("__repeats", F.row_number().over(inside) - 1)
    quiet = (F.col("__repeats") >= quiet_polls) & F.col(rows).isNotNull()
    return repeats.groupBy(*by).agg(
        F.min(F.when(quiet, F.col(at))).alias("settled_at"),
        F.min_by(F.when(quiet, F.col(rows)), F.when(quiet, F.col(at))).alias("settled_rows"),
        F.max(rows).alias("last_rows"),
    )


# Blocks of time for each task that walks them, and blocks a step of the running value covers.
BLOCKS_A_TASK, BLOCKS_A_STEP = 4, 64


def as_of(
    samples: DataFrame, facts: DataFrame, at: str, fact_at: str, payload: list[str], blocks: int | None = None,
) -> DataFrame:
    """Each sample with the newest fact at or before it (J8); no join of rows, no pairs.

    A segmented scan: samples and facts are cut together, in the order of time, into blocks of
    about as many rows, wherever in time the rows crowd. Each block's last fact is carried over
    the blocks after it, in steps of some blocks and then over the steps, and inside a block
    the last fact so far wins over what was carried in. A sample without a time, or before the
    first fact, has none; of facts at the same moment one wins, the same in every run.
    """
    spark = samples.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = samples.columns

    def micros(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    known = facts.select(micros(fact_at).alias("us"), F.struct(*payload).alias("fact")).where(F.col("us").isNotNull())
    asked = samples.select(micros(at).alias("us"), F.struct(*names).alias("sample"))
    walk = ["us", "rank", "tie"]
    both = known.select("us", F.lit(0).alias("rank"), "fact", F.xxhash64(F.to_json("fact")).alias("tie")).unionByName(
        asked.select("us", F.lit(1).alias("rank"), "sample", F.xxhash64(F.monotonically_increasing_id()).alias("tie")),
        allowMissingColumns=True)
    dealt = both.repartitionByRange(blocks or BLOCKS_A_TASK * tasks, *walk).withColumn("block", F.spark_partition_id())
    # the blocks are read twice: written, they are the same both times
    path = new_dir(spark, "as-of")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)

    last = dealt.where(F.col("fact").isNotNull()).groupBy("block").agg(F.max_by("fact", F.struct(*walk)).alias("last"))
    blocks_there = dealt.select("block").distinct().join(last, "block", "left").withColumn(
        "step", F.call_function("div", F.col("block"), F.lit(BLOCKS_A_STEP)))
    in_step = Window.partitionBy("step").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a few rows: one for every 64 blocks
    over_steps = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = blocks_there.groupBy("step").agg(
        F.max_by("last", F.when(F.col("last").isNotNull(), F.col("block"))).alias("of_step")
    ).select("step", F.last("of_step", ignorenulls=True).over(over_steps).alias("earlier"))
    carried = blocks_there.withColumn("near", F.last("last", ignorenulls=True).over(in_step)).join(steps, "step").select(
        "block", F.coalesce("near", "earlier").alias("carried"))

    # blocks in ranges of about as many rows, so that each task walks as much as the others
    placed = dealt.join(carried, "block").repartitionByRange(tasks, "block")
    inside = Window.partitionBy("block").orderBy(*walk).rowsBetween(Window.unboundedPreceding, 0)
    newest = F.coalesce(F.last("fact", ignorenulls=True).over(inside), F.col("carried"))
    walked = placed.withColumn("found", F.when(F.col("us").isNotNull(), newest))
    return walked.where(F.col("rank") == 1).select("sample.*", *[F.col(f"found.{c}").alias(c) for c in payload])
