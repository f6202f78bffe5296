"""What a restart replays, depending on which restart it is."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.operators import audit, samples
from tidemark.plans.ingest_plans import BATCHES, chunks_for, produce_log, table_stream
from tidemark.plans.registry import Registry
from tidemark.plans.tables import highest, read
from tidemark.sources.log import end_offsets, land, read_log
from tidemark.sources.offsets import OffsetStore
from tidemark.streaming.faults import FaultOnce
from tidemark.streaming.ingest import IngestSpec, drain, stream_files, stream_log
from tidemark.streaming.ledger import LedgerTable
from tidemark.streaming.sampler import ProgressLog, Sampler, read_samples
from tidemark.streaming.savepoint import save
from tidemark.streaming.sink import read_upsert
from tidemark.workspace import new_dir

REGISTRY = Registry()


def fail_and_restart(spec_for, fault: FaultOnce):
    """Run a job until the fault stops it, then run it again on its checkpoint.

    Refuses when the fault never fired: such a run would look like a restart
    that went well.
    """
    try:
        drain(spec_for(fault))
    except PySparkException:
        if fault.fired_at is None:
            raise
    if fault.fired_at is None:
        raise Refused("the job was never interrupted")
    return drain(spec_for(None))


def _restart(spark: SparkSession, sf_dir: str, point: str, delivery: str, key: str | None = None):
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "restart")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    source = table_stream(spark, sf_dir, "events", f"{root}/landing")

    def spec(fault):
        return IngestSpec(
            f"restart-{point}", source, table, f"{root}/checkpoint", seq="event_id",
            delivery=delivery, key=key, upsert=key is not None, fault=fault,
        )

    sink = fail_and_restart(spec, FaultOnce(point, BATCHES // 2))
    return table, sink.outcomes[0][1], highest(events, "event_id")


RESTART_SQL = """SELECT '{outcome}' AS replayed_batch, count(*) AS rows, count(*) AS distinct_seq,
  CAST(0 AS BIGINT) AS duplicate_seq_rows, CAST(0 AS BIGINT) AS missing_runs, CAST(0 AS BIGINT) AS missing_seqs,
  count(*) AS events_expected, true AS complete FROM events"""


def _restart_row(table: LedgerTable, outcome: str, hi: int, seq: str = "event_id") -> DataFrame:
    verdict = audit.append_verdict(table.read(), 0, hi, seq)
    return verdict.withColumn("replayed_batch", F.lit(outcome))


@REGISTRY.add("restart_exactly_once", RESTART_SQL.format(outcome="suppressed"))
def restart_exactly_once(spark, sf_dir):
    """Killed after the table commit, before the job's own: the replay is suppressed."""
    return _restart_row(*_restart(spark, sf_dir, "committed", "exactly_once"))


@REGISTRY.add("restart_before_commit", RESTART_SQL.format(outcome="committed"))
def restart_before_commit(spark, sf_dir):
    """Killed after writing, before committing: the files left behind stay unseen."""
    return _restart_row(*_restart(spark, sf_dir, "staged", "exactly_once"))


@REGISTRY.add(
    "restart_unguarded",
    "SELECT true AS batch_landed_twice, true AS whole_batches_only, count(*) AS distinct_seq, "
    "CAST(0 AS BIGINT) AS missing_runs, false AS complete FROM events",
)
def restart_unguarded(spark, sf_dir):
    """The same kill without a guard lands one batch twice."""
    table, _, hi = _restart(spark, sf_dir, "committed", "at_least_once")
    twice = table.entries().where(F.col("kind") == "batch").groupBy("lineage", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows")
    ).agg(F.sum(F.when(F.col("n") > 1, F.col("rows"))).alias("r")).first()["r"]
    return audit.append_verdict(table.read(), 0, hi, "event_id").select(
        (F.col("duplicate_seq_rows") > 0).alias("batch_landed_twice"),
        (F.col("duplicate_seq_rows") == F.lit(twice)).alias("whole_batches_only"),
        "distinct_seq", "missing_runs", "complete",
    )


@REGISTRY.add(
    "restart_upsert",
    """SELECT count(DISTINCT user_id) AS rows, count(DISTINCT user_id) AS keys_expected,
       count(DISTINCT user_id) AS keys_held, CAST(0 AS BIGINT) AS keys_not_latest,
       CAST(0 AS BIGINT) AS keys_missing, CAST(0 AS BIGINT) AS duplicate_key_rows, true AS complete
       FROM events""",
)
def restart_upsert(spark, sf_dir):
    """A keyed table survives even the unguarded replay: idempotent by key."""
    table, _, _ = _restart(spark, sf_dir, "committed", "at_least_once", key="user_id")
    expected = audit.expected_state(read(spark, sf_dir, "events"), "user_id", "event_id")
    return audit.upsert_verdict(read_upsert(table, "user_id", "event_id"), expected, "user_id", "event_id")


# -- committed offsets against the checkpoint ------------------------------------

GROUP, TOPIC = "readers", "feed"


def _offset_jobs(spark: SparkSession, sf_dir: str):
    """Land a log, ingest it, rewind the committed offsets behind the job's back."""
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "offsets")
    files = produce_log(events, sf_dir, f"{root}/log")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    store = OffsetStore(spark, f"{root}/offsets")

    def job(name, startup, checkpoint):
        """A run of the job; it commits its position when it is done reading."""
        start = store.as_map(GROUP, TOPIC) if startup == "group-offsets" else None
        source = stream_log(
            spark, f"{root}/log", events.schema, startup, start,
            files_per_trigger=-(-files // BATCHES),
        )
        drain(IngestSpec(name, source, table, f"{root}/{checkpoint}", seq="event_id"))
        reached = end_offsets(read_log(spark, f"{root}/log"))
        store.commit(GROUP, TOPIC, reached.withColumnRenamed("end_offset", "offset"))

    def step(label):
        offsets = store.group_offsets(GROUP).agg(F.sum("offset").alias("committed_offsets"))
        counts = audit.seq_counts(table.read(), "event_id").select("rows", "duplicate_seq_rows")
        row = {**offsets.first().asDict(), **counts.first().asDict(), "step": label}
        return tuple(row[c] for c in ("step", "committed_offsets", "rows", "duplicate_seq_rows"))

    def rewind():
        store.reset(GROUP, TOPIC, read_log(spark, f"{root}/log"), "earliest")

    return job, step, rewind


STEP_SCHEMA = "step string, committed_offsets long, rows long, duplicate_seq_rows long"


@REGISTRY.add(
    "offsets_ignored_on_restore",
    """SELECT 'first job' AS step, count(*) AS committed_offsets, count(*) AS rows, CAST(0 AS BIGINT) AS duplicate_seq_rows FROM events
   UNION ALL SELECT 'rewound', 0, count(*), 0 FROM events
   UNION ALL SELECT 'restored from the checkpoint', count(*), count(*), 0 FROM events""",
)
def offsets_ignored_on_restore(spark, sf_dir):
    """A job with a checkpoint does not look at committed offsets."""
    job, step, rewind = _offset_jobs(spark, sf_dir)
    job("first", "earliest-offset", "checkpoint")
    steps = [step("first job")]
    rewind()
    steps.append(step("rewound"))
    job("restored", "group-offsets", "checkpoint")
    steps.append(step("restored from the checkpoint"))
    return spark.createDataFrame(steps, STEP_SCHEMA)


@REGISTRY.add(
    "offsets_trusted_replay",
    """SELECT 'rewound again' AS step, CAST(0 AS BIGINT) AS committed_offsets, count(*) AS rows, CAST(0 AS BIGINT) AS duplicate_seq_rows FROM events
   UNION ALL SELECT 'fresh job from group-offsets', count(*), 2 * count(*), count(*) FROM events""",
)
def offsets_trusted_replay(spark, sf_dir):
    """A fresh job believes the rewound offsets and reads everything again."""
    job, step, rewind = _offset_jobs(spark, sf_dir)
    job("first", "earliest-offset", "checkpoint")
    rewind()
    steps = [step("rewound again")]
    job("trusting", "group-offsets", "fresh-checkpoint")
    steps.append(step("fresh job from group-offsets"))
    return spark.createDataFrame(steps, STEP_SCHEMA)


# -- a checkpoint older than the table ---------------------------------------------

# The feed in four stages by shares of its numbers, in thirtieths: before the
# savepoint, after it, while the job is down, after the restored job has caught up.
STAGE_ENDS = [5, 19, 24, 31]
STAGE_SQL = """stages AS (SELECT *, CASE WHEN p < 5 THEN 1 WHEN p < 19 THEN 2 WHEN p < 24 THEN 3 ELSE 4 END AS stage
  FROM (SELECT *, event_id * 30 // ((SELECT max(event_id) FROM events) + 1) AS p FROM events))"""


def stale_restore(spark: SparkSession, sf_dir: str, policy: str, sample: bool = False):
    """Save early, run on, stop, land more, restore the old copy (I8).

    The restored job reads in larger batches than the first one, so its batch
    ids stay below the table's watermark for a while.
    """
    events, root = read(spark, sf_dir, "events"), new_dir(spark, f"stale-{policy}")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    landing, live, copy = f"{root}/landing", f"{root}/checkpoint", f"{root}/savepoint"
    wide = chunks_for(spark, sf_dir, 4)
    numbers = highest(events, "event_id") + 1

    def land_stage(n: int) -> None:
        low, high = ([0] + STAGE_ENDS)[n - 1 : n + 1]
        # the least numbers whose thirtieth is `low` and `high`
        inside = (F.col("event_id") >= -(-low * numbers // 30)) & (F.col("event_id") < -(-high * numbers // 30))
        land(events.where(inside), landing, wide, exact=True)

    def run(checkpoint, files, after=None):
        source = stream_files(spark, landing, events.schema, files)
        return drain(IngestSpec(
            f"stale-{policy}", source, table, checkpoint, seq="event_id",
            policy=policy, after_batch=after,
        ))

    def log_end():
        return spark.read.schema(events.schema).parquet(landing).count()

    land_stage(1)
    first = run(live, wide)              # batch 0
    save(spark, live, copy)
    land_stage(2)
    run(live, wide // 4)                 # batches 1 to 4
    land_stage(3)
    sampler, progress = None, None
    if sample:
        progress = ProgressLog()
        spark.streams.addListener(progress)
        sampler = Sampler(table, f"{root}/samples", "restored", log_end, first.rows_read, progress=progress)
    sink = run(copy, wide // 2, sampler)     # ids 1 to 4 again, larger batches
    land_stage(4)
    sink2 = run(copy, wide // 2, sampler)    # ids 5 and 6
    if progress is not None:
        spark.streams.removeListener(progress)
    return table, sink.outcomes + sink2.outcomes, f"{root}/samples"


STALE_SQL = """WITH {stages}, n AS (SELECT count(*) AS total, count(*) FILTER (stage = 2) AS twice,
   count(*) FILTER (stage = 3) AS down FROM stages)
SELECT {outcomes} AS outcomes, {rows} AS rows, {distinct} AS distinct_seq,
  {rows} - {distinct} AS duplicate_seq_rows, total - {distinct} AS rows_lost FROM n"""


def _stale_row(spark, sf_dir, policy) -> DataFrame:
    table, outcomes, _ = stale_restore(spark, sf_dir, policy)
    total = read(spark, sf_dir, "events").count()
    told = ",".join(f"{batch}:{what}" for batch, what in outcomes)
    return audit.seq_counts(table.read(), "event_id").select(
        F.lit(told).alias("outcomes"), "rows", "distinct_seq", "duplicate_seq_rows",
        audit.rows_lost(F.lit(total), F.col("distinct_seq"), clamp=False).alias("rows_lost"),
    )


FROZEN = "'1:held,2:held,3:held,4:held,5:committed,6:committed'"


@REGISTRY.add(
    "stale_restore_hold",
    STALE_SQL.format(stages=STAGE_SQL, outcomes=FROZEN, rows="(total + twice)", distinct="total"),
)
def stale_restore_hold(spark, sf_dir):
    """Held until an id clears the watermark, then one lump: nothing lost, much twice."""
    return _stale_row(spark, sf_dir, "hold")


@REGISTRY.add(
    "stale_restore_dedupe",
    STALE_SQL.format(stages=STAGE_SQL, outcomes=FROZEN, rows="total", distinct="total"),
)
def stale_restore_dedupe(spark, sf_dir):
    """Held likewise, then committed without the numbers the table has."""
    return _stale_row(spark, sf_dir, "dedupe")


@REGISTRY.add(
    "stale_restore_skip",
    STALE_SQL.format(
        stages=STAGE_SQL, outcomes=FROZEN.replace("held", "skipped"), rows="(total - down)",
        distinct="(total - down)",
    ),
)
def stale_restore_skip(spark, sf_dir):
    """Dropping batches at or below the watermark is the one policy that loses rows."""
    return _stale_row(spark, sf_dir, "skip")


@REGISTRY.add(
    "stale_restore_freeze",
    f"""WITH {STAGE_SQL} SELECT 4 AS frozen_samples, 4 AS ids_below_watermark, 5 AS first_id_above,
   true AS never_moved, 'RUNNING' AS job_states, CAST(0 AS BIGINT) AS min_consumer_lag_while_frozen,
   count(*) FILTER (stage <= 2) AS rows_while_frozen,
   true AS moved_at_first_id_above, true AS lump_holds_replay_and_backlog FROM stages""",
)
def stale_restore_freeze(spark, sf_dir):
    """The restored job's own samples: healthy, reading, and frozen."""
    _, _, path = stale_restore(spark, sf_dir, "hold", sample=True)
    seen = read_samples(spark, path)
    numbers = highest(read(spark, sf_dir, "events"), "event_id") + 1
    third = F.call_function("div", F.col("event_id") * 30, F.lit(numbers))
    backlog = read(spark, sf_dir, "events").where(third.between(STAGE_ENDS[0], STAGE_ENDS[2] - 1)).count()
    window = samples.freeze_window(seen)
    bounds = samples.freeze_bounds(seen).select("ids_below_watermark", "first_id_above", "boundary_holds")
    b = bounds.first()
    return window.select(
        F.col("frozen_samples").cast("int").alias("frozen_samples"),
        F.lit(b["ids_below_watermark"]).cast("int").alias("ids_below_watermark"),
        F.lit(b["first_id_above"]).cast("int").alias("first_id_above"),
        "never_moved", F.array_join("job_states_while_frozen", ",").alias("job_states"),
        "min_consumer_lag_while_frozen", F.col("rows_while_frozen")[0].alias("rows_while_frozen"),
        F.lit(b["boundary_holds"]).alias("moved_at_first_id_above"),
        (F.col("rows_in_one_lump") >= backlog).alias("lump_holds_replay_and_backlog"),
    )
