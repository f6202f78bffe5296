"""Keyed state, checkpoints read back, late rows."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.arrival_plans import CHUNK_SQL, KILLED_BATCH, KILLED_CHUNKS, arriving, run_to_end
from tidemark.plans.ingest_plans import LATEST_SQL
from tidemark.plans.registry import Registry
from tidemark.plans.tables import highest, read
from tidemark.streaming import checkpoints
from tidemark.streaming.arrivals import Arrivals
from tidemark.streaming.faults import FaultOnce
from tidemark.streaming.keyed import BUCKET, GENERATION, BucketTable, latest_in_state, rocksdb_state
from tidemark.streaming.landing import PartitionLanding
from tidemark.streaming.late import first_within
from tidemark.streaming.progress import BatchProgress, progress_rows
from tidemark.streaming.savepoint import save
from tidemark.workspace import new_dir

REGISTRY = Registry()

CHUNKS = 4
UPDATE = {"outputMode": "update"}


def arriving_late(spark: SparkSession, sf_dir: str, root: str) -> Arrivals:
    """The events in chunks of consecutive numbers, of which every fifth row comes one chunk later and every 25th two."""
    events = read(spark, sf_dir, "events")
    hi = highest(events, "event_id")
    own = F.call_function("div", F.col("event_id") * CHUNKS, F.lit(hi + 1))
    by = F.when(F.col("event_id") % 25 == 0, 2).when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    return Arrivals(events.withColumn("ts", F.col("ts").cast("timestamp")), root, F.least(own + by, F.lit(CHUNKS - 1)), 2)


LATE_CHUNK_SQL = (
    f"least({CHUNK_SQL.format(n=CHUNKS)} + CASE WHEN event_id % 25 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END, {CHUNKS - 1})")


def keyed_run(arrivals: Arrivals, table: BucketTable, checkpoint: str, chunks) -> None:
    """Chunks through the state store into buckets, one batch each."""
    with rocksdb_state(arrivals.spark):
        query = (
            latest_in_state(arrivals.stream(), "user_id", "event_id").writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint).foreachBatch(table).start())
    try:
        query.processAllAvailable()
        for chunk in chunks:
            if chunk not in arrivals.at:
                arrivals.arrive(chunk)
            query.processAllAvailable()
    finally:
        query.stop()


@REGISTRY.add("keyed_state_upsert", LATEST_SQL)
def keyed_state_upsert(spark, sf_dir):
    """The latest row of each key from late batches, killed after the buckets of one were written."""
    root = new_dir(spark, "keyed")
    arrivals = arriving_late(spark, sf_dir, root)
    table = BucketTable(spark, f"{root}/table", arrivals.schema, "user_id", "event_id", fault=FaultOnce("committed", KILLED_BATCH))
    try:
        keyed_run(arrivals, table, f"{root}/checkpoint", range(CHUNKS))
    except PySparkException:
        if table.fault.fired_at is None:
            raise
    table.fault = None
    keyed_run(arrivals, table, f"{root}/checkpoint", range(CHUNKS))
    return table.read().drop("chunk").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


BUCKETS = 64
CHANGED = 100


@REGISTRY.add(
    "keyed_state_touched",
    f"""SELECT user_id % {BUCKETS} AS bucket, count(DISTINCT user_id) AS keys,
   max(CASE WHEN user_id % {CHANGED} = 0 THEN 1 ELSE 0 END) AS rewritten_by,
   CAST(sum(user_id) FILTER (first_of_key) AS BIGINT) AS key_sum,
   CAST(sum(CASE WHEN user_id % {CHANGED} = 0 THEN -1 ELSE latest END) FILTER (first_of_key) AS BIGINT) AS latest_sum
   FROM (SELECT user_id, max(event_id) OVER (PARTITION BY user_id) AS latest,
                row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS first_of_key FROM events) GROUP BY 1""",
)
def keyed_state_touched(spark, sf_dir):
    """A batch of one key in a hundred rewrites the buckets of those keys and leaves all others as they were."""
    root, events = new_dir(spark, "touched"), read(spark, sf_dir, "events")
    hi = highest(events, "event_id")
    changed = events.where(F.col("user_id") % CHANGED == 0).withColumns(
        {"event_id": F.col("event_id") + (hi + 1), "event_type": F.lit("corrected")})
    feed = events.unionByName(changed)
    arrivals = Arrivals(feed, root, F.when(F.col("event_id") > hi, 1).otherwise(0), 2)
    table = BucketTable(
        spark, f"{root}/table", arrivals.schema, "user_id", "event_id", BUCKETS, bucket_of=lambda key: key)
    keyed_run(arrivals, table, f"{root}/checkpoint", range(2))
    latest = F.when(F.col("event_type") == "corrected", -1).otherwise(F.col("event_id"))
    held = table.read().groupBy((F.col("user_id") % BUCKETS).alias("bucket")).agg(
        F.count(F.lit(1)).alias("keys"), F.sum("user_id").alias("key_sum"), F.sum(latest).alias("latest_sum"))
    newest = table.buckets_held().select(F.col(BUCKET).cast("long").alias("bucket"), F.col(GENERATION).cast("int").alias("rewritten_by"))
    return newest.join(held, "bucket").select("bucket", "keys", "rewritten_by", "key_sum", "latest_sum")


@REGISTRY.add(
    "state_as_of",
    f"""WITH dealt AS (SELECT event_id, user_id, {LATE_CHUNK_SQL} AS chunk FROM events)
   SELECT b.batch, count(DISTINCT user_id) AS keys, CAST(sum(event_id) FILTER (newest) AS BIGINT) AS latest_sum
   FROM range({CHUNKS}) AS b(batch) JOIN (
     SELECT r.batch, user_id, event_id, event_id = max(event_id) OVER (PARTITION BY r.batch, user_id) AS newest
     FROM dealt JOIN range({CHUNKS}) AS r(batch) ON chunk <= r.batch) USING (batch) GROUP BY 1""",
)
def state_as_of(spark, sf_dir):
    """What the state of a query held after each of its batches, read back from the checkpoint (S3)."""
    root = new_dir(spark, "state")
    arrivals = arriving_late(spark, sf_dir, root)
    table = BucketTable(spark, f"{root}/table", arrivals.schema, "user_id", "event_id")
    keyed_run(arrivals, table, f"{root}/checkpoint", range(CHUNKS))
    first, last = checkpoints.state_operators(spark, f"{root}/checkpoint").select("minBatchId", "maxBatchId").first()
    whole = None
    for batch in range(first, last + 1):
        held = checkpoints.state_rows(spark, f"{root}/checkpoint", batch).agg(
            F.count(F.lit(1)).alias("keys"), F.sum("value.max.event_id").alias("latest_sum")
        ).select(F.lit(batch).cast("long").alias("batch"), "keys", "latest_sum")
        whole = held if whole is None else whole.union(held)
    return whole


REPLAY_SQL = f"""WITH dealt AS (SELECT {CHUNK_SQL.format(n=KILLED_CHUNKS)} AS chunk FROM events)
  SELECT start, chunk, reason, count(*) AS predicted_rows, count(*) AS replayed_rows
  FROM dealt JOIN (VALUES ('after a kill', {KILLED_BATCH}, 'planned'), ('after a kill', {KILLED_CHUNKS - 1}, 'new'),
    ('from a savepoint', {KILLED_BATCH}, 'new'), ('from a savepoint', {KILLED_CHUNKS - 1}, 'new')) AS s(start, chunk, reason) USING (chunk)
  GROUP BY ALL"""


@REGISTRY.add("checkpoint_replay", REPLAY_SQL)
def checkpoint_replay(spark, sf_dir):
    """What a start on a checkpoint will read, foretold from its logs, against what it then read (S3, I4)."""
    whole = None
    for start in ("after a kill", "from a savepoint"):
        root = new_dir(spark, "replay")
        arrivals = arriving(spark, sf_dir, root, KILLED_CHUNKS)
        landing, checkpoint = PartitionLanding(spark, f"{root}/table", arrivals.schema), f"{root}/checkpoint"
        if start == "after a kill":
            landing.fault = FaultOnce("committed", KILLED_BATCH)
            try:
                run_to_end(arrivals, landing, checkpoint, range(KILLED_BATCH + 1))
            except PySparkException:
                if landing.fault.fired_at is None:
                    raise
        else:
            run_to_end(arrivals, landing, checkpoint, range(KILLED_BATCH))
            save(spark, checkpoint, f"{root}/saved")
            run_to_end(arrivals, landing, checkpoint, range(KILLED_BATCH, KILLED_CHUNKS))
            checkpoint = f"{root}/saved"
        for chunk in range(KILLED_CHUNKS):
            if chunk not in arrivals.at:
                arrivals.arrive(chunk)
        there = spark.read.schema(arrivals.schema).option("recursiveFileLookup", "true").parquet(arrivals.watched).select(
            "chunk", F.col("_metadata.file_path").alias("path")).groupBy("path", "chunk").agg(F.count(F.lit(1)).alias("rows"))
        # read before the restart changes the logs
        foretold = checkpoints.would_replay(spark, checkpoint, there).withColumn("name", checkpoints.file_name("path")).join(
            there.select(checkpoints.file_name("path").alias("name"), "chunk", "rows"), "name"
        ).groupBy("chunk", "reason").agg(F.sum("rows").alias("predicted_rows")).collect()  # one row per chunk and reason
        again = PartitionLanding(spark, f"{root}/again", arrivals.schema)
        run_to_end(arrivals, again, checkpoint, ())
        replayed = again.rows().groupBy("chunk").agg(F.count(F.lit(1)).alias("replayed_rows"))
        rows = spark.createDataFrame(foretold, "chunk int, reason string, predicted_rows long").join(
            replayed, "chunk", "full_outer").withColumn("start", F.lit(start))
        whole = rows if whole is None else whole.union(rows)
    return whole.select("start", F.col("chunk").cast("long").alias("chunk"), "reason", "predicted_rows", "replayed_rows")


LATE_SQL = f"""WITH span AS (SELECT (epoch_ms(max(ts)) - epoch_ms(min(ts))) // 8 AS delay_ms FROM events),
dealt AS (SELECT ts, event_id, {LATE_CHUNK_SQL} AS chunk FROM events),
newest AS (SELECT chunk, max(epoch_ms(ts)) AS ms FROM dealt GROUP BY 1),
marks AS (SELECT chunk, max(ms) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - delay_ms AS mark FROM newest, span),
judged AS (SELECT chunk, event_id, coalesce(epoch_us(ts) <= mark * 1000, false) AS late FROM dealt JOIN marks USING (chunk))
SELECT chunk AS batch, count(*) AS rows, count(*) FILTER (NOT late) AS kept, count(*) FILTER (late) AS dropped,
       CAST(sum(event_id) FILTER (NOT late) AS BIGINT) AS kept_seq_sum FROM judged GROUP BY 1"""


@REGISTRY.add("late_rows", LATE_SQL)
def late_rows(spark, sf_dir):
    """What a watermark keeps and drops of rows that come late, by batch, as the query itself counts it."""
    root = new_dir(spark, "late")
    arrivals = arriving_late(spark, sf_dir, root)
    span = read(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).agg(F.min("ms"), F.max("ms")).first()
    delay = (span[1] - span[0]) // 8
    landing, progress = PartitionLanding(spark, f"{root}/table", arrivals.schema), BatchProgress("late")
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        with rocksdb_state(spark):
            query = run_to_end(
                arrivals, landing, f"{root}/checkpoint", range(CHUNKS),
                shape=lambda rows: first_within(rows, "ts", f"{delay} milliseconds", ["event_id"]))
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", before)
    progress.note(query)
    counted = progress_rows(spark, [progress]).where("input_rows > 0").select(
        F.col("batch_id").alias("batch"), F.col("input_rows").alias("rows"), F.col("dropped_rows").alias("dropped"))
    kept = landing.rows().groupBy(F.col("chunk").cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("kept"), F.sum("event_id").alias("kept_seq_sum"))
    return counted.join(kept, "batch", "left").select("batch", "rows", F.coalesce("kept", F.lit(0)).alias("kept"), "dropped", "kept_seq_sum")
