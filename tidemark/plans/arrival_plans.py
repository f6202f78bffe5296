"""Feeds that keep arriving: commits on a clock, landing that survives a kill."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.plans.registry import Registry
from tidemark.plans.tables import highest, read
from tidemark.session import SCAN_BYTES
from tidemark.streaming.arrivals import Arrivals
from tidemark.streaming.clock import ClockedRun, feed_on_clock
from tidemark.streaming.faults import FaultOnce
from tidemark.streaming.landing import BATCH, LINEAGE, PartitionLanding
from tidemark.streaming.progress import freshness, progress_rows, run_metrics
from tidemark.workspace import Files, new_dir

REGISTRY = Registry()

# Chunks a clocked feed arrives in, the first before the clock starts, and chunks of the long interval.
CHUNKS, LONG = 7, 3
SHORT_SECONDS = 2.0
# Chunks of a feed that is killed, and the batch it is killed in.
KILLED_CHUNKS, KILLED_BATCH = 4, 2


def arriving(spark: SparkSession, sf_dir: str, root: str, chunks: int) -> Arrivals:
    """The events in chunks of consecutive sequence numbers, in as many files as a task should read each."""
    events = read(spark, sf_dir, "events")
    size = Files(spark).total_bytes(f"{sf_dir}/events.parquet")
    hi = highest(events, "event_id")
    chunk = F.call_function("div", F.col("event_id") * chunks, F.lit(hi + 1))
    return Arrivals(events, root, chunk, max(2, -(-size // (SCAN_BYTES * chunks))))


CHUNK_SQL = "event_id * {n} // (SELECT max(event_id) + 1 FROM events)"

CLOCK_SQL = f"""WITH dealt AS (SELECT event_id, {CHUNK_SQL.format(n=CHUNKS)} AS chunk FROM events),
committed AS (
  SELECT 'short' AS run, chunk AS commit, event_id, chunk, 1 AS place FROM dealt
  UNION ALL SELECT 'long', (chunk + {LONG - 1}) // {LONG}, event_id, chunk, 2 FROM dealt)
SELECT run, CAST(commit AS INTEGER) AS commit, count(*) AS rows, min(event_id) AS first_seq, max(event_id) AS last_seq,
       count(DISTINCT chunk) AS chunks, 2 AS files, place AS place_by_wait, true AS measured FROM committed GROUP BY ALL"""


@REGISTRY.add("commits_on_a_clock", CLOCK_SQL)
def commits_on_a_clock(spark, sf_dir):
    """One arriving feed, committed every short and every long interval.

    The interval alone sets what a commit holds, how many files there are and how long a row
    waits to be seen. A machine too slow for the clock gets a slower one.
    """
    size = Files(spark).total_bytes(f"{sf_dir}/events.parquet")
    short = SHORT_SECONDS * max(1, -(-size // (SCAN_BYTES * CHUNKS)))
    for slower in (1, 2, 4):
        root = new_dir(spark, "clock")
        arrivals = arriving(spark, sf_dir, root, CHUNKS)
        runs = [
            ClockedRun(name, short * slower * share, PartitionLanding(spark, f"{root}/{name}", arrivals.schema, writers=2), f"{root}/checkpoint-{name}")
            for name, share in (("short", 1), ("long", LONG))
        ]
        feed_on_clock(runs, arrivals, CHUNKS)
        progress = progress_rows(spark, [r.progress for r in runs])
        commits = {r["run"]: r["commits"] for r in run_metrics(progress).collect()}
        if commits == {"short": CHUNKS, "long": 1 + -(-(CHUNKS - 1) // LONG)}:
            break
    else:
        raise Refused(f"commits do not follow the clock: {commits}")
    return _commits(spark, runs, arrivals, progress)


def _commits(spark: SparkSession, runs: list[ClockedRun], arrivals: Arrivals, progress: DataFrame) -> DataFrame:
    landed = None
    for run in runs:
        rows = run.landing.rows().select(
            F.lit(run.name).alias("run"), F.col(BATCH).alias("batch_id"), "chunk", "event_id", F.col("_metadata.file_path").alias("file"))
        landed = rows if landed is None else landed.union(rows)
    waits = freshness(progress, landed, arrivals.times())
    # chunks that were there before the clock started say nothing of it; one row per run is ranked
    mean = waits.where("chunk > 0").groupBy("run").agg(F.avg("waited_seconds").alias("waited"))
    place = mean.withColumn("place_by_wait", F.row_number().over(Window.orderBy("waited"))).join(run_metrics(progress), "run").select(
        "run", "place_by_wait", ((F.col("events_per_second") > 0) & (F.col("busy_seconds") <= F.col("feed_seconds"))).alias("measured"))
    held = landed.groupBy("run", "batch_id", "chunk", "file").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_seq"), F.max("event_id").alias("last_seq"))
    commits = held.groupBy("run", "batch_id").agg(
        F.sum("rows").alias("rows"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        F.countDistinct("chunk").alias("chunks"), F.countDistinct("file").cast("int").alias("files"))
    return commits.join(place, "run").select(
        "run", F.col("batch_id").cast("int").alias("commit"), "rows", "first_seq", "last_seq", "chunks", "files",
        "place_by_wait", "measured")


def run_to_end(arrivals: Arrivals, sink, checkpoint: str, chunks, options: dict[str, str] | None = None, shape=None):
    """Chunks arrive one after the other, each committed as one batch; returns the stopped query.

    `shape` turns the stream into what is written, as it is by default.
    """
    source = arrivals.stream()
    writer = (source if shape is None else shape(source)).writeStream.option("checkpointLocation", checkpoint)
    query = writer.options(**(options or {})).foreachBatch(sink).start()
    try:
        query.processAllAvailable()
        for chunk in chunks:
            if chunk not in arrivals.at:
                arrivals.arrive(chunk)
            query.processAllAvailable()
    finally:
        query.stop()
    return query


def killed_and_restarted(arrivals: Arrivals, landing: PartitionLanding, checkpoint: str, point: str, chunks: int, batch: int) -> None:
    """A landing killed once at a point of a batch, then started again on its checkpoint."""
    landing.fault = FaultOnce(point, batch)
    try:
        run_to_end(arrivals, landing, checkpoint, range(chunks))
    except PySparkException:
        if landing.fault.fired_at is None:
            raise
    if landing.fault.fired_at is None:
        raise Refused("the job was never interrupted")
    landing.fault = None
    run_to_end(arrivals, landing, checkpoint, range(chunks))


@REGISTRY.add(
    "landing_exactly_once",
    f"""WITH dealt AS (SELECT event_id, value, {CHUNK_SQL.format(n=KILLED_CHUNKS)} AS chunk FROM events)
   SELECT killed, chunk AS batch, count(*) AS rows, count(DISTINCT event_id) AS distinct_seq, min(event_id) AS first_seq,
     max(event_id) AS last_seq, round(sum(value), 2) AS total, CASE chunk WHEN {KILLED_BATCH} THEN 2 ELSE 1 END AS attempts
   FROM dealt, (VALUES ('before the write'), ('after the write')) AS k(killed) GROUP BY killed, chunk""",
)
def landing_exactly_once(spark, sf_dir):
    """A landing killed before and after its write: the batch that comes back overwrites its own partition."""
    whole = None
    for killed, point in (("before the write", "staged"), ("after the write", "committed")):
        root = new_dir(spark, "landing")
        arrivals = arriving(spark, sf_dir, root, KILLED_CHUNKS)
        landing = PartitionLanding(spark, f"{root}/table", arrivals.schema)
        killed_and_restarted(arrivals, landing, f"{root}/checkpoint", point, KILLED_CHUNKS, KILLED_BATCH)
        tried = spark.createDataFrame(landing.attempts, f"{LINEAGE} string, {BATCH} long").groupBy(LINEAGE, BATCH).agg(
            F.count(F.lit(1)).cast("int").alias("attempts"))
        held = landing.rows().groupBy(LINEAGE, BATCH).agg(
            F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("distinct_seq"), F.min("event_id").alias("first_seq"),
            F.max("event_id").alias("last_seq"), F.round(F.sum("value"), 2).alias("total"))
        rows = held.join(tried, [LINEAGE, BATCH], "left").withColumn("killed", F.lit(killed))
        whole = rows if whole is None else whole.union(rows)
    return whole.select("killed", F.col(BATCH).alias("batch"), "rows", "distinct_seq", "first_seq", "last_seq", "total", "attempts")


@REGISTRY.add("landing_lineages", """SELECT lineage, count(*) AS rows, count(DISTINCT event_id) AS distinct_seq
  FROM events, (VALUES (1), (2)) AS l(lineage) GROUP BY 1""")
def landing_lineages(spark, sf_dir):
    """A fresh checkpoint is another query: it lands everything once more, beside and not over the first."""
    root = new_dir(spark, "lineages")
    arrivals = arriving(spark, sf_dir, root, 2)
    landing = PartitionLanding(spark, f"{root}/table", arrivals.schema)
    for fresh in ("one", "two"):
        run_to_end(arrivals, landing, f"{root}/checkpoint-{fresh}", range(2))
    order = {query: i + 1 for i, query in enumerate(dict.fromkeys(q for q, _ in landing.attempts))}
    named = spark.createDataFrame(list(order.items()), f"{LINEAGE} string, lineage int")
    return landing.rows().groupBy(LINEAGE).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("distinct_seq")
    ).join(named, LINEAGE).select("lineage", "rows", "distinct_seq")


TARGET_BYTES, WIDE = 1 << 16, 20


@REGISTRY.add(
    "target_file_bytes",
    """SELECT width, count(*) AS rows, count(DISTINCT event_id) AS distinct_seq, CAST(sum(length(props)) AS BIGINT) AS props_chars,
   true AS files_near_target FROM (SELECT 'narrow' AS width, event_id, props FROM events
     UNION ALL SELECT 'wide', event_id, props || repeat(sha256(CAST(event_id AS VARCHAR)), 20) FROM events) GROUP BY width""",
)
def target_file_bytes(spark, sf_dir):
    """Files of a target in bytes, whatever a row weighs (S12): none above twice the target, and none below half of it
    unless it is all its batch had."""
    whole = None
    for width in ("narrow", "wide"):
        root, events = new_dir(spark, width), read(spark, sf_dir, "events")
        if width == "wide":
            padding = F.expr(f"repeat(sha2(cast(event_id AS string), 256), {WIDE})")
            events = events.withColumn("props", F.concat("props", padding))
        hi = highest(events, "event_id")
        arrivals = Arrivals(events, root, F.call_function("div", F.col("event_id") * 2, F.lit(hi + 1)), 2)
        # a target for the given data and not far below what they are
        target = max(TARGET_BYTES, Files(spark).total_bytes(f"{root}/staged") // 64)
        landing = PartitionLanding(spark, f"{root}/table", arrivals.schema, bytes_per_file=target)
        run_to_end(arrivals, landing, f"{root}/checkpoint", range(2))
        of_batch = Window.partitionBy(LINEAGE, BATCH)
        size = landing.files().withColumn("files", F.count(F.lit(1)).over(of_batch))
        near = (F.col("file_size") <= 2 * target) & ((F.col("file_size") >= target / 2) | (F.col("files") == 1))
        row = landing.read().agg(
            F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("distinct_seq"), F.sum(F.length("props")).alias("props_chars")
        ).withColumn("width", F.lit(width)).withColumn("files_near_target", F.lit(size.agg(F.bool_and(near)).first()[0]))
        whole = row if whole is None else whole.union(row)
    return whole.select("width", "rows", "distinct_seq", "props_chars", "files_near_target")
