"""Arriving feeds, landing, keyed buckets, checkpoints read back, late rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.plans.arrival_plans import run_to_end
from tidemark.streaming import checkpoints
from tidemark.streaming.arrivals import Arrivals
from tidemark.streaming.clock import ClockedRun, feed_on_clock
from tidemark.streaming.faults import FaultOnce, InjectedFault
from tidemark.streaming.keyed import BucketTable
from tidemark.streaming.landing import BATCH, PartitionLanding
from tidemark.streaming.late import first_within, lateness
from tidemark.streaming.progress import BatchProgress, freshness, progress_rows, run_metrics


def numbered(spark, count, chunks):
    rows = spark.range(count).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    return rows, F.call_function("div", F.col("seq") * chunks, F.lit(count))


def test_a_chunk_arrives_once_and_an_empty_one_as_nothing(spark, work):
    rows, _ = numbered(spark, 10, 2)
    arrivals = Arrivals(rows, work, F.lit(1))
    arrivals.arrive(0)
    assert arrivals.rows_arrived == 0
    arrivals.arrive(1)
    assert arrivals.rows_arrived == 10
    with pytest.raises(Refused, match="before"):
        arrivals.arrive(1)


def test_landing_refuses_what_it_cannot_mean(spark, work):
    schema = spark.range(1).schema
    with pytest.raises(Refused, match="not both"):
        PartitionLanding(spark, work, schema, writers=2, bytes_per_file=10)
    with pytest.raises(Refused, match="own"):
        PartitionLanding(spark, work, spark.range(1).withColumnRenamed("id", BATCH).schema)


def test_an_unlanded_table_is_empty(spark, work):
    landing = PartitionLanding(spark, f"{work}/none", spark.range(1).schema)
    assert landing.read().count() == 0 and landing.bytes_per_row() is None


def test_writers_set_the_files_of_a_batch(spark, work):
    rows, chunk = numbered(spark, 300, 3)
    arrivals = Arrivals(rows, work, chunk, files=4)
    landing = PartitionLanding(spark, f"{work}/table", arrivals.schema, writers=3)
    run_to_end(arrivals, landing, f"{work}/checkpoint", range(3))
    assert {(r[BATCH], r["count"]) for r in landing.files().groupBy(BATCH).count().collect()} == {(0, 3), (1, 3), (2, 3)}


def test_a_heavy_chunk_is_staged_by_more_writers(spark, work):
    # 300 MB in memory, all in the second of two chunks
    rows = spark.range(300_000).withColumn("wide", F.repeat(F.lit("x"), 1000))
    arrivals = Arrivals(rows, work, F.when(F.col("id") < 10, 0).otherwise(1))
    staged = spark.read.parquet(f"{work}/staged").groupBy("chunk", F.col("_metadata.file_path").alias("file")).count().collect()
    assert [r["chunk"] for r in staged].count(0) == 1 and [r["chunk"] for r in staged].count(1) == 3
    assert max(r["count"] for r in staged) < 1.1 * 300_000 / 3 and arrivals.counts == {0: 10, 1: 299_990}


def test_clock_refuses_intervals_that_do_not_fit(spark, work):
    rows, chunk = numbered(spark, 10, 2)
    arrivals = Arrivals(rows, work, chunk)
    runs = [ClockedRun(n, s, PartitionLanding(spark, f"{work}/{n}", arrivals.schema), f"{work}/c{n}") for n, s in (("a", 2.0), ("b", 5.0))]
    with pytest.raises(Refused, match="divide"):
        feed_on_clock(runs, arrivals, 2)


def test_freshness_and_metrics_of_given_progress(spark):
    run = BatchProgress("r")
    for batch, began, ms, rows in ((0, "2020-01-01T00:00:00.000Z", 500, 10), (1, "2020-01-01T00:00:10.000Z", 1500, 30), (2, "2020-01-01T00:00:20.000Z", 10, 0)):
        run.seen[batch] = {
            "batchId": batch, "numInputRows": rows, "timestamp": began, "durationMs": {"triggerExecution": ms}, "stateOperators": []}
    progress = progress_rows(spark, [run])
    metrics = run_metrics(progress).first()
    assert (metrics["commits"], metrics["events"], metrics["feed_seconds"], metrics["busy_seconds"]) == (2, 40, 11.5, 2.0)
    landed = spark.createDataFrame([("r", 1, 4)] * 30, "run string, batch_id long, chunk int")
    arrived = spark.createDataFrame([(4, 1577836807.25)], "chunk int, s double").select("chunk", F.timestamp_seconds("s").alias("arrived_at"))
    row = freshness(progress, landed, arrived).first()
    assert (row["rows"], row["waited_seconds"]) == (30, 4.25)


def bucket_table(spark, work, **options):
    schema = spark.createDataFrame([], "k long, seq long, what string").schema
    return BucketTable(spark, f"{work}/buckets", schema, "k", "seq", buckets=4, bucket_of=lambda k: k, **options)


def batch(spark, rows):
    return spark.createDataFrame(rows, "k long, seq long, what string")


def test_buckets_take_a_batch_again_and_keep_the_others(spark, work):
    table = bucket_table(spark, work)
    table(batch(spark, [(k, k, "first") for k in range(8)]), 0)
    table(batch(spark, [(1, 10, "second")]), 1)
    held = sorted(map(tuple, table.read().collect()))
    table(batch(spark, [(1, 10, "second")]), 1)
    assert sorted(map(tuple, table.read().collect())) == held
    assert {r["key_bucket"]: (r["generation"], r["rows"]) for r in table.buckets_held().collect()} == {0: (0, 2), 1: (1, 2), 2: (0, 2), 3: (0, 2)}
    table(batch(spark, []), 2)
    assert sorted(map(tuple, table.read().collect())) == held


@pytest.mark.parametrize("point", ["staged", "committed"])
def test_a_killed_bucket_batch_ends_the_same(spark, work, point):
    table = bucket_table(spark, work, fault=FaultOnce(point, 1))
    table(batch(spark, [(k, k, "first") for k in range(8)]), 0)
    second = batch(spark, [(2, 20, "second"), (9, 21, "new")])
    with pytest.raises(InjectedFault):
        table(second, 1)
    table(second, 1)
    table(batch(spark, [(2, 30, "third")]), 2)
    got = {r["k"]: r["what"] for r in table.read().collect()}
    assert got == {**{k: "first" for k in range(8)}, 2: "third", 9: "new"}
    # the generation before the last stays, older ones go
    assert sorted(table._listed(2)) == [1, 2]


def test_buckets_have_a_bound(spark, work):
    with pytest.raises(Refused, match="buckets"):
        BucketTable(spark, work, spark.range(1).schema, "id", "id", buckets=1 << 20)


def test_late_rows_are_those_the_query_drops(spark, work):
    rows, _ = numbered(spark, 400, 4)
    chunk = F.least(F.call_function("div", F.col("seq"), F.lit(100)) + F.when(F.col("seq") % 3 == 0, 2).otherwise(0), F.lit(3))
    arrivals = Arrivals(rows, work, chunk)
    landing, progress = PartitionLanding(spark, f"{work}/table", arrivals.schema), BatchProgress("late")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        query = run_to_end(
            arrivals, landing, f"{work}/checkpoint", range(4), shape=lambda s: first_within(s, "ts", "30 minutes", ["seq"]))
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    progress.note(query)
    judged = lateness(rows.withColumn("chunk", chunk), "chunk", "ts", 30 * 60_000)
    expected = {r["seq"] for r in judged.where(~F.col("late")).collect()}
    assert {r["seq"] for r in landing.read().collect()} == expected and len(expected) < 400
    dropped = progress_rows(spark, [progress]).agg(F.sum("dropped_rows")).first()[0]
    assert dropped == 400 - len(expected)


def test_a_checkpoint_names_the_files_of_its_batches(spark, work):
    rows, chunk = numbered(spark, 300, 3)
    arrivals = Arrivals(rows, work, chunk)
    landing = PartitionLanding(spark, f"{work}/table", arrivals.schema)
    # with a watermark, batches without files come between those with some
    run_to_end(arrivals, landing, f"{work}/checkpoint", range(3), shape=lambda s: first_within(s, "ts", "1 minute", ["seq"]))
    files = checkpoints.files_read(spark, f"{work}/checkpoint")
    assert files.count() == files.select("path").distinct().count() == 3
    assert checkpoints.planned(spark, f"{work}/checkpoint").count() == checkpoints.committed(spark, f"{work}/checkpoint").count() > 3
    there = spark.createDataFrame([(r["path"],) for r in files.collect()] + [("file:/x/chunk-9/new.parquet",)], "path string")
    assert [tuple(r) for r in checkpoints.would_replay(spark, f"{work}/checkpoint", there).collect()] == [("file:/x/chunk-9/new.parquet", "new")]


def test_a_folder_that_is_no_checkpoint_knows_nothing(spark, work):
    assert checkpoints.planned(spark, f"{work}/none").count() == 0
    assert checkpoints.files_read(spark, f"{work}/none").count() == 0
