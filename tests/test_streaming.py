"""The sinks under faults, stale restores, folding, maintenance and two-phase copies."""

from datetime import timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.operators import audit
from tidemark.plans.restart_plans import fail_and_restart
from tidemark.sources import catalog, feed, log
from tidemark.sources.listing import objects_under
from tidemark.sources.offsets import OffsetStore
from tidemark.sources.results import read_results, write_results
from tidemark.streaming import maintenance
from tidemark.streaming.faults import FaultOnce
from tidemark.streaming.ingest import IngestSpec, drain, stream_files, stream_log
from tidemark.streaming.ledger import LedgerTable, StagedBatch, wait_until
from tidemark.streaming.sampler import ProgressLog, Sampler, read_samples
from tidemark.streaming.savepoint import last_batch, lineage_of, save
from tidemark.streaming.sink import read_upsert
from tidemark.streaming.transactions import TransactionalLog

NOW = timedelta(0)


class Job:
    """A landing directory, a table and jobs that read one into the other."""

    def __init__(self, spark, work):
        self.spark, self.work = spark, work
        self.schema = feed.generate_feed(spark, 1).schema
        self.table = LedgerTable(spark, f"{work}/table", self.schema)
        self.end = 0

    def land(self, count, files=1):
        rows = feed.generate_feed(self.spark, count, start=self.end + 1, providers=50)
        for lo in range(0, count, -(-count // files)):
            part = rows.where(F.col("seq").between(self.end + lo + 1, self.end + lo + -(-count // files)))
            part.coalesce(1).write.mode("append").parquet(f"{self.work}/landing")
        self.end += count

    def spec(self, checkpoint="checkpoint", files=1, **options):
        source = stream_files(self.spark, f"{self.work}/landing", self.schema, files)
        return IngestSpec("job", source, self.table, f"{self.work}/{checkpoint}", **options)

    def run(self, **options):
        return drain(self.spec(**options), timeout=120)

    def save(self):
        save(self.spark, f"{self.work}/checkpoint", f"{self.work}/saved")

    def verdict(self):
        return audit.append_verdict(self.table.read(), 1, self.end).first()


@pytest.fixture
def job(spark, work):
    return Job(spark, work)


@pytest.mark.parametrize("point,replayed", [("committed", "suppressed"), ("staged", "committed")])
def test_a_kill_loses_and_repeats_nothing(job, point, replayed):
    job.land(100, 4)
    sink = fail_and_restart(lambda f: job.spec(fault=f), FaultOnce(point, 2))
    assert sink.outcomes == [(2, replayed), (3, "committed")]
    assert job.verdict()["complete"]


def test_without_a_guard_the_replayed_batch_lands_twice(job):
    job.land(100, 4)
    fail_and_restart(
        lambda f: job.spec(fault=f, delivery="at_least_once"), FaultOnce("committed", 2)
    )
    row = job.verdict()
    assert not row["complete"] and row["duplicate_seq_rows"] == 25 and row["missing_runs"] == 0


def test_a_restart_that_never_failed_is_refused(job):
    job.land(40, 2)
    with pytest.raises(Refused, match="never interrupted"):
        fail_and_restart(lambda f: job.spec(fault=f), FaultOnce("staged", 99))


def stale(job, policy):
    """Save after batch 0, run to batch 4, restore, then feed past the watermark."""
    job.land(100)
    job.run()
    job.save()
    job.land(400, 4)
    job.run()
    job.land(400, 4)
    return job.run(checkpoint="saved", files=2, policy=policy)


def test_hold_freezes_then_commits_one_lump(job):
    frozen = stale(job, "hold")
    assert frozen.outcomes == [(n, "held") for n in (1, 2, 3, 4)]
    assert job.table.state()["rows_visible"] == 500
    job.land(400, 4)
    after = job.run(checkpoint="saved", files=2, policy="hold")
    assert after.outcomes == [(5, "committed"), (6, "committed")]
    row = job.verdict()
    assert row["rows"] == 1700 and row["duplicate_seq_rows"] == 400 and row["missing_runs"] == 0
    lump = job.table.snapshots().where("batch_id = 5").first()["summary"]
    assert lump["added-records"] == str(800 + 200)


def test_a_crash_after_the_lump_does_not_commit_it_again(job):
    stale(job, "hold")
    job.land(400, 4)
    fail_and_restart(
        lambda f: job.spec(checkpoint="saved", files=2, policy="hold", fault=f), FaultOnce("committed", 5)
    )
    assert job.verdict()["rows"] == 1700


def test_an_abandoned_restore_leaves_nothing_behind(job):
    stale(job, "hold")
    save(job.spark, f"{job.work}/checkpoint", f"{job.work}/saved-again")
    # a second restore from the same old point, reading in other batches
    job.land(400, 4)
    job.table.release(lineage_of(job.spark, f"{job.work}/saved"))
    again = job.run(checkpoint="saved-again", files=2, policy="hold")
    assert {o for _, o in again.outcomes} == {"committed"}
    assert job.verdict()["complete"]


def test_held_batches_of_an_abandoned_run_are_replaced(job):
    table = job.table
    for batch, path in ((1, "a"), (2, "b"), (3, "c"), (2, "d")):
        table.hold(StagedBatch("l", batch, path, 1, 1, 1, path))
    assert [(b.batch_id, b.path) for b in table.held("l")] == [(1, "a"), (2, "d")]


def test_dedupe_ends_exact_even_when_the_replay_outlives_the_freeze(job):
    job.land(100)
    job.run()
    job.save()
    job.land(400, 2)
    job.run(files=1)                        # watermark 2
    job.land(100, 2)
    # one-file batches with other borders than before: ids 1.. re-read 400 rows
    job.spark.read.parquet(f"{job.work}/landing").where("seq > 100").repartition(6, "seq").write.parquet(
        f"{job.work}/relanded/part"
    )
    source = stream_files(job.spark, f"{job.work}/relanded/*", job.schema, 1)
    sink = drain(IngestSpec(
        "again", source, job.table, f"{job.work}/saved", policy="dedupe",
    ))
    assert [o for _, o in sink.outcomes] == ["held"] * 2 + ["committed"] * 4
    assert job.verdict()["complete"]


def test_skip_loses_and_reject_refuses(job):
    with pytest.raises(PySparkException, match="restored from a point older"):
        stale(job, "reject")
    assert job.table.state()["rows_visible"] == 500
    sink = job.run(checkpoint="saved", files=2, policy="skip")
    assert {o for _, o in sink.outcomes} == {"skipped"}
    assert job.verdict()["missing_seqs"] == 400


def test_the_same_batches_after_a_stale_restore_are_recognised(job):
    job.land(100)
    job.run()
    job.save()
    job.land(300, 3)
    job.run()
    sink = job.run(checkpoint="saved")
    assert {o for _, o in sink.outcomes} == {"suppressed"}
    assert job.verdict()["complete"]


def test_a_copy_keeps_the_lineage_and_a_fresh_start_does_not(job):
    job.land(50)
    job.run()
    job.save()
    mine = lineage_of(job.spark, f"{job.work}/checkpoint")
    assert lineage_of(job.spark, f"{job.work}/saved") == mine
    assert last_batch(job.spark, f"{job.work}/saved") == 0
    job.run(checkpoint="fresh")
    assert lineage_of(job.spark, f"{job.work}/fresh") != mine
    assert job.verdict()["duplicate_seq_rows"] == 50
    with pytest.raises(Refused, match="not the checkpoint"):
        save(job.spark, f"{job.work}/nowhere", f"{job.work}/x")


def test_a_savepoint_of_a_running_query_is_refused(job):
    job.land(50)
    query, _ = job.spec(interval="1 second").start()
    try:
        with pytest.raises(Refused, match="stop the query"):
            save(job.spark, f"{job.work}/checkpoint", f"{job.work}/saved", query)
        rows = wait_until(
            lambda: job.table.state()["rows_visible"] or None, 60, "no row became visible"
        )
        assert rows == 50
    finally:
        query.stop()
    with pytest.raises(Refused, match="within"):
        wait_until(lambda: None, 0.3, "nothing happened")


def test_an_upsert_needs_key_and_flag(job):
    for options in ({"upsert": True}, {"key": "npi"}):
        with pytest.raises(Refused, match="key and the flag"):
            IngestSpec("x", None, job.table, "c", **options).sink()
    with pytest.raises(Refused, match="policy"):
        IngestSpec("x", None, job.table, "c", policy="maybe").sink()


@pytest.mark.parametrize("delivery", ["exactly_once", "at_least_once"])
def test_a_keyed_table_holds_the_latest_whatever_comes_back(job, delivery):
    job.land(300, 3)
    options = dict(key="npi", upsert=True, compact_ratio=0.1, delivery=delivery)
    fail_and_restart(lambda f: job.spec(fault=f, **options), FaultOnce("committed", 1))
    expected = audit.expected_state(feed.generate_feed(job.spark, 300, providers=50), "npi", "seq")
    held = read_upsert(job.table, "npi")
    row = audit.upsert_verdict(held, expected, "npi", "seq").first()
    assert row["complete"] and row["keys_held"] == expected.count()
    # deltas were folded into a base on the way
    assert job.table.live_paths().where("path like 'data/base-%'").count() == 1


def test_a_late_correction_never_replaces_a_newer_record(job):
    rows = feed.generate_feed(job.spark, 200, providers=20)
    for lo, hi in ((101, 200), (1, 100)):
        rows.where(F.col("seq").between(lo, hi)).coalesce(1).write.mode("append").parquet(f"{job.work}/landing")
    job.run(key="npi", upsert=True)
    expected = audit.expected_state(rows, "npi", "seq")
    assert audit.upsert_verdict(read_upsert(job.table, "npi"), expected, "npi", "seq").first()["complete"]


def test_two_commits_never_share_a_number(job):
    job.land(20)
    job.run()
    table = job.table
    first = table.next_id()
    assert table.fs.publish_text(f"{table.root}/ledger/{first:020d}.json", "") is True
    assert table.fs.publish_text(f"{table.root}/ledger/{first:020d}.json", "") is False
    batch = StagedBatch("other", 7, "data/other/none", 0, None, None, "f")
    assert table.commit([batch]) == first + 1


def test_two_queries_of_one_lineage_are_refused(job):
    job.land(20)
    job.run()
    lineage = lineage_of(job.spark, f"{job.work}/checkpoint")
    sink = job.spec().sink()
    assert sink._watermark(lineage) == 0
    # somebody else commits batch 1 between the look and the publication
    job.table.commit([StagedBatch(lineage, 1, "data/x", 0, None, None, "f")])
    with pytest.raises(Refused, match="two queries"):
        sink._publish([StagedBatch(lineage, 1, "data/y", 5, 1, 5, "g")], 1, lineage, guarded=True)


def test_a_commit_between_check_and_publication_takes_the_number(job):
    job.land(20)
    job.run()
    lineage = lineage_of(job.spark, f"{job.work}/checkpoint")
    first, second = job.spec().sink(), job.spec().sink()
    publish, asked = job.table.fs.publish_text, []

    def late(path, text):
        if not asked:  # the other sink is checked and published in between
            asked.append(path)
            second._publish([StagedBatch(lineage, 1, "data/x", 5, 1, 5, "f")], 1, lineage, guarded=True)
        return publish(path, text)

    job.table.fs.publish_text = late
    try:
        with pytest.raises(Refused, match="two queries"):
            first._publish([StagedBatch(lineage, 1, "data/y", 5, 1, 5, "f")], 1, lineage, guarded=True)
    finally:
        del job.table.fs.publish_text
    assert job.table.live_paths().where("path = 'data/y'").isEmpty()


def test_two_sinks_on_one_lineage_land_a_batch_once(job):
    """A driver thought dead and its successor: the second finds the batch committed."""
    def batch(lo, hi):
        return feed.generate_feed(job.spark, hi).where(F.col("seq").between(lo, hi))

    job.land(1)
    dead, successor = job.spec().sink(), job.spec().sink()
    assert dead._take(batch(1, 100), 0, "one")[0] == "committed"
    assert successor._take(batch(1, 100), 0, "one")[0] == "suppressed"
    assert dead._take(batch(101, 200), 1, "one")[0] == "committed"
    assert successor._take(batch(101, 200), 1, "one")[0] == "suppressed"
    rows = job.table.read()
    assert (rows.count(), rows.select("seq").distinct().count()) == (200, 200)


def test_dedupe_lands_a_number_once_whatever_it_overlaps(job):
    job.land(1)
    sink = job.spec(policy="dedupe").sink()
    rows = feed.generate_feed(job.spark, 20)
    ten, more = rows.where("seq <= 10"), rows.where("seq > 5")
    assert sink._take(ten.union(ten), 0, "one")[0] == "committed"
    assert sink._take(more.union(more), 1, "one")[0] == "committed"
    assert sorted(r.seq for r in job.table.read().select("seq").collect()) == list(range(1, 21))


def test_the_watermark_costs_the_new_commits_only(job):
    """Ten thousand commits on, a check still reads the one file that is new."""
    job.land(1)
    table, sink = job.table, job.spec().sink()
    sink._watermarks["one"] = (10_000, 9_999)
    table.commit([StagedBatch("one", 1, "data/a", 0, None, None, "f")])
    read, texts = table.fs.read_text, []
    table.fs.read_text = lambda path: texts.append(path) or read(path)
    name = f"{table.root}/ledger/{10_000:020d}.json"
    table.fs.write_text(name, read(f"{table.root}/ledger/{0:020d}.json").replace('"batch_id": 1', '"batch_id": 10000'))
    try:
        assert sink._watermark("one", 10_001) == 10_000
    finally:
        del table.fs.read_text
    assert texts == [name]


def test_folding_keeps_rows_watermark_and_replay_memory(job):
    job.land(200, 4)
    job.run()
    rows, mark = job.table.read().count(), job.table.watermark()
    assert job.table.snapshots().count() == 4
    assert job.table.fold() == 0
    assert job.table.snapshots().count() == 4 and job.table.read().count() == rows
    assert maintenance.expire_commits(job.table, NOW, min_retention=NOW) == 3
    assert job.table.snapshots().count() == 1
    assert job.table.watermark() == mark and job.table.read().count() == rows
    job.save()
    job.land(100, 2)
    job.run()
    assert job.verdict()["complete"] and job.table.snapshots().count() == 3
    with pytest.raises(Refused, match="below the minimum"):
        maintenance.expire_commits(job.table, timedelta(days=1))


def test_the_newest_snapshot_of_an_empty_history(job):
    assert job.table.state()["rows_visible"] == 0 and job.table.watermark() is None
    assert job.table.read().count() == 0 and job.table.files().count() == 0
    with pytest.raises(Refused):
        job.table.fold()


def test_orphans_are_found_and_held_and_young_files_are_not(job):
    stale(job, "hold")
    table = job.table
    feed.generate_feed(job.spark, 10).coalesce(1).write.parquet(f"{table.root}/data/left/over")
    assert maintenance.remove_orphan_files(table, NOW, NOW) == 1
    assert maintenance.remove_orphan_files(table, timedelta(hours=1), NOW) == 0
    with pytest.raises(Refused, match="below the minimum"):
        maintenance.remove_orphan_files(table, NOW)
    assert maintenance.remove_orphan_files(table, NOW, NOW, dry_run=False) == 1
    job.land(400, 4)
    job.run(checkpoint="saved", files=2, policy="hold")
    assert job.verdict()["missing_runs"] == 0
    assert maintenance.readable(table)["rows"] == 1700


def test_orphans_of_a_table_below_a_folder_named_data(spark, work):
    root = f"{work}/data/tables/t"
    rows = feed.generate_feed(spark, 100)
    table = LedgerTable(spark, root, rows.schema)
    sink = IngestSpec("t", rows, table, f"{work}/c").sink()
    for i in range(4):
        assert sink._take(rows.where(F.col("seq") % 4 == i), i, "one")[0] == "committed"
    assert maintenance.table_orphans(table, NOW).count() == 0
    assert maintenance.remove_orphan_files(table, NOW, NOW, dry_run=False) == 0
    live = table.live_paths().first()["path"]
    left = [f"{root}/data/one/000000000009-x/_temporary/0/_temporary/a/part-0", f"{root}/{live}/_temporary/0/part-1",
            f"{root}/data/one/000000000008-y/part-0.parquet", f"{root}/ledger/.base-abc/part-0.json", f"{root}/ledger/.00000000000000000007.json.ab"]
    for path in left:
        table.fs.mkdirs(path.rsplit("/", 1)[0])
        table.fs.write_text(path, "left over")
    found = {r.path.split("/t/")[1] for r in maintenance.table_orphans(table, NOW).collect()}
    assert found == {p.split("/t/")[1] for p in left}
    assert maintenance.remove_orphan_files(table, timedelta(hours=1), NOW, dry_run=False) == 0
    assert maintenance.remove_orphan_files(table, NOW, NOW, dry_run=False) == len(left)
    assert maintenance.table_orphans(table, NOW).count() == 0
    assert not any(table.fs.exists(p) for p in left)
    assert maintenance.readable(table)["rows"] == 100


def test_orphans_are_refused_where_a_live_folder_is_not_listed(job):
    job.land(100, 2)
    job.run()
    job.table.fs.delete(f"{job.table.root}/{job.table.live_paths().first()['path']}")
    with pytest.raises(Refused, match="not listed"):
        maintenance.table_orphans(job.table, NOW)


@pytest.mark.parametrize("parts", [1, 4, 8])
def test_writers_write_as_many_files_whatever_the_input(job, parts):
    job.land(1)
    rows = feed.generate_feed(job.spark, 1000).repartition(parts)
    sink = job.spec(writers=2).sink()
    sink._take(rows, 0, "one")
    assert job.table.files().count() == 2


def test_the_manifest_names_files_without_rows(job):
    path = job.table.new_path("lineage", 0)
    rows = feed.generate_feed(job.spark, 10)
    rows.where("seq < 0").coalesce(1).write.parquet(f"{job.table.root}/{path}")
    rows.coalesce(1).write.mode("append").parquet(f"{job.table.root}/{path}")
    job.table.commit([StagedBatch("lineage", 0, path, 10, 1, 10, "", 2, 0)])
    listed = {r["path"].rsplit("/", 1)[1]: r["length"] for r in objects_under(job.spark, f"{job.table.root}/data").collect()}
    manifest = job.table.files().collect()
    assert {r["file_path"].rsplit("/", 1)[1]: r["file_size_in_bytes"] for r in manifest} == listed
    assert sorted(r["record_count"] for r in manifest) == [0, 10]


def test_a_removed_file_shows_when_the_table_is_read(job):
    job.land(100, 2)
    job.run()
    assert maintenance.readable(job.table) == {"readable": True, "rows": 100, "error": None}
    victim = job.table.files().orderBy("file_path").first()["file_path"]
    table = LedgerTable(job.spark, job.table.root, job.schema)
    folder, name = victim.replace("file://", "file:").rsplit("/", 1)
    table.fs.write_text(f"{folder}/{name}", "not parquet")
    broken = maintenance.readable(table)
    assert not broken["readable"] and broken["error"] and len(broken["error"]) <= 240


def test_listing_a_missing_prefix_raises(spark, work):
    with pytest.raises(PySparkException):
        objects_under(spark, f"{work}/nothing").count()


def test_samples_show_a_frozen_table_with_no_lag(job):
    job.land(100)
    first = job.run()
    job.save()
    job.land(400, 4)
    job.run()

    def log_end():
        return job.spark.read.parquet(f"{job.work}/landing").count()

    sampler = Sampler(job.table, f"{job.work}/samples", "restored", log_end, first.rows_read)
    job.run(checkpoint="saved", files=2, policy="hold", after_batch=sampler)
    rows = read_samples(job.spark, f"{job.work}/samples").orderBy("checkpoint_id").collect()
    assert [(r["checkpoint_id"], r["rows_visible"], r["consumer_lag"]) for r in rows] == [(1, 500, 200), (2, 500, 0)]
    assert {r["watermark"] for r in rows} == {4} and {r["snapshots"] for r in rows} == {5}
    blind = Sampler(job.table, f"{job.work}/blind").observe()
    assert blind["consumer_lag"] is None and blind["job_state"] is None and blind["checkpoints_failed"] is None


def test_state_and_failures_are_what_the_listener_saw(job):
    job.land(100, 4)
    seen = ProgressLog()
    job.spark.streams.addListener(seen)
    try:
        sampler = Sampler(job.table, f"{job.work}/samples", progress=seen)
        fail_and_restart(lambda f: job.spec(fault=f, after_batch=sampler), FaultOnce("committed", 2))
        rows = read_samples(job.spark, f"{job.work}/samples").orderBy("checkpoint_id", "seconds").collect()
    finally:
        job.spark.streams.removeListener(seen)
    assert {r["job_state"] for r in rows} == {"RUNNING"}
    assert {r["checkpoints_failed"] for r in rows if r["checkpoint_id"] < 2} == {0}
    assert {r["checkpoints_failed"] for r in rows if r["checkpoint_id"] > 2} <= {0, 1}


def test_progress_and_failures_are_recorded(job):
    seen = ProgressLog()
    job.spark.streams.addListener(seen)
    try:
        job.land(60, 3)
        with pytest.raises(PySparkException):
            job.run(fault=FaultOnce("staged", 1))
        job.run()
        wait_until(lambda: True if len(seen.ended) == 2 and len(seen.progress) >= 3 else None, 30, "no report")
    finally:
        job.spark.streams.removeListener(seen)
    assert seen.frame(job.spark).agg(F.sum("input_rows")).first()[0] >= 60
    assert seen.failures(job.spark).count() == 1


def test_offsets_store_reset_and_startup(spark, work):
    rows = feed.generate_feed(spark, 120, providers=20)
    log.produce(rows, f"{work}/log", "npi", "seq", partitions=3)
    landed = log.read_log(spark, f"{work}/log")
    store = OffsetStore(spark, f"{work}/offsets")
    assert store.group_offsets("g").isEmpty() and store.as_map("g", "t") == {}
    with pytest.raises(Refused, match="no committed offsets"):
        stream_log(spark, f"{work}/log", rows.schema, "group-offsets", store.as_map("g", "t"))
    store.commit("g", "t", log.end_offsets(landed).withColumnRenamed("end_offset", "offset"))
    ends = store.as_map("g", "t")
    assert sum(ends.values()) == 120
    store.reset("g", "t", landed)
    assert set(store.as_map("g", "t").values()) == {0}
    store.reset("g", "t", landed, to="latest")
    assert store.as_map("g", "t") == ends
    with pytest.raises(Refused):
        store.reset("g", "t", landed, to="sometime")
    half = {p: n // 2 for p, n in ends.items()}
    table = LedgerTable(spark, f"{work}/table", rows.schema)
    source = stream_log(spark, f"{work}/log", rows.schema, "group-offsets", half)
    drain(IngestSpec("half", source, table, f"{work}/checkpoint"))
    assert table.read().count() == 120 - sum(half.values())
    with pytest.raises(Refused, match="startup"):
        stream_log(spark, f"{work}/log", rows.schema, "middle")


def test_a_malformed_record_stops_the_job(spark, work):
    schema = spark.createDataFrame([], "key string, seq long").schema
    spark.createDataFrame([("k", '{"seq": ', 0, 0)], log.LOG_SCHEMA).write.parquet(f"{work}/log")
    table = LedgerTable(spark, f"{work}/table", schema)
    with pytest.raises(PySparkException):
        drain(IngestSpec("bad", stream_log(spark, f"{work}/log", schema), table, f"{work}/c"))
    assert not table.exists()


def test_transactional_copy(spark, work):
    rows = feed.generate_feed(spark, 90, providers=20)
    files = log.land(rows, f"{work}/landing", 3)
    for name, timeout_ms, readable in (("short", 5_000, 0), ("long", 300_000, 90)):
        out = TransactionalLog(spark, f"{work}/{name}", rows.schema)
        assert out.read().count() == 0 and out.states().isEmpty()
        query = (
            stream_files(spark, f"{work}/landing", rows.schema, 1).writeStream
            .option("checkpointLocation", f"{work}/c-{name}").trigger(availableNow=True)
            .foreachBatch(out.writer(name, 120_000, timeout_ms)).start()
        )
        query.awaitTermination()
        assert out.read("read_uncommitted").count() == 90
        assert out.read("read_committed").count() == readable
        assert out.states(name).count() == files and out.states("elsewhere").isEmpty()


def test_results_are_merged_by_part(spark, work):
    def frame(rows):
        return spark.createDataFrame(rows, "part string, commits long")

    write_results(frame([("a", 1), ("b", 2)]), f"{work}/r", ["part"])
    write_results(frame([("b", 999)]), f"{work}/r", ["part"])
    assert {tuple(r) for r in read_results(spark, f"{work}/r").collect()} == {("a", 1), ("b", 999)}
    write_results(frame([("c", 3)]), f"{work}/r", ["part"], merge=False)
    assert [tuple(r) for r in read_results(spark, f"{work}/r").collect()] == [("c", 3)]


def test_catalog(spark, work):
    schema = spark.createDataFrame([], "npi string, seq long").schema
    catalog.create_database(spark, "lake")
    catalog.create_table(spark, "lake.held", schema, f"{work}/held", key="npi", upsert=True)
    catalog.create_table(spark, "lake.held", schema, f"{work}/held", key="npi", upsert=True)
    assert catalog.table_exists(spark, "lake.held")
    assert catalog.list_tables(spark, "lake", "he*") == ["held"]
    with pytest.raises(Refused, match="key and the flag"):
        catalog.create_table(spark, "lake.other", schema, f"{work}/o", upsert=True)
    with pytest.raises(Refused, match="MERGE"):
        catalog.merge_upsert(spark.createDataFrame([("a", 1)], schema), "lake.held", "npi", "seq")
    catalog.drop_table(spark, "lake.held")
    catalog.drop_table(spark, "lake.held")
    assert not catalog.table_exists(spark, "lake.held")


def test_supervision_restarts_and_gives_up(job):
    from tidemark.streaming.ingest import supervise

    job.land(60, 3)
    sink, failures = supervise(job.spec(fault=FaultOnce("staged", 1)), attempts=3, delay=0)
    assert len(failures) == 1 and sink.outcomes[-1] == (2, "committed")
    assert job.verdict()["complete"]

    def always(point, batch_id):
        raise RuntimeError("broken for good")

    job.land(20)
    with pytest.raises(PySparkException, match="broken for good"):
        supervise(job.spec(fault=always), attempts=2, delay=0)


def test_waits_end_one_way_or_the_other(job):
    from tidemark.streaming import waits

    job.land(80, 4)
    query, _ = job.spec(interval="100 milliseconds").start()
    try:
        assert waits.wait_for_batches(query, 2, 60) >= 1
        assert waits.wait_for_rows(job.table, 80, 60) >= 0
        assert waits.wait_for_watermark(job.table, 3, 60) == 3
        rows, _ = waits.wait_until_stable(job.table, 3, 0.2, 60, commit_interval=0.1)
        assert rows == 80
        with pytest.raises(Refused, match="did not reach 81 rows"):
            waits.wait_for_rows(job.table, 81, 0.5)
        with pytest.raises(Refused, match="did not reach 99"):
            waits.wait_for_watermark(job.table, 99, 0.5)
    finally:
        query.stop()
    with pytest.raises(Refused, match="ended while waiting"):
        waits.wait_for_batches(query, 1000, 5)
    with pytest.raises(Refused, match="polls span"):
        waits.wait_until_stable(job.table, 3, 3, 60, commit_interval=10)
    missing = LedgerTable(job.spark, f"{job.work}/nowhere", job.schema)
    with pytest.raises(Refused, match="did not settle"):
        waits.wait_until_stable(missing, 2, 0.1, 0.5, commit_interval=0.1)


def test_a_commit_interval_makes_one_snapshot_per_trigger_with_data(job):
    job.land(40)
    query, _ = job.spec(interval="200 milliseconds").start()
    try:
        wait_until(lambda: True if job.table.rows_visible() == 40 else None, 60, "first rows")
        # idle triggers commit nothing
        import time
        time.sleep(1)
        assert job.table.snapshots().count() == 1
        job.land(40)
        wait_until(lambda: True if job.table.rows_visible() == 80 else None, 60, "more rows")
        assert job.table.snapshots().count() == 2
    finally:
        query.stop()


def test_documents_of_results_are_read_nested(spark, work):
    from tidemark.operators.compare import one_configuration
    from tidemark.sources.results import read_documents
    from tidemark.workspace import Files

    files = Files(spark)
    files.mkdirs(f"{work}/docs")
    files.write_text(f"{work}/docs/run.json", """{"configurations": [
      {"mode": "a", "upsert": false, "landed": {"rows": 5, "runs": [{"start": 1, "end": 2}]}},
      {"mode": "b", "upsert": true, "landed": {"rows": 7, "runs": []}}], "workload": {"events": 5}}""")
    rows = read_documents(spark, f"{work}/docs").select(F.inline("configurations"))
    assert one_configuration(rows, mode="b", upsert=True).first()["landed"]["rows"] == 7
    for wrong in ({"mode": "c"}, {}):
        with pytest.raises(Refused, match="configurations with"):
            one_configuration(rows, **wrong)


def test_columns_that_hold_maps_are_fingerprinted(spark, work):
    rows = spark.createDataFrame(
        [(1, {"a": 1}, [{"x": "y"}]), (2, None, [])], "seq long, m map<string,int>, n array<map<string,string>>"
    )
    log.land(rows, f"{work}/landing", 1)
    table = LedgerTable(spark, f"{work}/table", rows.schema)

    def spec(fault):
        source = stream_files(spark, f"{work}/landing", rows.schema)
        return IngestSpec("maps", source, table, f"{work}/checkpoint", fault=fault)

    sink = fail_and_restart(spec, FaultOnce("committed", 0))
    assert sink.outcomes[0] == (0, "suppressed") and table.read().count() == 2
    assert maintenance.readable(table)["readable"]
