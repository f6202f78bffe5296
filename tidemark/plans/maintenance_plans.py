"""Maintenance beside a live writer."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.operators import audit, storage_audit
from tidemark.plans.ingest_plans import landed_stream
from tidemark.plans.registry import Registry
from tidemark.plans.tables import COMMITS_SQL, FILES_SQL, commits_by_hour, files_by_hour, highest, hour, read
from tidemark.sources.listing import objects_under
from tidemark.streaming import maintenance
from tidemark.streaming.faults import FaultOnce
from tidemark.streaming.ingest import IngestSpec, drain
from tidemark.streaming.ledger import LedgerTable
from tidemark.workspace import new_dir

REGISTRY = Registry()
# Two thirds into the time the feed covers, to the hour.
CUTOFF_SQL = """(SELECT make_timestamp((min(epoch_us(ts) // 3600000000) + 2 * max(epoch_us(ts) // 3600000000)) // 3 * 3600000000)
   FROM events)"""


def cutoff(spark, sf_dir):
    """The same as a literal; two numbers pass the driver."""
    first, last = read(spark, sf_dir, "events").agg(F.min(hour()), F.max(hour())).first()
    return F.timestamp_seconds(F.lit((first + 2 * last) // 3 * 3600)).cast("timestamp_ntz")


def listed(spark, sf_dir) -> DataFrame:
    """A listing: every data file, one metadata object per hour, and another
    table whose name merely starts the same."""
    data = files_by_hour(spark, sf_dir).select(
        F.col("file_path").alias("path"), F.col("file_size_in_bytes").alias("length"), "modified_at"
    )
    metadata = commits_by_hour(spark, sf_dir).select(
        F.concat(F.lit("lake/events/metadata/"), F.col("commit_id"), F.lit(".json")).alias("path"),
        F.lit(100).cast("long").alias("length"), F.col("committed_at").alias("modified_at"),
    )
    other = read(spark, sf_dir, "orders").groupBy("o_orderdate").agg(
        F.count(F.lit(1)).alias("length")
    ).select(
        F.concat(F.lit("lake/events_old/data/"), F.unix_date(F.to_date("o_orderdate")), F.lit(".parquet")).alias("path"),
        "length", F.col("o_orderdate").alias("modified_at"),
    )
    return data.unionByName(metadata).unionByName(other)


def referenced(spark, sf_dir) -> DataFrame:
    """The snapshot lost sight of the files that hold signups."""
    return files_by_hour(spark, sf_dir).where(F.col("event_type") != "signup")


OBJECTS_SQL = f"""{COMMITS_SQL}, {FILES_SQL}, listed AS (
  SELECT file_path AS path, file_size_in_bytes AS length, modified_at FROM files
  UNION ALL SELECT 'lake/events/metadata/' || commit_id || '.json', 100, committed_at FROM commits
  UNION ALL SELECT 'lake/events_old/data/' || (CAST(o_orderdate AS DATE) - DATE '1970-01-01') || '.parquet', count(*), o_orderdate
            FROM orders GROUP BY o_orderdate),
objects AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM listed WHERE starts_with(path, 'lake/events/')),
named AS (SELECT regexp_extract(file_path, '[^/]*$') AS base FROM files WHERE event_type <> 'signup')"""


@REGISTRY.add(
    "storage_vs_catalog",
    f"""WITH {OBJECTS_SQL}
SELECT count(*) AS objects_on_disk, count(*) FILTER (contains(path, '/data/')) AS data_objects_on_disk,
  (SELECT count(DISTINCT base) FROM named) AS files_referenced,
  count(*) FILTER (contains(path, '/data/') AND base NOT IN (SELECT base FROM named)) AS data_objects_unreferenced,
  CAST(coalesce(sum(length) FILTER (contains(path, '/data/') AND base NOT IN (SELECT base FROM named)), 0) AS BIGINT) AS unreferenced_bytes
FROM objects""",
)
def storage_vs_catalog(spark, sf_dir):
    objects = storage_audit.table_objects(listed(spark, sf_dir), "lake/events")
    return storage_audit.storage_vs_catalog(objects, referenced(spark, sf_dir))


@REGISTRY.add(
    "unreferenced_objects",
    f"""WITH {OBJECTS_SQL} SELECT path, length FROM objects
   WHERE contains(path, '/data/') AND base NOT IN (SELECT base FROM named)""",
)
def unreferenced_objects(spark, sf_dir):
    objects = storage_audit.table_objects(listed(spark, sf_dir), "lake/events")
    return storage_audit.unreferenced(objects, referenced(spark, sf_dir)).select("path", "length")


@REGISTRY.add(
    "orphan_files",
    f"""WITH {OBJECTS_SQL} SELECT path, length FROM objects WHERE contains(path, '/data/')
   AND modified_at < {CUTOFF_SQL} AND base NOT IN (SELECT base FROM named)""",
)
def orphan_files(spark, sf_dir):
    """Unreferenced and old enough: what a removal would take (I16)."""
    objects = storage_audit.table_objects(listed(spark, sf_dir), "lake/events")
    return maintenance.orphans(objects, referenced(spark, sf_dir), cutoff(spark, sf_dir)).select("path", "length")


@REGISTRY.add(
    "before_and_after",
    f"""WITH {OBJECTS_SQL},
m AS (SELECT 'before' AS phase, path, length, base, modified_at FROM objects
      UNION ALL SELECT 'after', path, length, base, modified_at FROM objects
      WHERE NOT (contains(path, '/data/') AND modified_at < {CUTOFF_SQL} AND base NOT IN (SELECT base FROM named)))
SELECT phase, count(*) AS objects_on_disk, count(*) FILTER (contains(path, '/data/')) AS data_objects_on_disk,
  (SELECT count(DISTINCT base) FROM named) AS files_referenced,
  count(*) FILTER (contains(path, '/data/') AND base NOT IN (SELECT base FROM named)) AS data_objects_unreferenced,
  CAST(coalesce(sum(length) FILTER (contains(path, '/data/') AND base NOT IN (SELECT base FROM named)), 0) AS BIGINT) AS unreferenced_bytes
FROM m GROUP BY phase""",
)
def before_and_after(spark, sf_dir):
    """The same measurement around a removal of orphans."""
    objects = storage_audit.table_objects(listed(spark, sf_dir), "lake/events")
    files = referenced(spark, sf_dir)
    taken = maintenance.orphans(objects, files, cutoff(spark, sf_dir))
    left = objects.join(taken.select("path"), "path", "left_anti")
    return storage_audit.before_and_after(
        storage_audit.storage_vs_catalog(objects, files), storage_audit.storage_vs_catalog(left, files)
    )


@REGISTRY.add(
    "expire_commits",
    f"""WITH {COMMITS_SQL} SELECT commit_id, committed_at, watermark FROM commits
   WHERE committed_at >= {CUTOFF_SQL} OR committed_at = (SELECT max(committed_at) FROM commits)""",
)
def expire_commits(spark, sf_dir):
    """The snapshots from the cutoff on stay, and the newest in any case."""
    from tidemark.operators.layout import WATERMARK_KEY, summary_value

    kept = maintenance.snapshots_kept(commits_by_hour(spark, sf_dir), cutoff(spark, sf_dir))
    return kept.select("commit_id", "committed_at", summary_value(WATERMARK_KEY).alias("watermark"))


@REGISTRY.add(
    "maintenance_live_writer",
    """SELECT count(*) AS rows, count(*) AS rows_expected, CAST(0 AS BIGINT) AS duplicate_rows,
  CAST(0 AS BIGINT) AS missing_runs, CAST(0 AS BIGINT) AS rows_lost, 3 AS snapshots_expired, 1 AS snapshots_left,
  3 AS watermark_before, 3 AS watermark_after, true AS readable, true AS survived,
  false AS duplicates_predicted_held, false AS loss_predicted_held, true AS watermark_survived,
  true AS files_were_in_flight, true AS orphans_removed, true AS committed_files_kept FROM events""",
)
def maintenance_live_writer(spark, sf_dir):
    """Expire and clean up while a job is down in mid-batch, then restart it.

    The job is killed after its table commit, the ledger expired, the job
    restarted, killed again with written but uncommitted files, the orphans
    removed, and the job run to its end.
    """
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "maintenance")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    source = landed_stream(events, sf_dir, f"{root}/landing", 8)
    hi = highest(events, "event_id")

    def run(fault=None):
        try:
            drain(IngestSpec(
                "maintained", source, table, f"{root}/checkpoint", seq="event_id", fault=fault
            ))
        except PySparkException:
            if fault is None or fault.fired_at is None:
                raise
        if fault is not None and fault.fired_at is None:
            raise Refused("the job was never interrupted")

    now = timedelta(0)
    run(FaultOnce("committed", 3))
    before = table.watermark()
    expired = maintenance.expire_commits(table, older_than=now, min_retention=now)
    left, after = table.snapshots().count(), table.watermark()
    run(FaultOnce("staged", 6))

    def data_objects():
        return objects_under(spark, table.root).where(F.col("path").contains("/data/")).count()

    live, on_disk = table.files().count(), data_objects()
    removed = maintenance.remove_orphan_files(table, now, now, dry_run=False)
    kept = data_objects()
    run()
    check = maintenance.readable(table)
    verdict = audit.append_verdict(table.read(), 0, hi, "event_id")
    measured = verdict.select(
        "rows", F.col("events_expected").alias("rows_expected"),
        F.col("duplicate_seq_rows").alias("duplicate_rows"), "missing_runs",
        F.col("missing_seqs").alias("rows_lost"),
        F.lit(expired).alias("snapshots_expired"), F.lit(left).alias("snapshots_left"),
        F.lit(before).alias("watermark_before"), F.lit(after).alias("watermark_after"),
        F.lit(check["readable"]).alias("readable"),
        F.lit(on_disk - live).alias("unreferenced_before"),
    )
    return storage_audit.maintenance_verdict(measured).select(
        "*", (F.col("unreferenced_before") > 0).alias("files_were_in_flight"),
        (F.lit(removed) == F.col("unreferenced_before")).alias("orphans_removed"),
        F.lit(kept == live).alias("committed_files_kept"),
    ).drop("unreferenced_before", "nothing_was_exposed")
