"""Streaming ingest, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.audit import append_verdict
from tidemark.operators.compare import ABOVE, AT_MOST, BELOW, WITHIN_NOISE, Claim, judge_claims, long_form
from tidemark.operators.layout import commit_layout, files_summary
from tidemark.plans.registry import Registry
from tidemark.plans.tables import WRITERS, highest, read
from tidemark.session import SCAN_BYTES
from tidemark.sources.log import BLOCK, land, produce
from tidemark.sources.wire import JSON_TIMES, to_wire
from tidemark.streaming.ingest import IngestSpec, drain, stream_files, stream_log, stream_wire
from tidemark.streaming.ledger import LedgerTable
from tidemark.streaming.sink import read_upsert
from tidemark.workspace import Files, new_dir

REGISTRY = Registry()

# Micro-batches a landed feed is read in.
BATCHES = 4


def chunks_for(spark: SparkSession, sf_dir: str, batches: int = BATCHES) -> int:
    """Landing files for the feed: as many as keep them to what a task should
    read, two a batch at least, whole batches of them; the same on any machine."""
    size = Files(spark).total_bytes(f"{sf_dir}/events.parquet")
    return max(2, -(-size // (SCAN_BYTES * batches))) * batches


def landed_stream(
    records: DataFrame, sf_dir: str, path: str, batches: int = BATCHES
) -> DataFrame:
    """Land records and read them back as a stream of exactly `batches` batches."""
    spark = records.sparkSession
    files = land(records, path, chunks_for(spark, sf_dir, batches), exact=True)
    return stream_files(spark, path, records.schema, files // batches)


def table_stream(
    spark: SparkSession, sf_dir: str, name: str, landing: str, batches: int = BATCHES,
    files_in_place: int | None = None,
) -> DataFrame:
    """A given table as a stream of about `batches` batches.

    It is landed first, as a feed is; with `files_in_place`, the number of files
    a large table lies in, it is streamed where it lies and nothing is copied.
    """
    path, rows = f"{sf_dir}/{name}.parquet", read(spark, sf_dir, name)
    if files_in_place is not None:
        return stream_files(spark, path, rows.schema, -(-files_in_place // batches))
    return landed_stream(rows, sf_dir, landing, batches)


def produce_log(events: DataFrame, sf_dir: str, path: str) -> int:
    """The feed as a log directory, in blocks small enough for several files."""
    files = chunks_for(events.sparkSession, sf_dir)
    block = max(1 << 8, min(BLOCK, highest(events, "event_id") // (2 * files)))
    return produce(events, path, "user_id", "event_id", WRITERS, files, block)


@REGISTRY.add("smoke_append", "SELECT * FROM events")
def smoke_append(spark, sf_dir):
    """Feed, landing files, streaming job, ledger table, fresh read."""
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "smoke")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    source = table_stream(spark, sf_dir, "events", f"{root}/landing")
    drain(IngestSpec("smoke-append", source, table, f"{root}/checkpoint", seq="event_id"))
    return LedgerTable(spark, f"{root}/table", events.schema).read()


@REGISTRY.add(
    "ingest_verdict",
    """SELECT count(*) AS rows, count(*) AS distinct_seq, CAST(0 AS BIGINT) AS duplicate_seq_rows,
       CAST(0 AS BIGINT) AS missing_runs, CAST(0 AS BIGINT) AS missing_seqs, count(*) AS events_expected,
       true AS complete FROM events""",
)
def ingest_verdict(spark, sf_dir):
    """Ingest the feed, then prove that every event landed exactly once."""
    hi = highest(read(spark, sf_dir, "events"), "event_id")
    return append_verdict(smoke_append(spark, sf_dir), 0, hi, "event_id")


@REGISTRY.add(
    "ingest_json", "SELECT * FROM events"
)
def ingest_json(spark, sf_dir):
    """From a landing directory of JSON files."""
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "json")
    files = chunks_for(spark, sf_dir)
    events.repartition(files).write.options(**JSON_TIMES).json(f"{root}/landing")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    source = stream_files(spark, f"{root}/landing", events.schema, -(-files // BATCHES), fmt="json")
    drain(IngestSpec("ingest-json", source, table, f"{root}/checkpoint", seq="event_id"))
    return table.read()


LATEST_SQL = """SELECT event_id, ts, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""


@REGISTRY.add("ingest_upsert", LATEST_SQL)
def ingest_upsert(spark, sf_dir):
    """The latest record of each key, from batches in no particular order."""
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "upsert")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    source = table_stream(spark, sf_dir, "events", f"{root}/landing")
    drain(IngestSpec(
        "ingest-upsert", source, table, f"{root}/checkpoint", seq="event_id",
        key="user_id", upsert=True, compact_ratio=2.0,
    ))
    return read_upsert(table, "user_id", "event_id")


@REGISTRY.add(
    "ingest_log", "SELECT * FROM events"
)
def ingest_log(spark, sf_dir):
    """From a keyed, partitioned log of JSON values."""
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "log")
    files = produce_log(events, sf_dir, f"{root}/log")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    source = stream_log(spark, f"{root}/log", events.schema, files_per_trigger=-(-files // BATCHES))
    drain(IngestSpec("ingest-log", source, table, f"{root}/checkpoint", seq="event_id"))
    return table.read()


@REGISTRY.add(
    "ingest_wire", "SELECT * FROM events"
)
def ingest_wire(spark, sf_dir):
    """From `key|{json}` text files, decoded strictly."""
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "wire")
    files = chunks_for(spark, sf_dir)
    to_wire(events, "user_id").repartition(files).write.text(f"{root}/landing")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    source = stream_wire(spark, f"{root}/landing", events.schema, -(-files // BATCHES))
    drain(IngestSpec("ingest-wire", source, table, f"{root}/checkpoint", seq="event_id"))
    return table.read()


@REGISTRY.add(
    "commit_per_batch",
    f"""SELECT count(*) AS rows, {BATCHES} AS commits, 2 AS max_files_in_one_commit,
        2 AS min_files_in_one_commit, {2 * BATCHES} AS data_files, 2.0 AS files_per_commit,
        true AS manifest_agrees FROM events""",
)
def commit_per_batch(spark, sf_dir):
    """Files per commit follow the writers, not the rows.

    A file target far above the batch changes nothing: two writers, two files.
    """
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "commits")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    source = landed_stream(events, sf_dir, f"{root}/landing")
    drain(IngestSpec(
        "commit-per-batch", source, table, f"{root}/checkpoint", seq="event_id",
        writers=2, max_records_per_file=1 << 30,
    ))
    manifest = table.files().agg(
        F.count(F.lit(1)).alias("f"), F.sum("record_count").alias("r")
    ).first()
    return commit_layout(table.snapshots()).select(
        F.lit(manifest["r"]).alias("rows"), F.col("commits").cast("int").alias("commits"),
        *[F.col(c).cast("int").alias(c) for c in
          ("max_files_in_one_commit", "min_files_in_one_commit", "data_files")],
        "files_per_commit", (F.col("data_files") == manifest["f"]).alias("manifest_agrees"),
    )


@REGISTRY.add(
    "target_file_size",
    f"""SELECT count(*) AS rows, {BATCHES} AS commits, true AS more_files_than_writers FROM events""",
)
def target_file_size(spark, sf_dir):
    """A small record target rolls files over within a commit."""
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "target")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    source = landed_stream(events, sf_dir, f"{root}/landing")
    per_file = max(1, events.count() // (BATCHES * 10))
    drain(IngestSpec(
        "target-file-size", source, table, f"{root}/checkpoint", seq="event_id",
        writers=2, max_records_per_file=per_file,
    ))
    return commit_layout(table.snapshots()).select(
        F.lit(table.rows_visible()).cast("long").alias("rows"),
        F.col("commits").cast("int").alias("commits"),
        (F.col("min_files_in_one_commit") > 2).alias("more_files_than_writers"),
    )


@REGISTRY.add(
    "objects_listed",
    """SELECT 'data' AS kind, true AS objects_agree, true AS bytes_agree, count(*) AS rows FROM events
   UNION ALL SELECT 'ledger', true, NULL, NULL FROM range(1)""",
)
def objects_listed(spark, sf_dir):
    """Every object below a table, by kind: the listing against the table's own manifest and history."""
    from tidemark.sources.listing import objects_under

    events, root = read(spark, sf_dir, "events"), new_dir(spark, "objects")
    table = LedgerTable(spark, f"{root}/table", events.schema)
    source = table_stream(spark, sf_dir, "events", f"{root}/landing")
    drain(IngestSpec("objects", source, table, f"{root}/checkpoint", seq="event_id"))
    home = table.fs.qualified(table.root)
    kind = F.when(F.startswith("path", F.lit(f"{home}/data/")), "data").otherwise("ledger")
    listed = objects_under(spark, table.root).groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("length").alias("bytes")
    )
    manifest = table.files().agg(
        F.lit("data").alias("kind"), F.count(F.lit(1)).alias("known"),
        F.sum("file_size_in_bytes").alias("known_bytes"), F.sum("record_count").alias("rows"),
    )
    history = table.snapshots().agg(
        F.lit("ledger").alias("kind"), F.count(F.lit(1)).alias("known"),
        F.lit(None).cast("long").alias("known_bytes"), F.lit(None).cast("long").alias("rows"),
    )
    return listed.join(manifest.unionByName(history), "kind", "full_outer").select(
        "kind", (F.col("objects") == F.col("known")).alias("objects_agree"),
        (F.col("bytes") == F.col("known_bytes")).alias("bytes_agree"), "rows",
    )


INTERVAL_CLAIMS = [
    Claim("a target no file comes near changes nothing", WITHIN_NOISE, "data_files", "short, large target", "short"),
    Claim("a longer interval makes fewer files", BELOW, "data_files", "long", "short"),
    Claim("a longer interval makes larger files", ABOVE, "avg_data_file_bytes", "long", "short"),
    Claim("a commit has a file a writer", AT_MOST, "max_files_in_one_commit", limit=2.0),
    Claim("every run holds all rows", WITHIN_NOISE, "rows", "long", "short"),
]


@REGISTRY.add(
    "commit_interval_runs",
    f"""SELECT claim, true AS holds, count(*) AS rows_per_run
   FROM events, (VALUES {", ".join(f"('{c.text}')" for c in INTERVAL_CLAIMS)}) AS c(claim) GROUP BY claim""",
)
def commit_interval_runs(spark, sf_dir):
    """One landed feed, committed in many, some and one batch; then the first run repeated, and
    once more with a target no file comes near (A16, A18, S12). What a clock does to freshness
    is `commits_on_a_clock`."""
    events, root = read(spark, sf_dir, "events"), new_dir(spark, "intervals")
    files = land(events, f"{root}/landing", chunks_for(spark, sf_dir), exact=True)
    shapes = {
        "short": (1, None), "middle": (2, None), "long": (BATCHES, None),
        "short, repeated": (1, None), "short, large target": (1, 1 << 40),
    }
    runs = []
    for key, (share, limit) in shapes.items():
        table = LedgerTable(spark, f"{root}/{key}/table", events.schema)
        source = stream_files(spark, f"{root}/landing", events.schema, files * share // BATCHES)
        drain(IngestSpec(
            f"interval {key}", source, table, f"{root}/{key}/checkpoint", seq="event_id",
            writers=2, max_records_per_file=limit,
        ))
        size = files_summary(table.files()).first()
        commits = commit_layout(table.snapshots()).first()
        runs.append((
            key, size["data_files"], size["avg_data_file_bytes"], commits["max_files_in_one_commit"], table.rows_visible()))
    measured = spark.createDataFrame(
        runs, "run string, data_files long, avg_data_file_bytes long, max_files_in_one_commit long, rows long")
    judged = judge_claims(
        long_form(measured, "run", measured.columns[1:]), INTERVAL_CLAIMS, [("short", "short, repeated")])
    return judged.select("claim", "holds", F.lit(max(r[-1] for r in runs)).cast("long").alias("rows_per_run"))
