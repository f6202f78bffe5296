"""A whole ingest job as one specification."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.errors import Refused
from tidemark.sources.log import LOG_SCHEMA
from tidemark.sources.offsets import from_position
from tidemark.sources.wire import JSON_TIMES, decode_json, from_wire
from tidemark.streaming.ledger import LedgerTable
from tidemark.streaming.sink import LedgerSink, UpsertSink


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None,
    fmt: str = "parquet", **options,
) -> DataFrame:
    """Typed records from a landing directory; malformed JSON fails the job."""
    reader = spark.readStream.schema(schema).options(**options)
    if fmt == "json":
        reader = reader.options(**{"mode": "FAILFAST", **JSON_TIMES, **options})
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def stream_log(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    startup: str = "earliest-offset",
    offsets: dict[int, int] | None = None,
    files_per_trigger: int | None = None,
    keep_position: bool = False,
) -> DataFrame:
    """Records of a keyed log directory, from the start or from committed offsets."""
    log = stream_files(spark, path, LOG_SCHEMA, files_per_trigger)
    if startup == "group-offsets":
        log = log.where(from_position(offsets or {}))
    elif startup != "earliest-offset":
        raise Refused(f"unknown startup position {startup!r}")
    position = ["partition", "offset"] if keep_position else []
    return log.select(decode_json(F.col("value"), schema).alias("r"), *position).select(
        "r.*", *position
    )


def stream_wire(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Records of `key|{json}` text files."""
    text = T.StructType([T.StructField("value", T.StringType())])
    lines = stream_files(spark, path, text, files_per_trigger, fmt="text")
    return from_wire(lines, schema, line="value")


@dataclass
class IngestSpec:
    """Everything that distinguishes one ingest job from another.

    `upsert` needs `key`; the two together make a keyed table, either alone is
    refused. `interval` is the commit interval ('5 seconds'); without one the
    job drains what is there and stops. `writers` bounds the files per commit,
    `max_records_per_file` only rolls a file over earlier.
    """

    name: str
    source: DataFrame
    table: LedgerTable
    checkpoint: str
    seq: str = "seq"
    key: str | None = None
    upsert: bool = False
    interval: str | None = None
    policy: str = "reject"
    delivery: str = "exactly_once"
    writers: int | None = None
    max_records_per_file: int | None = None
    compact_ratio: float | None = None
    fault: Callable[[str, int], None] | None = None
    after_batch: Callable[[str, int, int], None] | None = None
    options: dict[str, str] = field(default_factory=dict)

    def sink(self) -> LedgerSink:
        if self.upsert != (self.key is not None):
            raise Refused("an upsert needs the key and the flag together")
        common = dict(
            table=self.table, seq=self.seq, policy=self.policy, delivery=self.delivery,
            writers=self.writers, max_records_per_file=self.max_records_per_file,
            fault=self.fault, after_batch=self.after_batch,
        )
        if self.upsert:
            return UpsertSink(**common, key=self.key, compact_ratio=self.compact_ratio)
        return LedgerSink(**common)

    def start(self) -> tuple[StreamingQuery, LedgerSink]:
        sink = self.sink()
        trigger = {"processingTime": self.interval} if self.interval else {"availableNow": True}
        query = (
            self.source.writeStream.queryName(self.name)
            .option("checkpointLocation", self.checkpoint)
            .options(**self.options)
            .trigger(**trigger)
            .foreachBatch(sink)
            .start()
        )
        return query, sink


def drain(spec: IngestSpec, timeout: float = 3600) -> LedgerSink:
    """Run a job over everything that is there; a failure or a timeout raises."""
    if spec.interval is not None:
        raise Refused("a job with a commit interval has no end to wait for")
    query, sink = spec.start()
    try:
        if not query.awaitTermination(timeout):
            raise Refused(f"{spec.name} did not finish within {timeout:g}s")
    finally:
        query.stop()
    return sink


def supervise(
    spec: IngestSpec, attempts: int, delay: float = 5.0, timeout: float = 3600
) -> tuple[LedgerSink, list[str]]:
    """Drain with a fixed-delay restart policy (S15); the last failure is raised.

    Returns the sink of the run that ended well and the first line of each
    failure before it.
    """
    failures: list[str] = []
    while True:
        try:
            return drain(spec, timeout), failures
        except (PySparkException, Py4JJavaError) as err:
            failures.append(str(err).strip().splitlines()[0])
            if len(failures) >= attempts:
                raise
            time.sleep(delay)
