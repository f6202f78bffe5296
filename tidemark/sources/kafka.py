"""The real log, where the Kafka connector is on the class path."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import Refused

ISOLATION_LEVELS = ("read_committed", "read_uncommitted")


def starting_offsets(topic: str, startup: str, offsets: dict[int, int] | None = None) -> str:
    """The `startingOffsets` option for a startup position."""
    if startup == "earliest-offset":
        return "earliest"
    if startup != "group-offsets":
        raise Refused(f"unknown startup position {startup!r}")
    if not offsets:
        raise Refused(f"no committed offsets to start {topic} from")
    return json.dumps({topic: {str(p): o for p, o in sorted(offsets.items())}})


def read_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    startup: str = "earliest-offset",
    offsets: dict[int, int] | None = None,
    isolation: str = "read_committed",
    streaming: bool = True,
    **options: str,
) -> DataFrame:
    """`key, value, partition, offset, timestamp` of a topic, values as text.

    A start at committed offsets is only an initial position: once the query
    has a checkpoint, the checkpoint decides.
    """
    if isolation not in ISOLATION_LEVELS:
        raise Refused(f"unknown isolation level {isolation!r}")
    reader = spark.readStream if streaming else spark.read
    try:
        rows = (
            reader.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", starting_offsets(topic, startup, offsets))
            .option("kafka.isolation.level", isolation)
            .options(**options)
            .load()
        )
    except (AnalysisException, Py4JJavaError) as err:
        raise Refused("the Kafka connector is not on the class path") from err
    return rows.selectExpr(
        "cast(key as string) as key", "cast(value as string) as value",
        "partition", "offset", "timestamp",
    )
