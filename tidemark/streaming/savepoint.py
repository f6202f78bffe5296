"""Savepoints: copies of a checkpoint taken while nothing writes to it (S3)."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.errors import Refused
from tidemark.workspace import Files


def lineage_of(spark: SparkSession, checkpoint: str) -> str:
    """The query id a checkpoint carries; a copy carries the same one."""
    files = Files(spark)
    if not files.exists(f"{checkpoint}/metadata"):
        raise Refused(f"{checkpoint} is not the checkpoint of a query")
    return json.loads(files.read_text(f"{checkpoint}/metadata").splitlines()[-1])["id"]


def last_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """The newest batch the query itself knows to be complete."""
    ids = [int(n) for n in Files(spark).names(f"{checkpoint}/commits") if n.isdigit()]
    return max(ids, default=None)


def save(
    spark: SparkSession, checkpoint: str, target: str, query: StreamingQuery | None = None
) -> int | None:
    """Copy a stopped query's checkpoint; returns the batch it was taken at."""
    if query is not None and query.isActive:
        raise Refused("a savepoint is taken between batches: stop the query first")
    lineage_of(spark, checkpoint)
    Files(spark).copy_tree(checkpoint, target)
    return last_batch(spark, target)
