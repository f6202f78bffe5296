"""Databases and tables by name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import Refused


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def create_table(
    spark: SparkSession, name: str, schema: T.StructType, path: str,
    key: str | None = None, upsert: bool = False,
) -> None:
    """Register a Parquet table at a path unless it exists.

    An upsert table needs its key and the flag together; either alone would
    look configured and behave like an append table.
    """
    if upsert != (key is not None):
        raise Refused("an upsert needs the key and the flag together")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    properties = f" TBLPROPERTIES ('upsert.key' = '{key}')" if upsert else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{properties} LOCATION '{path}'")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def list_tables(spark: SparkSession, database: str, pattern: str) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database, pattern)]


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def merge_upsert(batch: DataFrame, table: str, key: str, seq: str) -> None:
    """Upsert into a table format that knows MERGE (as Parquet tables do not).

    The batch must hold one row per key; an older record never replaces a newer.
    """
    from pyspark.sql import functions as F

    held, new = F.col(f"t.{seq}"), F.col(f"s.{seq}")
    try:
        (
            batch.alias("s").mergeInto(f"{table} AS t", F.col(f"t.{key}") == F.col(f"s.{key}"))
            .whenMatched(new > held).updateAll()
            .whenNotMatched().insertAll()
            .merge()
        )
    except AnalysisException as err:
        raise Refused(f"{table} does not support MERGE") from err
