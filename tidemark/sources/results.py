"""Result tables: written by part, merged on a partial re-run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.compare import merge_results
from tidemark.workspace import Files


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a result table."""
    return spark.read.parquet(f"{path}/{_versions(spark, path)[-1]}")


def _versions(spark: SparkSession, path: str) -> list[str]:
    return sorted(n for n in Files(spark).names(path) if n.startswith("v-"))


def write_results(measured: DataFrame, path: str, keys: list[str], merge: bool = True) -> None:
    """Write a new version; unless told otherwise, parts not measured now stay."""
    spark = measured.sparkSession
    known = _versions(spark, path)
    if merge and known:
        measured = merge_results(read_results(spark, path).select(*measured.columns), measured, keys)
    files = Files(spark)
    files.mkdirs(path)
    staged = f"{path}/.staged-{uuid.uuid4().hex}"
    measured.write.parquet(staged)
    number = int(known[-1].split("-")[1]) + 1 if known else 0
    while not files.rename_new(staged, f"{path}/v-{number:012d}"):
        number += 1


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested result documents, one JSON object per file."""
    return spark.read.option("multiLine", True).json(path)
