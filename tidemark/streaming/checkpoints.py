"""What a checkpoint knows, as DataFrames: planned and committed batches, the files of each, its state (S3, I4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.workspace import Files

SOURCE_ENTRY = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("batchId", T.LongType())])
LINE = "batch_id long, line string"


def file_name(path: str) -> Column:
    """Folder and file of a path, which it keeps however its scheme is written."""
    return F.substring_index(F.col(path), "/", -2)


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a metadata log, each with the batch its file is named after; compacted files hold several batches."""
    if not Files(spark).names(folder):
        return spark.createDataFrame([], LINE)
    name = F.regexp_extract("_metadata.file_name", r"^(\d+)(?:\.compact)?$", 1)
    # a log's first line is its version; hidden files are left-overs of a write
    return spark.read.text(folder).select(name.alias("n"), F.col("value").alias("line")).where("n <> ''").select(
        F.col("n").cast("long").alias("batch_id"), "line")


def planned(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(batch_id, watermark_ms, read_to): batches whose offsets are written, so that a restart would make them the same again.

    `read_to` is how far the batch reads its file source's own log; a batch without new files repeats it.
    """
    lines = _log(spark, f"{checkpoint}/offsets").where(F.col("line").startswith("{"))
    value = lambda name: F.max(F.get_json_object("line", f"$.{name}").cast("long"))
    return lines.groupBy("batch_id").agg(value("batchWatermarkMs").alias("watermark_ms"), value("logOffset").alias("read_to"))


def committed(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(batch_id): batches the query knows to be done."""
    return _log(spark, f"{checkpoint}/commits").select("batch_id").distinct()


def files_read(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(batch_id, path) of every file the file source of a query has given to a batch.

    Entries older than the oldest batch the offsets still name count to that batch, which is committed.
    """
    lines = _log(spark, f"{checkpoint}/sources/0").where(F.col("line").startswith("{"))
    entries = lines.select(F.from_json("line", SOURCE_ENTRY).alias("e")).select(
        F.col("e.batchId").alias("entry"), F.col("e.path").alias("path")).distinct()
    # one row per batch the offsets name, a hundred by default
    before = F.lag("read_to").over(Window.orderBy("batch_id"))
    spans = planned(spark, checkpoint).withColumn("after", F.coalesce(before, F.lit(-1).cast("long"))).where("read_to > after")
    numbered = spans.select("batch_id", F.explode(F.sequence(F.col("after") + 1, F.col("read_to"))).alias("entry"))
    return entries.join(numbered, "entry").select("batch_id", "path")


def would_replay(spark: SparkSession, checkpoint: str, there: DataFrame) -> DataFrame:
    """(path, reason): what a start on this checkpoint would read.

    `there` holds the `path` of files in the source's folder now. Planned and not committed
    files are read again as the same batch; those no batch was given are new. Nothing else
    is read, whatever any other record of positions says.
    """
    open_batches = planned(spark, checkpoint).select("batch_id").join(committed(spark, checkpoint), "batch_id", "left_anti")
    given = files_read(spark, checkpoint).withColumn("name", file_name("path"))
    again = given.join(open_batches, "batch_id", "left_semi").select("path", F.lit("planned").alias("reason"))
    fresh = there.withColumn("name", file_name("path")).join(given.select("name"), "name", "left_anti").select(
        "path", F.lit("new").alias("reason"))
    return again.union(fresh)


def state_rows(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Keys and values of a query's state as of a batch, the last committed one by default."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a query: name, partitions, least and greatest batch that can be read."""
    return spark.read.format("state-metadata").load(checkpoint)
