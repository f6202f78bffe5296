"""What storage holds against what the table refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import basename


def table_objects(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects in the folder `prefix`, at any depth; `prefix` may end with a slash or without one."""
    return objects.where(F.col("path").startswith(prefix.rstrip("/") + "/"))


def unreferenced(objects: DataFrame, files: DataFrame) -> DataFrame:
    """Data objects no file entry refers to, matched by base name."""
    data = objects.where(F.col("path").contains("/data/")).withColumn("base", basename(F.col("path")))
    named = files.select(basename(F.col("file_path")).alias("base"))
    return data.join(named, "base", "left_anti")


def storage_vs_catalog(objects: DataFrame, files: DataFrame) -> DataFrame:
    """Counts of a listing and of a file table, side by side in one row.

    One aggregation by base name over the union of both. The row cannot be read when the file
    table has entries and the listing has no object below `/data/`: two inputs like these do
    not belong to one table, and the count of loose objects would be 0 whatever it holds.
    """
    zero, one = F.lit(0), F.lit(1)
    listed = objects.select(
        basename(F.col("path")).alias("base"), one.alias("objects"),
        F.col("path").contains("/data/").cast("int").alias("data"),
        F.when(F.col("path").contains("/data/"), F.col("length")).otherwise(0)
        .cast("long").alias("bytes"),
        zero.alias("named"),
    )
    named = files.select(
        basename(F.col("file_path")).alias("base"), zero.alias("objects"), zero.alias("data"),
        zero.cast("long").alias("bytes"), one.alias("named"),
    )
    by_name = listed.unionByName(named).groupBy("base").agg(
        F.sum("objects").alias("objects"), F.sum("data").alias("data"),
        F.sum("bytes").alias("bytes"), F.max("named").alias("named"),
    )
    loose = F.col("named") == 0
    total = by_name.agg(
        F.coalesce(F.sum("objects"), F.lit(0)).cast("long").alias("objects_on_disk"),
        F.coalesce(F.sum("data"), F.lit(0)).cast("long").alias("data_objects_on_disk"),
        F.coalesce(F.sum("named"), F.lit(0)).cast("long").alias("files_referenced"),
        F.coalesce(F.sum(F.when(loose, F.col("data"))), F.lit(0)).cast("long").alias("data_objects_unreferenced"),
        F.coalesce(F.sum(F.when(loose, F.col("bytes"))), F.lit(0)).cast("long").alias("unreferenced_bytes"),
    )
    blind = (F.col("files_referenced") > 0) & (F.col("data_objects_on_disk") == 0)
    refusal = F.raise_error(F.concat(
        F.lit("no data object among those listed, but "), F.col("files_referenced").cast("string"),
        F.lit(" entries in the file table: not the listing of this table"),
    )).cast("long")
    return total.withColumn(
        "data_objects_on_disk", F.when(blind, refusal).otherwise(F.col("data_objects_on_disk"))
    )


def before_and_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two one-row measurements of a procedure, told apart by `phase`."""
    return before.withColumn("phase", F.lit("before")).unionByName(
        after.withColumn("phase", F.lit("after"))
    )


def maintenance_verdict(measured: DataFrame) -> DataFrame:
    """Did the table survive the procedure, and did the prediction hold?

    Needs `rows`, `rows_expected`, `duplicate_rows`, `missing_runs`,
    `rows_lost`, `watermark_before`, `watermark_after`, `unreferenced_before`.
    """
    whole = (F.col("rows") == F.col("rows_expected")) & (F.col("missing_runs") == 0)
    return measured.select(
        "*",
        (whole & (F.col("duplicate_rows") == 0)).alias("survived"),
        (F.col("duplicate_rows") > 0).alias("duplicates_predicted_held"),
        (F.col("rows_lost") > 0).alias("loss_predicted_held"),
        F.col("watermark_before").eqNullSafe(F.col("watermark_after")).alias("watermark_survived"),
        (F.col("unreferenced_before") == 0).alias("nothing_was_exposed"),
    )
