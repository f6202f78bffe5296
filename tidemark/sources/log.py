"""A keyed, partitioned log kept as files: produce, land, count.

The shape is that of a Kafka source (`key, value, partition, offset`), so a
job written against it runs unchanged on the real connector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Refused
from tidemark.sources.wire import encode_json
from tidemark.functions import is_offset
from tidemark.workspace import Files

LOG_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])

# Sequence numbers per counting block of `with_offsets`.
BLOCK = 1 << 16


def log_partition(key: Column, partitions: int = 4) -> Column:
    """The log partition of a key: all records of a key share one."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def with_offsets(
    records: DataFrame, partition: str, seq: str, block: int = BLOCK, name: str = "offset",
    files: int | None = None,
) -> DataFrame:
    """Number the records of each log partition from 0 in `seq` order.

    A plain row_number over four partitions would sort the whole table in four
    tasks, and a hot key makes one of them worse. Here a row is ranked inside
    its block of `block` sequence numbers only, and starts at the record count
    of the blocks before it. The running count runs over one row per block, the
    records are shuffled once, by (partition, block), and stay so: `files` sets
    how many tasks that makes. `seq` must be unique, as it is in a feed.
    """
    of_block = F.call_function("div", F.col(seq).cast("long"), F.lit(block))
    blocked = records.withColumn("__block", of_block)
    counts = blocked.groupBy(partition, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = (
        Window.partitionBy(partition).orderBy("__block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        partition, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    if files is not None:
        blocked = blocked.repartition(files, partition, "__block")
    inside = Window.partitionBy(partition, "__block").orderBy(seq)
    ranked = blocked.withColumn("__rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, [partition, "__block"]).select(
        *records.columns, (F.col("__start") + F.col("__rank")).cast("long").alias(name)
    )


def as_log(
    records: DataFrame, key: str, seq: str, partitions: int = 4, block: int = BLOCK,
    files: int | None = None,
) -> DataFrame:
    """Records as a keyed log: key, JSON value, partition, offset."""
    body = encode_json(records.columns)
    keyed = records.select(
        F.col(key).cast("string").alias("key"),
        body.alias("value"),
        log_partition(F.col(key).cast("string"), partitions).alias("partition"),
        F.col(seq).cast("long").alias("__seq"),
    )
    return with_offsets(keyed, "partition", "__seq", block, files=files).drop("__seq")


def produce(
    records: DataFrame, path: str, key: str, seq: str, partitions: int = 4, files: int = 8,
    block: int = BLOCK, ends: dict[int, int] | None = None,
) -> int:
    """Append records to a log directory, in partition and sequence order.

    Tasks get whole blocks of a log partition, not whole partitions, so a key
    holding a third of the feed is still written by many; the offset keeps its
    records in order. Appending starts after the offsets already in the log,
    which are looked up there unless the caller knows them (`ends`).
    Returns the number of files in the directory.
    """
    spark = records.sparkSession
    log = as_log(records, key, seq, partitions, block, files)
    if ends is None and Files(spark).exists(path):
        found = end_offsets(read_log(spark, path)).collect()  # one row per partition
        ends = {r["partition"]: r["end_offset"] for r in found}
    if ends:
        start = F.create_map(*[F.lit(int(x)) for kv in ends.items() for x in kv])
        base = F.coalesce(F.try_element_at(start, F.col("partition")), F.lit(0))
        log = log.withColumn("offset", (F.col("offset") + base).cast("long"))
    log.write.mode("append").parquet(path)
    return _part_files(spark, path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def land(records: DataFrame, path: str, chunks: int, exact: bool = False) -> int:
    """Append records to a landing directory in at least `chunks` files.

    A streaming read with a file limit per trigger then sees a sustained feed
    in place of one backlog. Records already in enough partitions are copied
    without a shuffle, unless `exact` asks for that many files and no more.
    Returns the number of files in the directory.
    """
    if exact or records.rdd.getNumPartitions() < chunks:
        records = records.repartition(chunks)
    records.write.mode("append").parquet(path)
    return _part_files(records.sparkSession, path)


def _part_files(spark: SparkSession, path: str) -> int:
    return sum(1 for name in Files(spark).names(path) if name.startswith("part-"))


def end_offsets(log: DataFrame) -> DataFrame:
    """Next offset of each partition, the end of the log."""
    return log.groupBy("partition").agg((F.max("offset") + 1).alias("end_offset"))


def pin(offsets: DataFrame) -> DataFrame:
    """Offsets as they are now. Appending to the log would otherwise change the
    answer of a frame read before; the rows pinned are one per partition."""
    return offsets.sparkSession.createDataFrame(offsets.collect(), offsets.schema)


def parse_offset_lines(
    lines: DataFrame, line: str = "line", allow_negative: bool = True
) -> DataFrame:
    """`topic:partition:offset` lines into rows; unreadable lines are skipped."""
    parts = F.split(F.trim(F.col(line)), ":")
    kept = lines.select(parts.alias("p")).where(
        (F.size("p") == 3) & is_offset(F.col("p")[2], allow_negative)
    )
    return kept.select(
        F.col("p")[0].alias("topic"),
        F.col("p")[1].cast("int").alias("partition"),
        F.col("p")[2].cast("long").alias("offset"),
    )


def parse_group_lines(lines: DataFrame, group: str, line: str = "line") -> DataFrame:
    """`group topic partition offset end ...` lines of one group into rows."""
    parts = F.split(F.trim(F.col(line)), "\\s+")
    kept = lines.select(parts.alias("p")).where(
        (F.size("p") >= 5) & (F.col("p")[0] == group) & is_offset(F.col("p")[3], False)
    )
    return kept.select(
        F.col("p")[1].alias("topic"),
        F.col("p")[2].cast("int").alias("partition"),
        F.col("p")[3].cast("long").alias("offset"),
    )


def landed(before: DataFrame, after: DataFrame, expected: DataFrame) -> DataFrame:
    """How far the log grew against what was fed.

    `before` and `after` hold (partition, end_offset); `expected` is one row
    with the number of records fed.
    """
    grown = (
        after.select(F.col("end_offset").alias("n"))
        .unionByName(before.select((-F.col("end_offset")).alias("n")))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("landed"))
    )
    fed = expected.select(F.col(expected.columns[0]).cast("long").alias("fed"))
    paired = grown.select("landed", F.lit(None).cast("long").alias("fed")).unionByName(
        fed.select(F.lit(None).cast("long").alias("landed"), "fed")
    )
    return paired.agg(F.max("landed").alias("landed"), F.max("fed").alias("fed")).withColumn(
        "proven", F.col("landed") == F.col("fed")
    )


def require_landed(before: DataFrame, after: DataFrame, expected: int) -> int:
    """Refuse unless the log grew by exactly `expected` records."""
    spark = after.sparkSession
    row = landed(before, after, spark.createDataFrame([(expected,)], "fed long")).first()
    if not row["proven"]:
        raise Refused(f"produced {row['landed']} records, expected {expected}")
    return expected
