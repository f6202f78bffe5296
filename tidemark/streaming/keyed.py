"""The latest row of each key, kept by Spark's state store and shown in hash buckets."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import Refused
from tidemark.workspace import Files

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET, GENERATION = "key_bucket", "generation"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State on local disk with change logs in the checkpoint, for queries started inside: not bounded by the heap."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def latest_in_state(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of each key with the greatest sequence number seen so far; in update mode the keys a batch touched.

    An older row that comes late changes nothing and none is dropped. Equal numbers are
    settled by the row's other values, so the order of arrival never shows. State grows with
    the keys; a batch is combined by key before it is shuffled.
    """
    whole = F.struct(F.col(seq), *[F.col(c) for c in stream.columns if c != seq])
    return stream.groupBy(key).agg(F.max(whole).alias("__row")).select("__row.*").select(*stream.columns)


class BucketTable:
    """A `foreachBatch` function that rewrites the hash buckets of the keys it is given, and no other.

    A batch writes bucket `b` as a new generation, numbered by the batch; readers take the
    newest of each bucket. What it builds on is the newest generation below its own, so a
    batch that comes back writes the same again (dynamic overwrite of its own partitions),
    wherever it was killed. The generation before stays until the next rewrite of the
    bucket. The number of buckets is fixed for a table and sets what one key's change costs:
    1/buckets of the table.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, seq: str, buckets: int = 64,
        bucket_of: Callable[[Column], Column] | None = None, fault: Callable[[str, int], None] | None = None,
    ):
        if not 1 <= buckets <= 1 << 14:
            raise Refused(f"{buckets} buckets: a table has 1 to {1 << 14}")
        self.spark, self.path, self.schema, self.key, self.seq = spark, path, schema, key, seq
        self.buckets, self.fault = buckets, fault
        self.bucket_of = bucket_of or (lambda k: F.xxhash64(k))
        self.fs = Files(spark)

    def __call__(self, changed: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(self.bucket_of(F.col(self.key)), F.lit(self.buckets)).cast("int")
        changed = changed.withColumn(BUCKET, bucket).persist()
        try:
            touched = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())  # at most one row a bucket
            if not touched:
                return
            base = {b: g for b, g in self.generations(below=batch_id).items() if b in set(touched)}
            self._at("staged", batch_id)
            kept = self._rows_of(base).join(changed.select(self.key), self.key, "left_anti")
            rows = kept.unionByName(changed.select(*self.schema.names, BUCKET))
            newest = rows.withColumn(GENERATION, F.lit(batch_id).cast("long"))
            # one task a bucket, and as many files
            newest.repartition(min(len(touched), self.buckets), BUCKET).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy(BUCKET, GENERATION).parquet(self.path)
            self._at("committed", batch_id)
            for b, g in base.items():
                for old in self._listed(b):
                    if old < g:
                        self.fs.delete(self._folder(b, old))
        finally:
            changed.unpersist()

    def _at(self, point: str, batch_id: int) -> None:
        if self.fault is not None:
            self.fault(point, batch_id)

    def _folder(self, bucket: int, generation: int) -> str:
        return f"{self.path}/{BUCKET}={bucket}/{GENERATION}={generation}"

    def _listed(self, bucket: int) -> list[int]:
        names = self.fs.names(f"{self.path}/{BUCKET}={bucket}")
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{GENERATION}=")]

    def generations(self, below: int | None = None) -> dict[int, int]:
        """The newest generation of each bucket, from the folders alone."""
        found = {}
        for path in self.fs.glob(f"{self.path}/{BUCKET}=*/{GENERATION}=*"):
            bucket, generation = (int(part.split("=")[1]) for part in path.rsplit("/", 2)[1:])
            if below is None or generation < below:
                found[bucket] = max(generation, found.get(bucket, generation))
        return found

    def _rows_of(self, generations: dict[int, int]) -> DataFrame:
        kept = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not generations:
            return self.spark.createDataFrame([], kept)
        paths = [self._folder(b, g) for b, g in sorted(generations.items())]
        whole = T.StructType([*kept.fields, T.StructField(GENERATION, T.LongType())])
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*paths).select(*kept.names)

    def read(self) -> DataFrame:
        """The table: the newest generation of every bucket."""
        return self._rows_of(self.generations()).select(*self.schema.names)

    def buckets_held(self) -> DataFrame:
        """One row per bucket: its newest generation and its rows."""
        held = self._rows_of(self.generations()).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("rows"))
        newest = self.spark.createDataFrame(sorted(self.generations().items()), f"{BUCKET} int, {GENERATION} long")
        return newest.join(held, BUCKET, "left").select(BUCKET, GENERATION, F.coalesce("rows", F.lit(0)).alias("rows"))
