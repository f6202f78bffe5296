"""What the operators share: Arrow texts as numpy buffers, words, cut lineages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.workspace import new_dir

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def cut(frame: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from a table below `spark.checkpoint.dir`.

    A lost executor then costs one read, not the whole plan before it.
    """
    spark = frame.sparkSession
    path = new_dir(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_hashes(rows: DataFrame, total: int, wanted: int) -> list[tuple]:
    """At most `wanted` rows with about the least values of their column `h`, in its order.

    A bound on the hash keeps about twice as many of `total` rows, and never more
    than four times as many are fetched, so tasks send the driver what it keeps
    and no more, however many there are. A table of few rows is taken whole.
    """
    if total > 2 * wanted:
        rows = rows.where(F.col("h") < F.lit(-(1 << 63) + (1 << 64) * 2 * wanted // total).cast("long"))
    return sorted((tuple(r) for r in rows.limit(4 * wanted).collect()), key=lambda r: (r[0], str(r[1:])))[:wanted]


def in_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts have about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.diff(offsets_of(batch.column(column))))
        first = 0
        while first < batch.num_rows:
            before = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    whole = np.frombuffer(texts.buffers()[1], kind)
    return whole[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of UTF-8 bytes, and where each begins (one more at the end); null is empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    at = offsets_of(texts)
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of the hash base and of its inverse, as many as were ever asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) <= n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(BASE, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(BASE_INVERSE, k, 1 << 64))])
        return cls.up, cls.down


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts: first byte, end, and number of words before each text."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, at)


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by prefix sums of a polynomial."""
    up, down = Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


def runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal keys."""
    if not len(sorted_keys):
        none = np.zeros(0, np.int64)
        return none, none
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return first, np.diff(np.concatenate([first, [len(sorted_keys)]]))


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of [first, first + length), one range after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    return np.arange(total) - np.repeat(begin - first, length)


def keyed_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole keys from batches sorted by key; at most one key waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1].as_py()
        changes = np.flatnonzero(keys.to_numpy(zero_copy_only=False) != last)
        border = int(changes[-1]) + 1 if len(changes) else 0
        if border == 0 and held and held[-1].column(key)[-1].as_py() == last:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, border)] if border else held
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(border)]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b): every node of an edge with the least node it reaches.

    Large star and small star in turn, each a join on the nodes' least neighbours, until
    nothing changes; every round is written below `spark.checkpoint.dir`. An edge of a node
    with itself, a repeated edge and an empty table are allowed.
    """
    links = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, label)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), F.col("a").alias("y"), "m")
        small = small.select("x", "m").union(small.select("y", "m")).toDF("a", "b").where("a != b").distinct()
        links = cut(small, label)
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
