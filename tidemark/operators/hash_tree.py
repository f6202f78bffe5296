"""Digests of an ordered table as a tree: blocks of rows, then digests of digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
FAN = 4096
DIGEST = "level int, place long, digest string"


def block_digests(rows: DataFrame, seq: str, text: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(place, digest): SHA-256 over the texts of each block of `block_rows` sequence numbers, in their order.

    Rows that repeat are counted before they meet, so a row landed a million times is one
    line of its block. Rows without a number come in block -1. Texts of one number are
    ordered among themselves, so the digest is of the content and its numbers alone.
    """
    line = rows.select(F.col(seq).cast("long").alias("seq"), F.coalesce(text, F.lit("")).alias("text"))
    place = F.coalesce(F.call_function("div", F.col("seq"), F.lit(block_rows)), F.lit(-1).cast("long"))
    counted = line.withColumn("place", place).groupBy("place", "seq", "text").agg(F.count(F.lit(1)).alias("n"))
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "text", "n"))),
        lambda r: F.when(r["n"] == 1, r["text"]).otherwise(F.concat(r["text"], F.lit(" x"), r["n"].cast("string"))))
    return counted.groupBy("place").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def parents(digests: DataFrame, fan: int = FAN) -> DataFrame:
    """One level up: the digest over up to `fan` neighbouring digests, with their places."""
    of = F.floor(F.col("place") / fan).cast("long")
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("place", "digest"))),
        lambda d: F.concat(d["place"].cast("string"), F.lit(" "), d["digest"]))
    return digests.groupBy(of.alias("place")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def tree(rows: DataFrame, seq: str, text: Column, block_rows: int = BLOCK_ROWS, fan: int = FAN, levels: int = 2) -> DataFrame:
    """All digests of a table: `level` 0 are its blocks, the last level is one row for each `block_rows * fan ** (levels - 1)` rows."""
    level = block_digests(rows, seq, text, block_rows)
    out = [level.withColumn("level", F.lit(0))]
    for k in range(1, levels):
        level = parents(level, fan)
        out.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.union, [o.select("level", "place", "digest") for o in out])


def levels_for(highest_seq: int, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> int:
    """Levels until one digest stands for all rows."""
    levels, blocks = 1, highest_seq // block_rows + 1
    while blocks > 1:
        levels, blocks = levels + 1, -(-blocks // fan)
    return max(2, levels)


def differing_blocks(left: DataFrame, right: DataFrame, fan: int = FAN) -> DataFrame:
    """(place): blocks of two trees that differ, or that one of them lacks.

    Read from the top: of each level only the children of differing parents are compared.
    Trees are best written first; equal ones cost their top level.
    """
    top = left.agg(F.max("level")).first()[0]

    def differing(level: int, below: DataFrame | None) -> DataFrame:
        sides = []
        for tree_ in (left, right):
            mine = tree_.where(F.col("level") == level).select("place", "digest")
            if below is not None:
                mine = mine.withColumn("parent", F.floor(F.col("place") / fan).cast("long")).join(below, "parent", "left_semi")
            sides.append(mine.select("place", "digest"))
        both = sides[0].select("place", "digest", F.lit(1).alias("side")).union(sides[1].select("place", "digest", F.lit(2)))
        return both.groupBy("place").agg(F.countDistinct("digest").alias("kinds"), F.count(F.lit(1)).alias("n")).where(
            (F.col("kinds") > 1) | (F.col("n") < 2)).select("place")

    found = differing(top, None)
    for level in range(top - 1, -1, -1):
        found = differing(level, found.withColumnRenamed("place", "parent"))
    return found
