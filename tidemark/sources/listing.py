"""Objects under a prefix, as storage lists them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.workspace import Files

LISTING = "path string, length long, modified_at timestamp"


def objects_under(spark: SparkSession, prefix: str) -> DataFrame:
    """path, length, modified_at of every visible object below a prefix.

    Only the listing is read, never a file's content. A prefix that cannot be
    listed raises; it never reads as empty. Spark's listing leaves out names
    that start with `_` or `.`; `hidden_under` has those.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix)
    )
    return listing.select(
        "path", F.col("length"), F.col("modificationTime").alias("modified_at")
    )


def hidden_under(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """The same of objects that are hidden, or lie in a hidden folder, at most `depth` folders down.

    One glob a level returns the hidden entries only, so what passes the driver
    are leftovers of killed tasks and unfinished writes. Markers of finished
    writes (`_SUCCESS`) and local checksums are not leftovers.
    """
    fs, found = Files(spark), []
    for level in range(depth + 1):
        for path in fs.glob(f"{root}/{'*/' * level}[_.]*"):
            found += [
                (name, size, datetime.fromtimestamp(at / 1000, timezone.utc))
                for name, size, at in fs.files_below(path)
                if not name.rsplit("/", 1)[1].startswith(("_SUCCESS", "._SUCCESS"))
            ]
    return spark.createDataFrame(sorted(set(found)), LISTING)
