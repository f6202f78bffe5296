"""Table maintenance, safe beside a writer: expiry, orphans, readability."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.functions import basename, row_hash
from tidemark.sources.listing import hidden_under, objects_under
from tidemark.streaming.ledger import LedgerTable

# Default guards: nothing younger is expired or removed unless asked for.
MIN_RETENTION = timedelta(days=7)


def snapshots_kept(snapshots: DataFrame, cutoff, at: str = "committed_at") -> DataFrame:
    """The snapshots an expiry would leave: the young ones and always the newest."""
    newest = snapshots.agg(F.max(at).alias(at)).withColumn("__newest", F.lit(True))
    marked = snapshots.join(F.broadcast(newest), at, "left")  # one row
    return marked.where((F.col(at) >= F.lit(cutoff)) | F.col("__newest")).drop("__newest")


def expire_commits(
    table: LedgerTable, older_than: timedelta, min_retention: timedelta = MIN_RETENTION
) -> int:
    """Expire snapshots older than `older_than`; returns how many went.

    Below the minimum retention the call is refused; the guard is lowered by
    passing another in the same call. The newest snapshot stays, and with it
    the watermark that a restarting job will look for.
    """
    if older_than < min_retention:
        raise Refused(f"retention {older_than} is below the minimum of {min_retention}")
    return table.fold(expire_before=datetime.now(timezone.utc) - older_than)


def orphans(objects: DataFrame, files: DataFrame, cutoff, protected: list[str] = ()) -> DataFrame:
    """Data objects nobody refers to, old enough, and not under a protected path."""
    data = objects.where(F.col("path").contains("/data/") & (F.col("modified_at") < F.lit(cutoff)))
    for prefix in protected:
        data = data.where(~F.col("path").contains(prefix))
    named = files.select(basename(F.col("file_path")).alias("base"))
    return data.withColumn("base", basename(F.col("path"))).join(named, "base", "left_anti").drop("base")


def _placed(table: LedgerTable) -> DataFrame:
    """Every object of a table, hidden ones too, with its place below the table's root."""
    root = table.fs.qualified(table.root)
    objects = objects_under(table.spark, table.root).unionByName(hidden_under(table.spark, root, 3))
    return objects.withColumn("place", F.when(
        F.startswith("path", F.lit(f"{root}/")), F.substring("path", len(root) + 2, 1 << 20)))


def table_orphans(table: LedgerTable, older_than: timedelta) -> DataFrame:
    """Unreferenced objects of a table that no held batch and no writer may need.

    An object is told by its place below the qualified root, never by a folder
    name anywhere in its path. What no snapshot refers to: data folders without
    a commit, what killed tasks left hidden in any folder, staged ledger files
    never renamed. Unlike an upload in progress, a Spark task's output is an
    object before it is committed: held batches are always left alone, and a
    batch being written is told by its age, so the guard must outlast a batch.

    Refused where the listing and the ledger cannot be of one table: an object
    that is not below the root, or a live folder that was not listed.
    """
    lineages = table.fs.names(f"{table.root}/held")
    held = [b.path for lineage in lineages for b in table.held(lineage)]
    cutoff = datetime.now(timezone.utc) - older_than
    placed = _placed(table).withColumn("folder", F.regexp_extract("place", r"^(data/[^/]+/[^/]+)/", 1))
    live = table.live_paths().where("rows > 0").select(F.col("path").alias("folder")).distinct()
    seen = placed.groupBy("folder").agg(F.count_if(F.col("place").isNull()).alias("strange"), F.lit(1).alias("listed"))
    both = seen.join(live.withColumn("live", F.lit(1)), "folder", "full_outer").agg(
        F.coalesce(F.sum("strange"), F.lit(0)).alias("strange"), F.count_if(F.expr("live IS NOT NULL AND listed IS NULL")).alias("unlisted")).first()
    if both["strange"]:
        raise Refused(f"{both['strange']} listed objects are not below {table.root}")
    if both["unlisted"]:
        raise Refused(f"{both['unlisted']} live folders of {table.root} were not listed; the listing is wrong")
    hidden = F.col("place").rlike(r"(^|/)[_.][^/]*(/|$)")
    marker = F.col("place").rlike(r"/[._]*_SUCCESS[^/]*$")
    kept = live.withColumn("in_use", F.lit(True))
    loose = placed.join(kept, "folder", "left").where(
        ((F.col("folder") != "") & F.col("in_use").isNull())
        | (hidden & ~marker & F.col("place").rlike("^(data|ledger)/"))
    ).where(F.col("modified_at") < F.lit(cutoff))
    for path in held:
        loose = loose.where(F.col("folder") != path)
    return loose.select("path", "length", "modified_at")


def remove_orphan_files(
    table: LedgerTable, older_than: timedelta, min_retention: timedelta = MIN_RETENTION,
    dry_run: bool = True,
) -> int:
    """Remove unreferenced objects; by default only say how many (I16).

    A folder that holds nothing else goes with one call; so the driver sees one
    row per abandoned batch, and single objects only in folders still in use.
    """
    if older_than < min_retention:
        raise Refused(f"retention {older_than} is below the minimum of {min_retention}")
    loose = table_orphans(table, older_than).select("path")
    if dry_run:
        return loose.count()
    loose = loose.cache()
    root = table.fs.qualified(table.root)
    place = F.substring("path", len(root) + 2, 1 << 20)
    folder = F.regexp_extract(place, r"^(data/[^/]+/[^/]+)/", 1)
    mine = loose.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    all_of = _placed(table).groupBy(F.regexp_extract("place", r"^(data/[^/]+/[^/]+)/", 1).alias("folder")).agg(
        F.count(F.lit(1)).alias("of"))
    empty = mine.join(all_of, "folder").where("folder <> '' AND n >= of").select("folder", "n")
    removed, gone = 0, empty.collect()  # one row per abandoned batch
    for row in gone:
        table.fs.delete(f"{table.root}/{row['folder']}")
        removed += row["n"]
    whole = table.spark.createDataFrame([(r["folder"],) for r in gone], "folder string")
    single = loose.withColumn("folder", folder).join(whole, "folder", "left_anti")
    for row in single.toLocalIterator():
        table.fs.delete(row["path"])
        removed += 1
    loose.unpersist()
    return removed


def readable(table: LedgerTable) -> dict:
    """Can every file of the newest snapshot be read? The read is the check."""
    try:
        rows = table.read()
        row = rows.agg(
            F.count(F.lit(1)).alias("rows"), F.bit_xor(row_hash(rows)).alias("h")
        ).first()
        return {"readable": True, "rows": row["rows"], "error": None}
    except PySparkException as err:
        return {"readable": False, "rows": None, "error": _short(str(err))}
    except Exception as err:  # a file system error surfaces through Py4J
        if type(err).__module__.startswith("py4j"):
            return {"readable": False, "rows": None, "error": _short(str(err))}
        raise


def _short(text: str, limit: int = 240) -> str:
    lines = [line for line in text.splitlines() if line.strip()]
    return (lines[0] if lines else "")[:limit]
