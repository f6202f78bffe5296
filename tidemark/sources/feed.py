"""The deterministic change feed: every field is a function of the record number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hash_draw, pick

DEFAULT_SALT = "tidemark/feed"

# Fixed values of the feed: field choices, in their natural order.
SOURCES = ["payer_feed", "license_board", "site_scrape", "clearinghouse"]
CREDENTIALS = ["MD", "DO", "NP", "PA"]
SPECIALTIES = ["family_medicine", "cardiology", "dermatology", "pediatrics",
               "orthopedics", "psychiatry"]
STATES = ["TX", "CA", "NY", "FL", "IL", "WA"]
CITIES = ["austin", "dallas", "houston", "san_diego", "brooklyn", "tampa"]
FIRST_NAMES = ["robert", "katherine", "james", "maria", "david", "linda",
               "michael", "susan"]
LAST_NAMES = ["nguyen", "patel", "okafor", "hernandez", "kowalski", "silva",
              "andersson", "yamamoto"]
NETWORK_STATUSES = ["in_network", "out_of_network", "pending"]
# Fixed values of the feed: number ranges.
KEY_BASE, KEY_RANGE = 1_000_000_000, 900_000_000
ZIP_BASE, ZIP_RANGE = 70_000, 29_999

FEED_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("npi", "source", "first_name", "last_name", "credential", "city",
                     "state", "zip", "specialty", "network_status")
    ]
    + [T.StructField("revision", T.IntegerType()), T.StructField("seq", T.LongType())]
)


def provider_key(provider_id: Column, salt: str = DEFAULT_SALT) -> Column:
    """The ten-digit natural key of a provider."""
    return (hash_draw(provider_id, "npi", salt) % KEY_RANGE + KEY_BASE).cast("string")


def with_feed_fields(
    records: DataFrame,
    seq: str = "seq",
    providers: int = 2000,
    corrections_from: int | None = None,
    salt: str = DEFAULT_SALT,
) -> DataFrame:
    """Turn record numbers into feed rows (S5). No shuffle, one projection.

    Who a record is about, its source and its network status are drawn from the
    record number; everything else about a provider from the provider id, so a
    key recurs and its later records correct the earlier ones.
    """
    n = F.col(seq).cast("long")
    numbered = records.select(
        n.alias("seq"), (hash_draw(n, "provider", salt) % providers).alias("provider_id")
    )
    n, who = F.col("seq"), F.col("provider_id")
    correcting = F.lit(False) if corrections_from is None else n >= corrections_from
    return numbered.select(
        provider_key(who, salt).alias("npi"),
        pick(n, "source", SOURCES, salt).alias("source"),
        pick(who, "first", FIRST_NAMES, salt).alias("first_name"),
        pick(who, "last", LAST_NAMES, salt).alias("last_name"),
        pick(who, "cred", CREDENTIALS, salt).alias("credential"),
        pick(who, "city", CITIES, salt).alias("city"),
        pick(who, "state", STATES, salt).alias("state"),
        (hash_draw(who, "zip", salt) % ZIP_RANGE + ZIP_BASE).cast("string").alias("zip"),
        pick(who, "spec", SPECIALTIES, salt).alias("specialty"),
        pick(n, "net", NETWORK_STATUSES, salt).alias("network_status"),
        F.when(correcting, 2).otherwise(1).cast("int").alias("revision"),
        n.alias("seq"),
    )


def generate_feed(
    spark: SparkSession,
    count: int,
    start: int = 1,
    providers: int = 2000,
    corrections_from: int | None = None,
    salt: str = DEFAULT_SALT,
) -> DataFrame:
    """`count` feed rows from record number `start` on."""
    numbers = spark.range(start, start + count).withColumnRenamed("id", "seq")
    return with_feed_fields(numbers, "seq", providers, corrections_from, salt)
