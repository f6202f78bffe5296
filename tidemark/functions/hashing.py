"""Hash draws for the deterministic feed, and batch fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINGERPRINT_FIELDS = ("rows", "min_seq", "max_seq", "hash_xor", "hash_sum")


def hash_draw(number: Column, field: str, salt: str) -> Column:
    """A stable non-negative BIGINT below 2^32 for (record number, field)."""
    text = F.concat(F.lit(f"{salt}:{field}:"), number.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def pick(number: Column, field: str, options: Sequence[str], salt: str) -> Column:
    """One of the options, chosen by the hash of (record number, field)."""
    position = (hash_draw(number, field, salt) % len(options) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), position)


def row_hash(rows: DataFrame) -> Column:
    """A 64-bit hash of a whole row. Maps cannot be hashed, so a column that
    holds one goes in as JSON."""
    return F.xxhash64(*[
        F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name)
        for f in rows.schema.fields
    ])


def fingerprint_columns(rows: DataFrame, seq: str) -> list[Column]:
    """Order-insensitive aggregates that identify the content of a batch.

    All of them are plain BIGINT aggregates, so they ride along with a write
    (Dataset.observe). The sum runs over hashes reduced modulo a prime, which
    cannot overflow below 10^12 rows; the xor covers the whole 64 bits.
    """
    hashed = row_hash(rows)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.min(F.col(seq)).cast("long").alias("min_seq"),
        F.max(F.col(seq)).cast("long").alias("max_seq"),
        F.bit_xor(hashed).alias("hash_xor"),
        F.sum(hashed % F.lit(1_000_003)).alias("hash_sum"),
    ]


def fingerprint_text(values: Mapping) -> str:
    return ":".join(str(values[f]) for f in FINGERPRINT_FIELDS)
