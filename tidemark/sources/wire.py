"""Keyed wire format: one `key|{json}` line per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Time stamps to the microsecond, with and without a zone.
JSON_TIMES = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def encode_json(columns: list[str]) -> Column:
    """Columns as one compact JSON object; `decode_json` gives them back."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), JSON_TIMES)


def decode_json(text: Column, schema: T.StructType, fail_fast: bool = True) -> Column:
    """JSON into a struct: an absent field is NULL, a malformed record fails the job."""
    return F.from_json(text, schema, {"mode": "FAILFAST" if fail_fast else "PERMISSIVE", **JSON_TIMES})


def to_wire(records: DataFrame, key: str, separator: str = "|") -> DataFrame:
    """One `line` column: the key, the separator, the record as compact JSON."""
    body = encode_json(records.columns)
    return records.select(F.concat(F.col(key).cast("string"), F.lit(separator), body).alias("line"))


def split_wire(lines: DataFrame, line: str = "line", separator: str = "|") -> DataFrame:
    """`key` and `value` of each line, split at the first separator only.

    Other columns (partition, offset, file metadata) are carried along.
    """
    text, at = F.col(line), F.instr(F.col(line), separator)
    rest = [c for c in lines.columns if c != line]
    return lines.select(
        F.when(at > 0, F.substring(text, F.lit(1), at - 1)).alias("key"),
        F.substring(text, at + len(separator), F.length(text)).alias("value"),
        *rest,
    )


def from_wire(
    lines: DataFrame,
    schema: T.StructType,
    line: str = "line",
    separator: str = "|",
    fail_fast: bool = True,
) -> DataFrame:
    """The records behind wire lines, one column per schema field."""
    parsed = split_wire(lines, line, separator).select(
        decode_json(F.col("value"), schema, fail_fast).alias("record")
    )
    return parsed.select("record.*")
