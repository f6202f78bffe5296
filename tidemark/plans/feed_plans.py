"""Feed, wire format and log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import audit
from tidemark.plans.registry import Registry
from tidemark.plans.tables import LOG_SQL, log_of_events, read, micros
from tidemark.sources import log as logs
from tidemark.sources.feed import DEFAULT_SALT, with_feed_fields
from tidemark.sources.wire import decode_json, from_wire, to_wire

REGISTRY = Registry()
PROVIDERS = 2000
CORRECTIONS_FROM = 500


def _draw(number: str, field: str) -> str:
    return f"(('0x' || substr(md5('{DEFAULT_SALT}:{field}:' || {number}), 1, 8))::BIGINT)"


def _choice(number: str, field: str, options: list[str]) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"list_extract([{listed}], ({_draw(number, field)} % {len(options)} + 1)::INTEGER)"


def _feed_sql() -> str:
    from tidemark.sources import feed as f

    return f"""
WITH numbered AS (SELECT event_id + 1 AS seq FROM events),
drawn AS (SELECT seq, {_draw('seq', 'provider')} % {PROVIDERS} AS who FROM numbered)
SELECT CAST({f.KEY_BASE} + {_draw('who', 'npi')} % {f.KEY_RANGE} AS VARCHAR) AS npi,
  {_choice('seq', 'source', f.SOURCES)} AS source,
  {_choice('who', 'first', f.FIRST_NAMES)} AS first_name,
  {_choice('who', 'last', f.LAST_NAMES)} AS last_name,
  {_choice('who', 'cred', f.CREDENTIALS)} AS credential,
  {_choice('who', 'city', f.CITIES)} AS city,
  {_choice('who', 'state', f.STATES)} AS state,
  CAST({f.ZIP_BASE} + {_draw('who', 'zip')} % {f.ZIP_RANGE} AS VARCHAR) AS zip,
  {_choice('who', 'spec', f.SPECIALTIES)} AS specialty,
  {_choice('seq', 'net', f.NETWORK_STATUSES)} AS network_status,
  CASE WHEN seq >= {CORRECTIONS_FROM} THEN 2 ELSE 1 END AS revision, seq
FROM drawn"""


@REGISTRY.add("feed_generate", _feed_sql())
def feed_generate(spark, sf_dir):
    """A feed row for every event number."""
    numbers = read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"))
    return with_feed_fields(numbers, "seq", PROVIDERS, CORRECTIONS_FROM)


@REGISTRY.add(
    "feed_wire_roundtrip",
    "SELECT *, CAST(user_id AS VARCHAR) AS key FROM events",
)
def feed_wire_roundtrip(spark, sf_dir):
    """Every event as a wire line and back; the JSON inside survives."""
    events = read(spark, sf_dir, "events")
    lines = to_wire(events, "user_id")
    schema = T.StructType([f for f in events.schema.fields])
    return from_wire(lines, schema).withColumn("key", F.col("user_id").cast("string"))


@REGISTRY.add(
    "json_props_parse",
    """SELECT event_id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k,
              CAST(NULL AS VARCHAR) AS absent FROM events""",
)
def json_props_parse(spark, sf_dir):
    """Strict decoding: an absent field is NULL, a malformed record would fail."""
    schema = T.StructType([
        T.StructField("k", T.IntegerType()), T.StructField("absent", T.StringType())
    ])
    parsed = read(spark, sf_dir, "events").select(
        "event_id", decode_json(F.col("props"), schema).alias("p")
    )
    return parsed.select("event_id", "p.*")


@REGISTRY.add(
    "log_offsets",
    f'WITH {LOG_SQL} SELECT event_id, "partition", "offset" FROM log',
)
def log_offsets(spark, sf_dir):
    """The offset of every record in its log partition."""
    return log_of_events(spark, sf_dir).select("event_id", "partition", "offset")


@REGISTRY.add(
    "offset_lines",
    f"""WITH {LOG_SQL}, lines AS (
  SELECT "partition", CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN -1 ELSE "offset" END AS shown
  FROM log)
SELECT 'feed' AS topic, "partition", count(shown) AS kept,
       count(shown) FILTER (shown >= 0) AS kept_unsigned, max(shown) AS highest
FROM lines GROUP BY "partition" """,
)
def offset_lines(spark, sf_dir):
    """`topic:partition:offset` lines, some unreadable, read both ways."""
    shown = (
        F.when(F.col("event_type") == "error", F.lit("unknown"))
        .when(F.col("event_type") == "signup", F.lit("-1"))
        .otherwise(F.col("offset").cast("string"))
    )
    lines = log_of_events(spark, sf_dir).select(
        F.concat_ws(":", F.lit("feed"), F.col("partition"), shown).alias("line")
    )
    signed = logs.parse_offset_lines(lines, allow_negative=True)
    unsigned = logs.parse_offset_lines(lines, allow_negative=False)
    both = signed.withColumn("u", F.lit(0)).unionByName(unsigned.withColumn("u", F.lit(1)))
    return both.groupBy("topic", "partition").agg(
        F.count_if(F.col("u") == 0).alias("kept"), F.count_if(F.col("u") == 1).alias("kept_unsigned"),
        F.max("offset").alias("highest"),
    )


@REGISTRY.add("table_fingerprint")
def table_fingerprint(spark, sf_dir):
    """Order-insensitive digest of the feed (F13); the hash is Spark's own."""
    return audit.row_fingerprint(read(spark, sf_dir, "events"))


@REGISTRY.add(
    "table_digest",
    """SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', event_id, epoch_us(ts), user_id, event_type,
     printf('%.6f', value), props)), 1, 15) AS HUGEINT)) AS VARCHAR) AS digest FROM events""",
)
def table_digest(spark, sf_dir):
    """The feed's digest over a text of every column, which other engines can repeat."""
    events = read(spark, sf_dir, "events")
    text = F.concat_ws(
        "|", "event_id", micros("ts"), "user_id", "event_type", F.format_string("%.6f", "value"), "props"
    )
    return audit.text_digest(events, text)
