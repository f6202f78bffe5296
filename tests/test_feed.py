import hashlib
import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.sources import feed, log, wire

# The digests of two reference feeds. They hold for the salt those feeds were
# made with, which is handed in from outside.
PINNED = [
    (50, 10, "6521342db1ea47a76e48446ea125ac51be1fb3eb49ce229216904925c6191066"),
    (1000, 200, "c2fae09330cf7109cb64c24626c7e4a1f26c5723f635c4e7a67626838549f8b5"),
]


def draw(n, field, salt=feed.DEFAULT_SALT):
    return int(hashlib.md5(f"{salt}:{field}:{n}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("events,providers,digest", PINNED)
def test_pinned_feeds_are_reproduced(spark, events, providers, digest):
    salt = os.environ.get("FEED_SALT")
    if not salt:
        pytest.skip("FEED_SALT is not set")
    rows = feed.generate_feed(spark, events, providers=providers, salt=salt)
    lines = wire.to_wire(rows.orderBy("seq"), "npi").collect()
    text = "".join(r["line"] + "\n" for r in lines)
    assert hashlib.sha256(text.encode()).hexdigest() == digest


def test_feed_rows_follow_from_their_number(spark):
    rows = feed.generate_feed(spark, 300, start=5, providers=40, corrections_from=200).collect()
    assert len(rows) == 300
    for r in rows:
        who = draw(r["seq"], "provider") % 40
        assert r["npi"] == str(1_000_000_000 + draw(who, "npi") % 900_000_000)
        assert r["zip"] == str(70_000 + draw(who, "zip") % 29_999)
        assert r["city"] == feed.CITIES[draw(who, "city") % 6]
        assert r["source"] == feed.SOURCES[draw(r["seq"], "source") % 4]
        assert r["revision"] == (2 if r["seq"] >= 200 else 1)


def test_two_runs_give_the_same_feed_and_keys_recur(spark):
    first, second = (feed.generate_feed(spark, 500, providers=50) for _ in range(2))
    assert first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()
    assert first.select("npi").distinct().count() < 250
    assert feed.FEED_SCHEMA.names == first.columns


def test_distinct_providers_have_distinct_keys(spark):
    ids = spark.range(2000).select(feed.provider_key(F.col("id")).alias("npi"))
    assert ids.distinct().count() == 2000


def test_wire_lines_split_at_the_first_separator(spark):
    rows = spark.createDataFrame([("k1", "a|b"), ("k2", "")], "key string, text string")
    lines = wire.to_wire(rows, "key")
    assert {r["line"] for r in lines.collect()} == {
        'k1|{"key":"k1","text":"a|b"}', 'k2|{"key":"k2","text":""}'
    }
    assert wire.from_wire(lines, rows.schema).exceptAll(rows).isEmpty()
    body = json.loads(wire.split_wire(lines).where("key = 'k1'").first()["value"])
    assert body["text"] == "a|b"


def test_absent_fields_are_null_and_malformed_records_fail(spark):
    lines = spark.createDataFrame([('k|{"key":"k"}',)], "line string")
    row = wire.from_wire(lines, spark.createDataFrame([], "key string, n int").schema).first()
    assert row["key"] == "k" and row["n"] is None
    broken = spark.createDataFrame([('k|{"key":',)], "line string")
    with pytest.raises((PySparkException, Py4JJavaError)):
        wire.from_wire(broken, spark.createDataFrame([], "key string, n int").schema).collect()


def test_a_key_stays_in_one_partition_and_in_order(spark, work):
    rows = feed.generate_feed(spark, 400, providers=30)
    log.produce(rows, f"{work}/log", "npi", "seq", partitions=4, files=6)
    landed = log.read_log(spark, f"{work}/log")
    assert landed.groupBy("key").agg(F.countDistinct("partition").alias("n")).where("n > 1").isEmpty()
    seqs = landed.withColumn("seq", F.get_json_object("value", "$.seq").cast("long")).collect()
    for part in range(4):
        mine = sorted((r for r in seqs if r["partition"] == part), key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == list(range(len(mine)))
        assert [r["seq"] for r in mine] == sorted(r["seq"] for r in mine)


def test_appending_to_a_log_goes_on_where_it_ended(spark, work):
    path = f"{work}/log"
    log.produce(feed.generate_feed(spark, 100, providers=30), path, "npi", "seq")
    before = log.pin(log.end_offsets(log.read_log(spark, path)))
    log.produce(feed.generate_feed(spark, 60, start=101, providers=30), path, "npi", "seq")
    after = log.end_offsets(log.read_log(spark, path))
    assert log.require_landed(before, after, 60) == 60
    assert log.read_log(spark, path).groupBy("partition", "offset").count().where("count > 1").isEmpty()


def test_a_log_that_grew_short_is_refused(spark):
    before = spark.createDataFrame([(0, 10)], "partition int, end_offset long")
    after = spark.createDataFrame([(0, 12), (1, 1)], "partition int, end_offset long")
    with pytest.raises(Refused, match="produced 3 records, expected 5"):
        log.require_landed(before, after, 5)
    assert log.require_landed(before, after, 3) == 3


def test_offsets_are_dense_over_small_blocks(spark):
    rows = spark.range(1000).select(
        (F.col("id") * 7 + 3).alias("seq"), (F.col("id") % 3 == 0).cast("int").alias("partition")
    )
    numbered = log.with_offsets(rows, "partition", "seq", block=64).collect()
    for part in (0, 1):
        mine = sorted((r for r in numbered if r["partition"] == part), key=lambda r: r["seq"])
        assert [r["offset"] for r in mine] == list(range(len(mine)))


def test_offset_lines(spark):
    lines = spark.createDataFrame(
        [("t:0:12",), ("t:1:-1",), ("t:2:none",), ("noise",), (" t:3:7 ",)], "line string"
    )
    signed = {(r["partition"], r["offset"]) for r in log.parse_offset_lines(lines).collect()}
    assert signed == {(0, 12), (1, -1), (3, 7)}
    unsigned = {r["partition"] for r in log.parse_offset_lines(lines, allow_negative=False).collect()}
    assert unsigned == {0, 3}
    group = spark.createDataFrame(
        [("GROUP TOPIC PARTITION OFFSET END",), ("g t 0 5 9",), ("g t 1 - 9",), ("h t 0 5 9",)], "line string"
    )
    assert [tuple(r) for r in log.parse_group_lines(group, "g").collect()] == [("t", 0, 5)]


def test_known_ends_are_not_looked_up_again(spark, work):
    rows = feed.generate_feed(spark, 50, start=11, providers=10)
    log.produce(rows, f"{work}/log", "npi", "seq", partitions=2, ends={0: 100, 1: 200})
    starts = log.read_log(spark, f"{work}/log").groupBy("partition").agg(F.min("offset").alias("o"))
    assert {(r["partition"], r["o"]) for r in starts.collect()} == {(0, 100), (1, 200)}


def test_a_hot_key_is_spread_and_stays_in_order(spark, work):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"),
        F.col("id").alias("seq"),
    )
    files = log.produce(rows, f"{work}/log", "key", "seq", partitions=4, files=8, block=128)
    landed = log.read_log(spark, f"{work}/log")
    hot = landed.where("key = 'hot'").select(
        "offset", F.get_json_object("value", "$.seq").cast("long").alias("seq"), F.input_file_name().alias("f")
    )
    assert hot.select("f").distinct().count() > 1 and files > 1
    ordered = [r["seq"] for r in hot.orderBy("offset").collect()]
    assert ordered == sorted(ordered) and len(ordered) == 2000
