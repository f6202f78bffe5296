"""Sessions as transactions, trees of digests, as-of over even blocks, claims by their rarest run."""

import random

from pyspark.sql import functions as F

from tidemark.operators import evidence, hash_tree, samples, sessions


def test_sessions_like_brute_force(spark):
    pick = random.Random(4)
    rows = [(pick.choice("aab"), pick.randrange(0, 400_000), pick.choice([60, 3000, 40_000])) for _ in range(300)]
    rows += [("c", 0, 100), ("c", 100, 100), ("c", 201, 5), ("c", 201, 5), ("d", 86_399, 2), ("d", 86_400, 2)]
    frame = spark.createDataFrame([*rows, ("e", None, 5)], "key string, s long, gap long").select(
        "key", F.timestamp_seconds("s").alias("at"), "gap")
    gap = F.concat(F.col("gap").cast("string"), F.lit(" seconds"))
    got = sessions.sessions(frame, "key", "at", gap).select(
        "key", F.unix_seconds("opened_at"), F.unix_seconds("last_at"), F.unix_seconds("open_until"), "records").collect()
    expected = []
    for key in "abcd":
        open_ = None
        for at, until in sorted((s, s + g) for k, s, g in rows if k == key):
            if open_ is not None and at <= open_[2]:
                open_ = [open_[0], at, max(open_[2], until), open_[3] + 1]
            else:
                if open_ is not None:
                    expected.append((key, *open_))
                open_ = [at, at, until, 1]
        expected.append((key, *open_))
    assert sorted(map(tuple, got)) == sorted(expected)


def test_states_of_sessions(spark):
    found = spark.createDataFrame([(0, 50, 60, 3), (0, 500, 510, 4), (0, 980, 1000, 5)], "a long, b long, u long, records long").select(
        F.timestamp_seconds("a").alias("opened_at"), F.timestamp_seconds("b").alias("last_at"), F.timestamp_seconds("u").alias("open_until"), "records")
    got = sessions.as_transactions(found, F.timestamp_seconds(F.lit(1000)), F.lit(100_000)).select("state", "lost").collect()
    assert sorted(map(tuple, got)) == [("CompleteAbort", 4), ("CompleteCommit", 0), ("Ongoing", 0)]


def made(spark, rows, blocks=10, fan=3):
    frame = spark.createDataFrame(rows, "seq long, text string").repartition(3)
    tree = hash_tree.tree(frame, "seq", F.col("text"), blocks, fan, levels=3)
    return tree.persist()


def test_trees_name_the_blocks_that_differ(spark):
    rows = [(i, f"row {i}") for i in range(95)]
    whole = made(spark, rows)
    assert hash_tree.differing_blocks(whole, made(spark, rows[::-1]), 3).count() == 0
    for other, places in (
        ([(i, "x" if i == 33 else t) for i, t in rows], [3]), (rows[:90], [9]), ([*rows, (40, "row 40")], [4]),
        ([*rows, (None, "lost")], [-1]), ([(i, None if i == 5 else t) for i, t in rows], [0]),
        ([(i + (i == 20) - (i == 21), t) for i, t in rows], [2]),
    ):
        got = sorted(r["place"] for r in hash_tree.differing_blocks(whole, made(spark, other), 3).collect())
        assert got == places
    assert whole.where("level = 2").count() == 2


def test_a_row_landed_many_times_is_one_line(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("seq"), F.lit("same").alias("text"))
    digest = hash_tree.block_digests(rows, "seq", F.col("text")).first()["digest"]
    assert digest == spark.sql("SELECT sha2('same x20000', 256) AS d").first()["d"]


def test_levels_for():
    assert [hash_tree.levels_for(n, 10, 4) for n in (0, 9, 10, 39, 40, 159, 160)] == [2, 2, 2, 2, 3, 3, 4]


def test_as_of_deals_a_crowded_hour_evenly(spark):
    crowd = spark.range(90_000).select((F.col("id") % 3600 + 36_000).cast("double").alias("s"), F.lit(1).alias("kind"))
    rest = spark.range(10_000).select((F.col("id") * 60).cast("double").alias("s"), F.lit(2).alias("kind"))
    facts = crowd.select(F.timestamp_seconds("s").alias("at"), F.col("s").alias("fact"))
    asked = crowd.union(rest).select(F.timestamp_seconds("s").alias("at"), F.col("s").alias("asked"), "kind")
    got = samples.as_of(asked, facts, "at", "at", ["fact"]).withColumn("task", F.spark_partition_id()).persist()
    expected = F.when(F.col("asked") < 36_000, F.lit(None)).otherwise(F.least("asked", F.lit(39_599.0)))
    assert got.count() == 100_000 and got.where(~F.col("fact").eqNullSafe(expected)).count() == 0
    walked = sorted(r["count"] for r in got.groupBy("task").count().collect())
    assert walked[-1] <= 2 * walked[len(walked) // 2]


def test_as_of_without_times_or_facts(spark):
    asked = spark.createDataFrame([(1, 5.0), (2, None)], "id long, s double").withColumn("at", F.timestamp_seconds("s"))
    facts = spark.createDataFrame([(None, "x"), (1.0, "y")], "s double, what string").withColumn("at", F.timestamp_seconds("s"))
    got = samples.as_of(asked, facts, "at", "at", ["what"])
    assert {r["id"]: r["what"] for r in got.collect()} == {1: "y", 2: None}
    assert samples.as_of(asked, facts.limit(0), "at", "at", ["what"]).where("what is not null").count() == 0


def test_claims_of_every_length(spark):
    body = "alpha beta  gamma delta epsilon\nzeta eta theta iota kappa lambda"
    claims = {
        "1": "lamb", "2": "eta  zeta", "2b": "ta ga", "3": "pha beta gam", "4": "beta gamma delta epsi", "7": "elta epsilon zeta eta theta iota kap",
        "no1": "omega", "no3": "alpha gamma beta", "no7": "beta gamma delta epsilon zeta theta eta", "null": None,
    }
    facts = spark.createDataFrame(list(claims.items()), "tag string, text string")
    docs = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "beta gamma"), (5, "gamma " * 500)], "id long, body string")
    got = {r["tag"]: r["found"] for r in evidence.find_claims(facts, docs, "id", "body").collect()}
    assert {t for t, f in got.items() if f} == {"1", "2b", "3", "4", "7"}
