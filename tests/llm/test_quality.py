import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


def slow(text):
    raw = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", raw)
    lines = [line for line in raw.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", raw)), len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def texts():
    pick = random.Random(6)
    out = []
    for _ in range(120):
        words = [pick.choice(["ab", "cd", "é\xa0f", "#x", "LOUD", "g...", "…", "-"]) for _ in range(pick.randint(0, 60))]
        text = "".join(w + pick.choice([" ", "\n", "  ", "\t", "\x0b", "\r\n"]) for w in words)
        if pick.random() < 0.5:
            text += pick.choice(["\n", " "]) + text[: pick.randint(0, len(text))]
        out.append(text)
    return out + [None, "", " \n ", "a b c d e f g h " * 3, "x " * 20000, " ".join("w%d" % i for i in range(20000)), "one two three four five six seven eight nine " * 2]


@pytest.fixture(scope="module")
def rows(spark):
    rows = [(i, t, "words", 1) for i, t in enumerate(texts())] + [(None, "a b", None, None), (3, texts()[3], "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, id int")


def test_like_brute_force_and_sql(spark, rows):
    out = quality.judge(rows)
    got = sorted(map(tuple, out.collect()), key=str)
    want = sorted(((r.doc_id, *slow(r.text)) for r in rows.collect()), key=str)
    assert [g[:-1] for g in got] == want
    db = duckdb.connect()
    documents = rows.toPandas()  # noqa: F841 - read by name
    theirs = db.execute(quality.SQL).fetchall()
    assert sorted(theirs, key=str) == got
    assert any(g[-1] for g in got) and any(not g[-1] and not g[-2] for g in got)


def test_order_changes_no_verdict(spark, rows):
    rules = quality.default_rules()
    one = sorted(map(tuple, quality.judge(rows, rules, sample_rows=1).collect()), key=str)
    other = quality.measured(rows).withColumn("base_failed", quality.failed_base())
    other = other.select("id", (~F.col("base_failed") & quality.cascade(rules[::-1])).alias("kept"))
    assert sorted(((r[0], r[-1]) for r in one), key=str) == sorted(map(tuple, other.collect()), key=str)


def test_the_best_rejection_per_cost_comes_first(spark):
    sample = spark.range(20000).select(F.col("id").alias("n_words"))
    never = quality.Rule("never", F.col("n_words") < 0)
    often = quality.Rule("often", F.col("n_words") > 10)
    assert [r.name for r in quality.in_order(sample, [never, often])] == ["often", "never"]


def test_native_and_empty(spark, rows):
    out = quality.judge(rows)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality.judge(rows.limit(0)).count() == 0
