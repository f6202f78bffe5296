"""Published lines rendered from results, and looked up where they are claimed."""

import pytest
from pyspark.sql import functions as F

from tidemark.errors import Refused
from tidemark.operators import evidence, published


def texts(frame):
    return {r["tag"]: r["text"] for r in frame.collect()}


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    """What the given orders say of every status."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("price"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("top"),
    ).withColumn("many", F.col("n") > 100)


def test_every_form(orders):
    got = texts(published.lines(
        orders, "status:{o_orderstatus}", "| {o_orderstatus} | {n:,} | {price:.2f} | {top:.1f|none} | {many:many/few} |"
    ))
    rows = orders.collect()
    assert len(got) == len(rows)
    for r in rows:
        top = "none" if r["top"] is None else f"{r['top']:.1f}"
        many = "many" if r["many"] else "few"
        assert got[f"status:{r['o_orderstatus']}"] == f"| {r['o_orderstatus']} | {r['n']:,} | {r['price']:.2f} | {top} | {many} |"


def test_words_and_plain_text(spark):
    frame = spark.createDataFrame([(2,), (1234567,)], "n long")
    assert set(texts(published.lines(frame, "{n}", "{n:word} rows")).values()) == {"two rows", "1,234,567 rows"}
    assert texts(published.lines(frame.limit(1), "all", "no field"))["all"] == "no field"


def test_a_gap_is_refused(orders):
    with pytest.raises(Exception, match="no value"):
        published.lines(orders, "x:{o_orderstatus}", "{top:.1f}").collect()
    with pytest.raises(Refused):
        published.cell(F.col("n"), "roman")


def test_ratio(orders):
    row = published.ratio(orders, "o_orderstatus", "n", "F", "O").first()
    n = {r["o_orderstatus"]: r["n"] for r in orders.collect()}
    assert row["times"] == pytest.approx(n["F"] / n["O"])


def test_an_altered_figure_is_missed(spark, orders):
    facts = published.lines(orders, "status:{o_orderstatus}", "| status {o_orderstatus} | {n:,} orders at {price:.2f} |")
    right = "\n".join(r["text"] for r in facts.orderBy("tag").collect())
    price = f"{orders.first()['price']:.2f}"
    for body, missing in ((right, 0), (right.replace(price, "0.01"), 1)):
        document = spark.createDataFrame([(1, "# Results\n\n" + body + "\n")], "id int, body string")
        checked = evidence.find_claims(facts, document, "id", "body")
        assert evidence.require_claims(checked, orders.count()).first()["missing"] == missing
