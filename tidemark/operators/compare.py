"""Judging runs against each other: claims over a noise floor, monotone claims, merged results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import Refused

WITHIN_NOISE, BELOW, ABOVE, AT_MOST = "within noise", "below", "above", "at most"


@dataclass(frozen=True)
class Claim:
    """A statement about measured runs.

    `within noise`, `below` and `above` compare a measure of `run` with that of `against`;
    `at most` holds a measure of `run`, or of every run where none is named, to `limit`.
    """

    text: str
    kind: str
    measure: str
    run: str | None = None
    against: str | None = None
    limit: float | None = None


def long_form(runs: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """(run, measure, value): one row for each number of each run."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return runs.select(F.col(key).alias("run"), F.explode(pairs).alias("m")).select("run", "m.measure", "m.value")


def judge_claims(measured: DataFrame, claims: list[Claim], repeats: list[tuple[str, str]]) -> DataFrame:
    """Each claim with what was found, what was allowed, and whether it holds.

    `repeats` names pairs of runs of one configuration. The most that any pair differs by in
    a measure is the measure's noise: differences no larger say nothing. A claim about a run
    or a measure that is not there is not judged, `holds` is NULL. Claims and runs are data:
    a table of a few rows each, joined.
    """
    spark = measured.sparkSession
    stated = spark.createDataFrame(
        [(c.text, c.kind, c.measure, c.run, c.against, c.limit) for c in claims],
        "claim string, kind string, measure string, run string, against string, allowed_at_most double")
    other = measured.select(F.col("run").alias("against"), "measure", F.col("value").alias("other"))
    noise = spark.createDataFrame(repeats, "run string, against string").join(measured, "run").join(
        other, ["against", "measure"]).groupBy("measure").agg(F.max(F.abs(F.col("value") - F.col("other"))).alias("noise"))
    greatest = measured.groupBy("measure").agg(F.max("value").alias("greatest"))
    side_by_side = stated.join(measured, ["run", "measure"], "left").join(other, ["against", "measure"], "left").join(
        noise, "measure", "left").join(greatest, "measure", "left")
    difference = F.col("value") - F.col("other")
    judged = side_by_side.withColumn("found", F.when(F.col("kind") != AT_MOST, difference).otherwise(
        F.when(F.col("run").isNull(), F.col("greatest")).otherwise(F.col("value"))))
    allowed = F.when(F.col("kind") == WITHIN_NOISE, F.col("noise")).when(F.col("kind") == AT_MOST, F.col("allowed_at_most"))
    holds = (
        F.when(F.col("kind") == WITHIN_NOISE, F.abs("found") <= F.col("noise")).when(F.col("kind") == BELOW, F.col("found") < 0)
        .when(F.col("kind") == ABOVE, F.col("found") > 0).when(F.col("kind") == AT_MOST, F.col("found") <= F.col("allowed_at_most")))
    return judged.select("claim", "kind", "measure", "found", allowed.alias("allowed"), holds.alias("holds"))


def monotone(runs: DataFrame, order: str, column: str, rising: bool, by: list[str] = ()) -> DataFrame:
    """Does `column` never fall (or never rise) along `order`?"""
    along = Window.partitionBy(*by).orderBy(order)
    previous = F.lag(column).over(along)
    step = F.col(column) >= previous if rising else F.col(column) <= previous
    return runs.withColumn("__ok", F.coalesce(step, F.lit(True))).groupBy(*by).agg(
        F.bool_and("__ok").alias("holds"), F.count(F.lit(1)).alias("runs")
    ).withColumn("claim", F.lit(f"{column} {'never falls' if rising else 'never rises'} along {order}"))


def ordered_listing(runs: DataFrame, order: str, text: Column, separator: str = ", ") -> DataFrame:
    """Runs in order as one sentence (O4). For a list short enough to be read."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), text.alias("t"))))
    return runs.agg(F.array_join(F.transform(pairs, lambda p: p["t"]), separator).alias("listing"))


def merge_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Newly measured parts replace, the others stay.

    One aggregation over both; a part that is new wins whole, NULL fields
    included, so a result never mixes two runs.
    """
    values = [c for c in old.columns if c not in keys]
    both = old.select(*keys, F.lit(0).alias("__v"), F.struct(*values).alias("__r")).unionByName(
        new.select(*keys, F.lit(1).alias("__v"), F.struct(*values).alias("__r"))
    )
    return both.groupBy(*keys).agg(F.max_by("__r", "__v").alias("__r")).select(*keys, "__r.*")


def one_configuration(configurations: DataFrame, **conditions) -> DataFrame:
    """The one row with the given values (P8); none or several is refused."""
    chosen = configurations
    for column, value in conditions.items():
        chosen = chosen.where(F.col(column).eqNullSafe(F.lit(value)))
    found = chosen.limit(2).collect()
    if len(found) != 1:
        raise Refused(f"{'several' if found else 'no'} configurations with {conditions}")
    return chosen
