"""Evidence: published figures derived again, and looked up where they are claimed."""

from __future__ import annotations

from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import plain_blanks, squash_whitespace
from tidemark.workspace import new_dir

# Fewer words than this leave a claim no whole word to look it up by.
MIN_WORDS = 3
# Whole words of the run that stands for a claim, or the greatest power of two that all claims have.
RUN = 4
# Places of the bit table that runs of documents are tried on.
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 18
# Short claims tried per pass over the documents.
SHORT_CLAIMS_PER_PASS = 200


def table_row(*cells: Column) -> Column:
    """Cells as one row of a published table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def facts(rows: DataFrame, tag: Column, text: Column) -> DataFrame:
    """Derived rows in long form."""
    return rows.select(tag.alias("tag"), text.alias("text"))


def union_facts(parts: list[DataFrame]) -> DataFrame:
    """The facts of several experiments, one below the other."""
    return reduce(DataFrame.unionByName, parts)


def find_claims(claims: DataFrame, documents: DataFrame, doc_id: str, body: str) -> DataFrame:
    """Does each claim occur in some document, white space aside?

    `claims` has `tag` and `text`; the result is every (tag, found). A claim of
    three words or more holds whole words between its first and last, and a
    document with the claim holds each run of them. Runs have one length for all
    claims, RUN words or fewer if the shortest claim has fewer. One pass over the documents
    finds which of the claims' runs each of them holds; a bit table drops all
    others before they leave their array. The pass also says how many documents
    hold a run, and each claim is looked up by its rarest: only documents with
    that run are read again and compared in full. A claim with a run that no
    document holds is answered by that. No cross join, nothing broadcast by
    force. Claims too short for a whole inner word are looked for in whole
    documents, some per pass.
    """
    spark = claims.sparkSession
    wanted = claims.select("tag", squash_whitespace(F.col("text")).alias("claim"))
    texts = documents.select(F.col(doc_id).alias("__doc"), F.col(body).alias("__body"))
    words = wanted.withColumn("words", F.split("claim", " "))
    long = words.where(F.size("words") >= MIN_WORDS)
    flat = squash_whitespace(F.col("__body"))
    found = wanted.select("claim").limit(0)

    inner = long.select("claim", F.expr("slice(words, 2, size(words) - 2)").alias("words")).distinct()
    shape = inner.agg(F.min(F.size("words")), F.sum(F.size("words"))).first()
    if shape[0] is not None:
        size = 1 << (min(RUN, shape[0]).bit_length() - 1)
        of_claims = _with_runs(inner, F.col("words"), size).select("claim", F.explode(F.array_distinct("runs")).alias("run")
        ).where("run is not null")
        bits = min(max(1 << (8 * shape[1] - 1).bit_length(), LEAST_BITS), MOST_BITS)
        table = _bit_table(of_claims, bits)
        body_words = F.array_remove(F.split(plain_blanks(F.col("__body")), " "), "")
        maybe = F.array_distinct(F.filter("runs", lambda run: _bit(table, run, bits)))
        held = _with_runs(_dealt(texts), body_words, size).select("__doc", F.explode(maybe).alias("run")).join(of_claims.select("run").distinct(), "run", "left_semi")
        path = new_dir(spark, "claims")
        held.write.parquet(path)
        held = spark.read.schema(held.schema).parquet(path)
        often = of_claims.join(held.groupBy("run").agg(F.count(F.lit(1)).alias("documents")), "run", "left")
        rarest = often.groupBy("claim").agg(
            F.min(F.struct(F.coalesce("documents", F.lit(0)).alias("documents"), "run")).alias("r")
        ).where("r.documents > 0").select("claim", F.col("r.run").alias("run"))
        pairs = held.join(rarest, "run").select("claim", "__doc").distinct()
        # white space is evened out for the texts of these pairs only
        found = pairs.join(texts, "__doc").where(F.contains(flat, "claim")).select("claim").distinct()

    short = words.where(F.size("words") < MIN_WORDS).select("claim").distinct()
    for claim_set in _passes(short):
        options = F.array(*[F.lit(c) for c in claim_set])
        whole = texts.select(flat.alias("__flat"))
        hits = F.filter(options, lambda c: F.contains(F.col("__flat"), c))
        found = found.unionByName(whole.select(F.explode(hits).alias("claim")).distinct())
    marked = found.withColumn("found", F.lit(True))
    return wanted.join(marked, "claim", "left").select(
        "tag", F.coalesce("found", F.lit(False)).alias("found")
    )


def _with_runs(rows: DataFrame, words: Column, size: int) -> DataFrame:
    """Rows with `runs`: one number for each run of `size` words, a power of two, and nulls for what begins too late.

    A run's number mixes those of its halves. Runs are compared in full later, so equal
    numbers may well be different runs.
    """
    out = rows.withColumn("runs", F.transform(words, lambda w: F.xxhash64(w)))
    half = 1
    while half < size:
        later = f"slice(runs, {half + 1}, size(runs))"
        out = out.withColumn("runs", F.expr(f"zip_with(runs, {later}, (a, b) -> a ^ shiftleft(b, {half}))"))
        half *= 2
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """A table read in fewer pieces than there are cores, dealt over all of them; a larger one as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _bit_table(runs: DataFrame, bits: int) -> Column:
    """A byte for each value of the lowest bits of `run`, 1 where a run has it: at most MOST_BITS places pass the driver."""
    table = bytearray(bits)
    for (place,) in runs.select(F.col("run").bitwiseAND(bits - 1).cast("int")).distinct().collect():
        table[place] = 1
    return F.lit(table)


def _bit(table: Column, run: Column, bits: int) -> Column:
    return F.substr(table, run.bitwiseAND(bits - 1).cast("int") + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))


def _passes(short: DataFrame):
    rows = (r["claim"] for r in short.toLocalIterator())
    while claim_set := list(islice(rows, SHORT_CLAIMS_PER_PASS)):
        yield claim_set


def claims_report(checked: DataFrame) -> DataFrame:
    """How many claims were derived, found and missing (E3): a check that
    derived nothing shows it."""
    return checked.agg(
        F.count(F.lit(1)).alias("derived"),
        F.count_if("found").alias("found"),
        F.count_if(~F.col("found")).alias("missing"),
    )


def require_claims(checked: DataFrame, at_least: int) -> DataFrame:
    """The report, refused when fewer claims were derived than there must be."""
    report = claims_report(checked)
    refusal = F.raise_error(F.concat(
        F.lit("only "), F.col("derived").cast("string"), F.lit(f" of {at_least} claims were derived")
    )).cast("long")
    return report.withColumn(
        "derived", F.when(F.col("derived") < at_least, refusal).otherwise(F.col("derived"))
    )
