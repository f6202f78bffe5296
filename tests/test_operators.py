"""Lag, layout, samples, storage, isolation, comparison, evidence, lines."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.errors import Refused
from tidemark.operators import (
    compare, evidence, isolation, lag, layout, lines, samples, storage_audit,
)
from tidemark.sources import kafka


# -- lag ---------------------------------------------------------------------------

def offsets(spark, pairs, name):
    return spark.createDataFrame(pairs, f"partition int, {name} long")


def test_no_committed_offset_is_no_lag(spark):
    ends = offsets(spark, [(0, 4000), (1, 4000)], "end_offset")
    assert lag.consumer_lag(offsets(spark, [], "offset"), ends).first()[0] is None
    assert lag.consumer_lag(offsets(spark, [(0, 4000), (1, 4000)], "offset"), ends).first()[0] == 0
    # a partition nobody committed for does not count, an unknown end counts as 0
    assert lag.consumer_lag(offsets(spark, [(0, 1000)], "offset"), ends).first()[0] == 3000
    assert lag.consumer_lag(offsets(spark, [(7, 10)], "offset"), ends).first()[0] == -10


def test_lag_is_not_staleness(spark):
    ends = offsets(spark, [(0, 300)], "end_offset")
    seen = spark.createDataFrame([(100,)], "rows_visible long")
    row = lag.lag_and_staleness(offsets(spark, [(0, 300)], "offset"), ends, seen).first()
    assert row["consumer_lag"] == 0 and row["rows_behind"] == 200


# -- layout ------------------------------------------------------------------------

def test_files_summary_counts_deletes_apart(spark):
    files = spark.createDataFrame(
        [("a", 10, 1, 0), ("b", 15, 1, 0), ("c", 7, 1, 1), ("d", 5, 1, 2)],
        "file_path string, file_size_in_bytes long, record_count long, content int",
    )
    row = layout.files_summary(files).first()
    assert tuple(row) == (2, 2, 25, 12, 12)
    assert layout.files_summary(files.where("content > 0")).first()["avg_data_file_bytes"] == 0
    assert tuple(layout.files_summary(files.where("false")).first()) == (0, 0, 0, 0, 0)


def history(spark, rows):
    return spark.createDataFrame(rows, "committed_at timestamp_ntz, summary map<string,string>").withColumn(
        "committed_at", F.col("committed_at")
    )


def test_watermark_is_the_newest_snapshots_or_null(spark):
    import datetime as dt

    at = [dt.datetime(2024, 1, n) for n in (1, 2, 3)]
    key = layout.WATERMARK_KEY
    full = history(spark, [(at[0], {key: "4"}), (at[1], {key: "5"})])
    assert layout.newest_watermark(full).first()["watermark"] == 5
    bare = history(spark, [(at[0], {key: "4"}), (at[2], {"other": "x"})])
    assert layout.newest_watermark(bare).first()["watermark"] is None
    assert layout.newest_watermark(full.where("false")).first()["watermark"] is None
    added = history(spark, [(at[0], {"added-data-files": "2"}), (at[1], {})])
    row = layout.commit_layout(added).first()
    assert (row["commits"], row["data_files"], row["files_per_commit"], row["min_files_in_one_commit"]) == (2, 2, 1.0, 0)


# -- samples -----------------------------------------------------------------------

# The polls of a recorded run, its times, checkpoint ids, and row counts before and after id 19.
SECONDS = [0.0, 7.2, 14.5, 21.7, 29.2, 36.4, 43.6, 50.9, 58.1, 65.4]
IDS = [7, 9, 10, 12, 13, 14, 16, 17, 19, 20]


def timeline(spark, lags=None, watermark=19):
    rows = [
        (s, i, watermark, 16000 if i <= 19 else 32000, "RUNNING", 1, (lags or {}).get(s, 0))
        for s, i in zip(SECONDS, IDS)
    ]
    return spark.createDataFrame(
        rows, "seconds double, checkpoint_id long, watermark long, rows_visible long,"
        "job_state string, checkpoints_failed long, consumer_lag long",
    )


def test_freeze_window_of_the_recorded_timeline(spark):
    row = samples.freeze_window(timeline(spark)).first()
    assert row["frozen_samples"] == 9 and row["seconds_frozen"] == 58.1
    assert row["rows_while_frozen"] == [16000] and row["rows_in_one_lump"] == 16000
    assert row["never_moved"] and row["min_consumer_lag_while_frozen"] == 0
    assert row["job_states_while_frozen"] == ["RUNNING"]
    assert row["checkpoints_failed_while_frozen"] == 1 and row["rows_at_clear"] == 32000
    bounds = samples.freeze_bounds(timeline(spark)).first()
    assert (bounds["last_frozen"], bounds["first_clear"], bounds["first_id_above"]) == (58.1, 65.4, 20)
    assert bounds["ids_below_watermark"] == 13 and bounds["boundary_holds"]
    gaps = samples.poll_gaps(timeline(spark).withColumn("run", F.lit(1)), ["run"]).first()
    assert (gaps["gaps"], gaps["typical_gap"]) == (9, 7.2)


def test_an_unread_lag_inside_the_freeze_is_refused(spark):
    with pytest.raises(PySparkException, match="29.2"):
        samples.freeze_window(timeline(spark, {29.2: None})).collect()
    assert samples.freeze_window(timeline(spark, {65.4: None})).first()["frozen_samples"] == 9


def test_nothing_frozen(spark):
    row = samples.freeze_window(timeline(spark, watermark=3)).first()
    assert row["frozen_samples"] == 0 and row["seconds_frozen"] == 0.0
    assert row["min_consumer_lag_while_frozen"] is None and not row["never_moved"]
    assert row["rows_in_one_lump"] == 0 and row["checkpoints_failed_while_frozen"] == 0


def polls(spark, counts):
    return spark.createDataFrame(
        [("r", float(i), c) for i, c in enumerate(counts)], "run string, seconds double, rows_visible long"
    )


def settle(spark, counts, quiet=2):
    row = samples.settled_at(polls(spark, counts), ["run"], quiet, 10, 5).first()
    return row["settled_at"], row["settled_rows"]


def test_settling_needs_repeats_and_a_table(spark):
    assert settle(spark, [1, 5, 5, 5, 9, 9, 9]) == (3.0, 5)
    assert settle(spark, [1, 5, 5, 6, 6]) == (None, None)
    assert settle(spark, [None, None, None, None]) == (None, None)
    assert settle(spark, [5, 5, None, 5, 5, 5]) == (5.0, 5)
    with pytest.raises(Refused, match="commit interval"):
        samples.settled_at(polls(spark, [1]), ["run"], 3, 3, 10)


def test_as_of_walks_over_empty_buckets_and_ties(spark):
    def at(df):
        return df.withColumn("at", F.timestamp_seconds("s"))

    asked = at(spark.createDataFrame([(n, float(n)) for n in (1, 10, 11, 5000, 5001, 99999)], "id long, s double"))
    known = at(spark.createDataFrame([(10.0, "a"), (5000.0, "b"), (5000.5, "c")], "s double, what string"))
    got = samples.as_of(asked, known.select("at", "what"), "at", "at", ["what"], blocks=5)
    assert {r["id"]: r["what"] for r in got.collect()} == {
        1: None, 10: "a", 11: "a", 5000: "b", 5001: "c", 99999: "c"
    }


# -- storage -----------------------------------------------------------------------

def objects(spark, rows):
    return spark.createDataFrame(rows, "path string, length long")


def files(spark, names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def test_storage_against_catalog(spark):
    listing = objects(spark, [
        ("s/t/data/a.parquet", 5), ("s/t/data/b.parquet", 7), ("s/t/metadata/m.json", 1),
        ("s/t2/data/c.parquet", 9),
    ])
    mine = storage_audit.table_objects(listing, "s/t")
    row = storage_audit.storage_vs_catalog(mine, files(spark, ["x://s/t/data/a.parquet"])).first()
    assert tuple(row) == (3, 2, 1, 1, 7)
    loose = storage_audit.unreferenced(mine, files(spark, ["x://s/t/data/a.parquet"]))
    assert [r["path"] for r in loose.collect()] == ["s/t/data/b.parquet"]


def test_a_listing_that_sees_nothing_is_refused(spark):
    with pytest.raises(PySparkException, match="not the listing"):
        storage_audit.storage_vs_catalog(objects(spark, []), files(spark, ["a.parquet"])).collect()
    empty = storage_audit.storage_vs_catalog(objects(spark, []), files(spark, [])).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)


# -- isolation ---------------------------------------------------------------------

def test_isolation_gap_and_visibility(spark):
    records = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 3), ("t9", 4)], "txn_id string, n long")
    states = spark.createDataFrame(
        [("t1", isolation.COMMITTED), ("t2", isolation.ABORTED)], "txn_id string, state string"
    )
    assert {r["n"] for r in isolation.read_committed(records, states).collect()} == {1, 2}
    assert tuple(isolation.isolation_counts(records, states).first()) == (4, 2, 2)


def test_newest_marker_by_prefix(spark):
    markers = spark.createDataFrame([
        ("job-a-1", "Ongoing", 5000, 0), ("job-a-1", "CompleteAbort", 5000, 1), ("job-b-1", "Ongoing", 9, 0),
    ], "txn_id string, state string, timeout_ms int, version long")
    got = [tuple(r) for r in isolation.latest_states(markers, "job-a-").collect()]
    assert got == [("job-a-1", "CompleteAbort", 5000)]


def test_timeout_rule():
    isolation.check_timeout_rule(10_000, 1_000, 1_000, 60_000, 900_000)
    with pytest.raises(Refused):
        isolation.check_timeout_rule(120_000, 0, 0, 5_000, 900_000)
    with pytest.raises(Refused):
        isolation.check_timeout_rule(1_000, 0, 0, 1_000_000, 900_000)


def test_sample_summary_and_findings(spark):
    polled = spark.createDataFrame(
        [("r", ["Ongoing"], 1, [5000]), ("r", ["CompleteAbort", "Ongoing"], 0, [5000]), ("r", [], 0, [])],
        "run_key string, states array<string>, ongoing int, timeouts array<int>",
    )
    row = isolation.summarise_samples(polled, ["run_key"]).first()
    assert row["samples_taken"] == 3 and row["samples_with_one_ongoing"] == 1
    assert row["states_observed"] == ["CompleteAbort", "Ongoing"] and row["timeouts_registered"] == [5000]
    runs = spark.createDataFrame(
        [("short", 8000, 0), ("long", 8000, 8000)], "run_key string, events_in long, records_readable long"
    )
    assert tuple(isolation.timeout_findings(runs, "short", "long").first()) == (8000, 0, 8000)


# -- comparison --------------------------------------------------------------------

def judged(spark, rows, claims, repeats):
    frame = spark.createDataFrame([(k, *v) for k, v in rows.items()], "run string, files long, wait double")
    found = compare.judge_claims(compare.long_form(frame, "run", ["files", "wait"]), claims, repeats).collect()
    return {r["claim"]: (r["found"], r["allowed"], r["holds"]) for r in found}


def test_claims_are_judged_over_the_noise_of_repeats(spark):
    rows = {"a": (50, 2.0), "a again": (47, 2.5), "b": (52, 2.25), "c": (9, 31.0), "c again": (9, 30.0)}
    claims = [
        compare.Claim("same files", compare.WITHIN_NOISE, "files", "b", "a"), compare.Claim("same wait", compare.WITHIN_NOISE, "wait", "c", "a"),
        compare.Claim("fewer", compare.BELOW, "files", "c", "a"), compare.Claim("sooner", compare.BELOW, "wait", "c", "a"),
        compare.Claim("more", compare.ABOVE, "files", "b", "a"), compare.Claim("all bounded", compare.AT_MOST, "files", limit=51.0),
        compare.Claim("one bounded", compare.AT_MOST, "files", "c", limit=9.0), compare.Claim("unknown", compare.BELOW, "files", "z", "a"),
    ]
    got = judged(spark, rows, claims, [("a", "a again"), ("c", "c again")])
    assert got == {
        "same files": (2.0, 3.0, True), "same wait": (29.0, 1.0, False), "fewer": (-41.0, None, True), "sooner": (29.0, None, False),
        "more": (2.0, None, True), "all bounded": (52.0, 51.0, False), "one bounded": (9.0, 9.0, True), "unknown": (None, None, None),
    }
    # without a repeat nothing can be told from noise
    assert judged(spark, rows, claims[:1], [("a", "missing")])["same files"] == (2.0, None, None)


def test_monotone_claims(spark):
    frame = spark.createDataFrame([(5, 78), (30, 16), (120, 6)], "s long, files long")
    assert compare.monotone(frame, "s", "files", rising=False).first()["holds"]
    assert not compare.monotone(frame, "s", "files", rising=True).first()["holds"]


def test_merge_keeps_what_was_not_measured_and_never_mixes(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n long, t string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, "z")], "k string, n long, t string")
    got = {tuple(r) for r in compare.merge_results(old, new, ["k"]).collect()}
    assert got == {("a", 1, "x"), ("b", 3, None), ("c", 4, "z")}


# -- evidence ----------------------------------------------------------------------

def test_claims_are_found_across_line_wraps_and_inside_words(spark):
    docs = spark.createDataFrame(
        [(1, "the table   did not\nmove for 58.1 seconds"), (2, "landed 112,000 rows, all of them")],
        "id long, body string",
    )
    claims = {
        "wrapped": "did not move for 58.1", "half words": "able did not mov", "inner digits": "12,000 rows, all",
        "two words": "12,000 rows", "one word": "58.1", "absent": "did not move for 58.2",
        "reordered": "move not did for", "whole": "the table did not move for 58.1 seconds", "short absent": "59.1",
        "across documents": "58.1 seconds landed",
    }
    facts = spark.createDataFrame(list(claims.items()), "tag string, text string")
    got = {r["tag"]: r["found"] for r in evidence.find_claims(facts, docs, "id", "body").collect()}
    assert {t for t, found in got.items() if not found} == {
        "absent", "reordered", "short absent", "across documents"
    }
    assert len(got) == len(claims)
    report = evidence.claims_report(evidence.find_claims(facts, docs, "id", "body")).first()
    assert tuple(report) == (10, 6, 4)


def test_a_check_that_derived_nothing_is_refused(spark):
    none = spark.createDataFrame([], "tag string, found boolean")
    with pytest.raises(PySparkException, match="only 0 of 27"):
        evidence.require_claims(none, 27).collect()


def test_published_formats(spark):
    row = spark.range(1).select(
        evidence.table_row(F.lit("`5s`"), fn.thousands(F.lit(13259)), F.lit("x")).alias("row"),
        fn.number_word(F.lit(3)).alias("three"), fn.number_word(F.lit(1234)).alias("many"),
        fn.duration_ms(F.lit("5s")).alias("s"), fn.duration_ms(F.lit("300ms")).alias("ms"),
        fn.duration_ms(F.lit("2m")).alias("m"), fn.duration_ms(F.lit("soon")).alias("none"),
        F.round(fn.zero_event_bound(F.lit(1)), 2).alias("bound"),
    ).first()
    assert tuple(row) == ("| `5s` | 13,259 | x |", "three", "1,234", 5000, 300, 120000, None, 0.95)


# -- lines -------------------------------------------------------------------------

def test_noise_goes_and_errors_stay(spark):
    def clean(text):
        frame = spark.createDataFrame([(text,)], "t string")
        return frame.select(lines.clean_lines(F.col("t"), lines.TERMINAL_NOISE)).first()[0]

    assert clean("WARNING: no terminal\norg.jline.utils.Log\n1000\n\n") == "1000"
    assert clean("org.jline noise\r\nQuery failed: no table\n  \n") == "Query failed: no table"
    assert clean("\x1b[34;1m[INFO] done\x1b[0m") == "[INFO] done"


def test_failure_causes_are_the_first_five(spark):
    rows = [(i, "" if i % 2 else f"E{i}", f"trace {i}\nat x") for i in range(9)]
    failures = spark.createDataFrame(rows, "seen long, exception_name string, stacktrace string")
    got = [r["cause"] for r in lines.failure_causes(failures, "seen").collect()]
    assert got == ["E0", "trace 1", "E2", "trace 3", "E4"]


def test_kafka_options():
    assert kafka.starting_offsets("t", "earliest-offset") == "earliest"
    assert kafka.starting_offsets("t", "group-offsets", {1: 5, 0: 3}) == '{"t": {"0": 3, "1": 5}}'
    with pytest.raises(Refused):
        kafka.starting_offsets("t", "group-offsets", {})


def test_kafka_without_its_connector_is_refused(spark):
    with pytest.raises(Refused, match="class path"):
        kafka.read_topic(spark, "localhost:1", "t")


def test_settings_follow_data_and_cluster():
    from tidemark.session import settings_for

    small, large = settings_for(10 << 20, 8), settings_for(100 << 40, 4000)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert large["spark.sql.shuffle.partitions"] == str((100 << 40) // (128 << 20))
