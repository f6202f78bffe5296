import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import audit


def seqs(spark, values):
    return spark.createDataFrame([(v,) for v in values], "seq long")


def gaps(rows, lo, hi):
    """Brute force over the whole range."""
    found, run = [], None
    present = set(rows)
    for n in range(lo, hi + 2):
        absent = n <= hi and n not in present
        if absent:
            run = (run[0], n) if run else (n, n)
        elif run:
            found.append(run)
            run = None
    return found


def runs_of(frame):
    return sorted((r["run_start"], r["run_end"]) for r in frame.collect())


@pytest.mark.parametrize("values,extra", [
    ([1, 1, 1, 2], 2), ([], 0), ([1, 2, 3], 0), (list(range(1, 6001)) * 2, 6000),
])
def test_duplicates_are_extra_rows(spark, values, extra):
    row = audit.seq_counts(seqs(spark, values)).first()
    assert (row["rows"], row["duplicate_seq_rows"]) == (len(values), extra)


@pytest.mark.parametrize("values,lo,hi,expected", [
    ([1, 2, 6, 7], 1, 7, [(3, 5)]),
    (list(range(1, 8001)) + list(range(12001, 16001)), 1, 16000, [(8001, 12000)]),
    ([1, 3, 5], 1, 5, [(2, 2), (4, 4)]),
    ([1, 2, 3], 1, 3, []),
    ([1, 2], 1, 5, [(3, 5)]),
    ([1, 1, 1, 4], 1, 4, [(2, 3)]),
    ([], 1, 3, [(1, 3)]),
    ([1], 1, 1, []),
    ([1], 5, 4, []),
    ([1, 1, 1, 4, 7], 1, 9, [(2, 3), (5, 6), (8, 9)]),
])
def test_missing_runs(spark, values, lo, hi, expected):
    assert runs_of(audit.missing_runs(seqs(spark, values), lo, hi)) == expected


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.integers(-3000, 9000), max_size=120),
    lo=st.integers(-500, 500), width=st.integers(-1, 8000),
)
def test_runs_and_profile_agree_with_brute_force_at_every_depth(spark, values, lo, width):
    hi = lo + width
    rows = seqs(spark, values)
    expected = gaps(values, lo, hi)
    for shape in ({}, {"top_words": 2, "fan_bits": 2}):
        assert runs_of(audit.missing_runs(rows, lo, hi, **shape)) == expected
        profile = audit.seq_profile(rows, lo, hi, **shape).first()
        assert profile["rows"] == len(values)
        assert profile["duplicate_seq_rows"] == len(values) - len(set(values))
        assert profile["missing_runs"] == len(expected)
        assert profile["missing_seqs"] == sum(b - a + 1 for a, b in expected)


def test_sparse_sequence_numbers(spark):
    values = [0, 1 << 40, (1 << 40) + 1, 1 << 50]
    assert runs_of(audit.missing_runs(seqs(spark, values), 0, 1 << 50)) == [
        (1, (1 << 40) - 1), ((1 << 40) + 2, (1 << 50) - 1)
    ]


def test_append_verdict_rejects_copies_and_gaps(spark):
    whole = list(range(1, 101))
    assert audit.append_verdict(seqs(spark, whole), 1, 100).first()["complete"]
    copied = audit.append_verdict(seqs(spark, whole[:-1] + [99]), 1, 100).first()
    assert not copied["complete"] and copied["duplicate_seq_rows"] == 1
    short = audit.append_verdict(seqs(spark, [n for n in whole if n not in (40, 41, 42)]), 1, 100).first()
    assert not short["complete"] and (short["missing_runs"], short["missing_seqs"]) == (1, 3)
    beyond = audit.append_verdict(seqs(spark, whole + [500]), 1, 100).first()
    assert not beyond["complete"]


HELD = [("a", 10), ("b", 7), ("c", 9)]


@pytest.mark.parametrize("held,complete,field,value", [
    (HELD, True, "keys_not_latest", 0),
    (HELD[:2], False, "keys_missing", 1),
    ([("a", 10), ("b", 3), ("c", 9)], False, "keys_not_latest", 1),
    (HELD + [("a", 2)], False, "duplicate_key_rows", 1),
    (HELD + [("z", 1)], False, "keys_not_latest", 1),
])
def test_upsert_verdict(spark, held, complete, field, value):
    expected = spark.createDataFrame(HELD, "key string, latest_seq long")
    rows = spark.createDataFrame(held, "key string, seq long")
    row = audit.upsert_verdict(rows, expected, "key", "seq").first()
    assert row["complete"] is complete and row[field] == value


def test_expected_state_is_the_last_assertion(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 5), ("a", 3)], "key string, seq long")
    state = {r["key"]: (r["latest_seq"], r["assertions"]) for r in
             audit.expected_state(rows, "key", "seq").collect()}
    assert state == {"a": (5, 3), "b": (2, 1)}
    assert {tuple(r) for r in audit.latest_per_key(rows, "key", "seq").collect()} == {("a", 5), ("b", 2)}


@pytest.mark.parametrize("upsert,predicts,dup_seq,dup_key,held", [
    (False, True, 10002, 0, True), (False, True, 0, 0, False),
    (False, False, 0, 10002, True), (True, False, 10002, 0, True),
    (False, False, 10002, 0, False), (True, False, 0, 10002, False),
])
def test_prediction_verdict_follows_the_write_mode(spark, upsert, predicts, dup_seq, dup_key, held):
    run = spark.createDataFrame(
        [(upsert, predicts, dup_seq, dup_key)],
        "upsert boolean, predicts_duplicates boolean, duplicate_seq_rows long, duplicate_key_rows long",
    )
    assert audit.prediction_verdict(run).first()["prediction_held"] is held


def test_rows_lost(spark):
    row = spark.range(1).select(
        audit.rows_lost(F.lit(12000), F.lit(11990 - 5)).alias("lost"),
        audit.rows_lost(F.lit(10), F.lit(12)).alias("clamped"),
        audit.rows_lost(F.lit(10), F.lit(12), clamp=False).alias("free"),
    ).first()
    assert tuple(row) == (15, 0, -2)


def test_two_way_difference_sees_both_sides_and_copies(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "n long")
    right = spark.createDataFrame([(1,), (3,)], "n long")
    got = {tuple(r) for r in audit.two_way_difference(left, right).collect()}
    assert got == {(1, 1), (2, 1), (3, -1)}
    assert audit.two_way_difference(left, left).isEmpty()


def test_measures_carry_counts_and_verdict(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, seq long")
    row = audit.measure_append(rows, 1, 3, "key", "seq").first()
    assert row["complete"] and row["distinct_keys"] == 2 and row["duplicate_key_rows"] == 1
    held = audit.latest_per_key(rows, "key", "seq")
    row = audit.measure_upsert(held, audit.expected_state(rows, "key", "seq"), "key", "seq").first()
    assert row["complete"] and row["duplicate_seq_rows"] == 0


def test_fingerprint_ignores_order_and_sees_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n long, t string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "n long, t string")
    c = spark.createDataFrame([(2, "x"), (1, "y")], "n long, t string")
    assert audit.row_fingerprint(a).first() == audit.row_fingerprint(b).first()
    assert audit.row_fingerprint(a).first() != audit.row_fingerprint(c).first()
