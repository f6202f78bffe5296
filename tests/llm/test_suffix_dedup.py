import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.packed import deltas, pack, unpack
from tidemark.llm.suffix_dedup import LENGTH, SIDE, WIDTH, _by_hash, _by_splitters, multikey_order, remove_repeats, repeated_around


def slow(rows):
    seen = {}
    for i, text in rows:
        if i is None:
            continue
        raw = (text or "").encode()
        for p in range(len(raw) - LENGTH + 1):
            s = raw[p : p + LENGTH]
            seen[s] = min(seen.get(s, i), i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - LENGTH + 1 if i is not None else 0):
            if seen[raw[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def corpus(seed, n=90):
    pick = random.Random(seed)
    letters = "abcdefgh é\n"
    passages = ["".join(pick.choice(letters) for _ in range(pick.randint(40, 160))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 200)))
        for _ in range(pick.randint(0, 3)):
            p = pick.choice(passages)
            a = pick.randint(0, 20)
            at = pick.randint(0, len(text))
            text = text[:at] + p[a : len(p) - pick.randint(0, 20)] + text[at:]
        if rows and pick.random() < 0.2:
            text = pick.choice(rows)[1]
        if rows and pick.random() < 0.2:
            text = pick.choice(rows)[1]
            if text:
                at = pick.randrange(len(text))
                text = text[:at] + "#" + text[at + 1 :]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("hot", [256, 2])
def test_like_brute_force(spark, hot):
    rows = corpus(3) + [(200, None), (201, ""), (202, "x" * 49), (203, "x" * 4000), (204, "y" * 300 + "x" * 60), (None, "x" * 500),
                        (205, "ab" * 400), (206, "ba" * 200), (206, "ba" * 200), (207, "é" * 60), (-5, "y" * 100), (208, "z" * 50), (209, "z" * 50)]
    docs = spark.createDataFrame([(i, t, i, "r", 0) for i, t in rows], "doc_id long, text string, id long, row string, kept int").repartition(5)
    out = remove_repeats(docs, hot_docs=hot)
    assert out.columns == ["id", "rest", "n_bytes", "n_removed", "n_spans", "kept"]
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(got, key=key) == sorted(slow(rows), key=key)


def test_hot_anchors_alone(spark):
    """Enough documents share one passage that its anchors count as hot."""
    pick = random.Random(9)
    line = "the very same line that a great many documents of this corpus hold in them, word by word"
    rows = [(i, "".join(pick.choice("abcdef ") for _ in range(60)) + line + "".join(pick.choice("ghijk ") for _ in range(70))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect())
    assert got == sorted(slow(rows))


def test_empty_and_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).count() == 0
    docs = spark.createDataFrame([(1, "é" * 40), (2, "aé" + "é" * 40 + "b")], "doc_id long, text string")
    assert {r.id: r.kept for r in remove_repeats(docs, as_text=True).collect()} == {1: "é" * 40, 2: "ab"}


def test_order_and_packing():
    draw = np.random.default_rng(0)
    tokens = draw.integers(0, 3, (500, 4)).astype(np.uint64)
    assert tokens[multikey_order(tokens)].tolist() == sorted(tokens.tolist())
    columns = [draw.integers(-9, 9, 50), draw.integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2), draw.integers(0, 255, 20).astype(np.uint8), np.zeros(0, np.int64)]
    for a, b in zip(columns, unpack(pack(*columns))):
        assert a.tolist() == b.tolist()


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def bodies_of(body, n):
    for _ in range(n):
        yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])


def test_what_packs_well_is_held_in_parts():
    """A few packed megabytes hold many times as much; what a task holds at once is bounded unpacked."""
    n = 50_000
    ids, same = np.arange(n), np.full(n, 7)
    near = pack(np.zeros(n * WIDTH, np.uint8), same, same, deltas(ids), same, same)
    splitters = np.zeros(0, "S16")
    assert peak_mb(lambda: [b.num_rows for b in _by_splitters(splitters)(bodies_of(near, 40))]) < 150  # 250 MB unpacked
    hot = pack(same.astype(np.uint64), deltas(ids), same, same)
    assert peak_mb(lambda: [b.num_rows for b in _by_hash(3)(bodies_of(hot, 120))]) < 150  # 190 MB unpacked


def test_many_rows_of_a_range_take_little_memory():
    n = 50_000
    draw = np.random.default_rng(2)
    context = np.repeat(draw.integers(97, 100, (n // 2, WIDTH)).astype(np.uint8), 2, axis=0)
    side, ids = np.full(n, SIDE), np.arange(n)
    found = []
    assert peak_mb(lambda: found.extend(repeated_around(context, side, side, ids))) < 30  # with a table of sums 48
    most, least = found
    assert (most[1::2] == SIDE).all() and (least[1::2] == 0).all() and (most[::2] == -1).all()
