import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn

NAN, INF = float("nan"), float("inf")


def slow(rows, step=5, positives=5, negatives=3, low=50, high=95, scale=256):
    taken = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if math.sqrt(sum(float(x) * float(x) for x in v)) * scale < hn.LONGEST:
            taken.append((i, [math.floor(scale * float(x)) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(taken):
        if i % step:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), j, k) for k, (j, w, _) in enumerate(taken) if k != a and len(v) == len(w))
        own = [(-s, j) for s, j, k in scored if taken[k][2] == label][:positives]
        for ps, p in own:
            window = [(-s, j) for s, j, k in scored if taken[k][2] != label and low * ps <= -100 * s <= high * ps]
            out += [(i, p, rank + 1, j, ps, ns) for rank, (ns, j) in enumerate(window[:negatives])]
    return out


def found(spark, rows, **options):
    frame = spark.createDataFrame(
        [(i, v, label, 0, 0.5) for i, v, label in rows], "vec_id long, embedding array<float>, label int, bucket int, norm double")
    return [tuple(r) for r in hn.hard_negatives(frame, F.col("vec_id") % 5 == 0, **options).collect()]


def clusters(seed, n, dim):
    """Groups of near vectors, of exact copies and of ties, in float32."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 8, dim))
    v = centres[draw.integers(0, len(centres), n)] + draw.normal(size=(n, dim)) * draw.choice([0.05, 0.6], (n, 1))
    v *= draw.choice([0.2, 1.0, 3.0], (n, 1)) / np.linalg.norm(v, axis=1)[:, None]
    v[draw.random(n) < 0.2] = v[0]
    return [(int(i), [float(x) for x in w], int(draw.integers(0, 4))) for i, w in enumerate(v.astype(np.float32))]


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 40, "pack_rows": 7}])
def test_like_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(hn, "PART_ROWS", 64)
    rows = clusters(5, 300, 12) + [
        (500, [1.0] * 12, None), (505, None, 1), (510, [NAN] + [0.0] * 11, 1), (515, [None] + [0.0] * 11, 1),
        (520, [INF] + [0.0] * 11, 1), (None, [1.0] * 12, 1), (525, [0.0] * 12, 1), (530, [0.0] * 12, 2), (535, [], 1), (540, [], 2),
        (545, [1.0, 2.0], 1), (546, [1.0, 1.5], 1), (547, [0.5, 1.0], 2), (0, [0.5] * 12, 1), (0, [0.5] * 12, 1),
        (550, [1e6] * 12, 3), (551, [1.1e6] * 12, 3), (552, [9e5] * 12, 2), (555, [3e7] * 12, 3), (560, [-0.3] * 12, 9),
    ]
    assert Counter(found(spark, rows, **options)) == Counter(slow(rows))


def test_one_vector_in_a_third_of_all_rows(spark):
    rows = clusters(6, 120, 8) + [(1000 + i, [0.1] * 8, i % 3) for i in range(60)]
    assert Counter(found(spark, rows, positives=2, negatives=1, bucket_rows=50)) == Counter(slow(rows, positives=2, negatives=1))


def test_products_beyond_doubles_are_exact():
    a = np.array([[3e15, 1.0], [1.0, 1.0]])
    assert hn.products(a, a)[0, 0] == int(3e15) ** 2 + 1


def test_pruning_keeps_whatever_reaches_the_floor():
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(900, 6))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None])
    part = hn.Part(rows, np.arange(900), np.zeros(900, np.int64), np.arange(900))
    queries = np.floor(256 * draw.normal(size=(80, 6)) / 2)
    queries[0] = 0
    scores = queries @ rows.T
    length = np.sqrt(np.square(queries).sum(axis=1))
    pruned = 0
    for share in (0.999, 0.98, 0.8, 0.3):
        floor = np.quantile(scores, share, axis=1)
        for i, kept in enumerate(part.candidates(queries, length, floor)):
            reach = np.flatnonzero(scores[i] >= floor[i])
            if not isinstance(kept, int):
                pruned += len(kept) < len(rows)
                assert set(reach) <= set(kept.tolist())
    assert pruned > 20


def test_nothing_to_mine(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(0, [1.0], 1), (2, [1.0], 2)]) == []
