import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import near_vectors as nv

NAN, INF = float("nan"), float("inf")


def slow(rows, cosine=0.95):
    """Links and components by all pairs, row by row."""
    unit = []
    for _, v in rows:
        good = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if good else None)
    n = len(rows)
    links = [
        [j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None
         and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return out


def found(spark, rows, **options):
    frame = spark.createDataFrame(
        [(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, home int, weight double").repartition(3)
    return [tuple(r) for r in nv.near_vectors(frame, **options).collect()]


def around(draw, centre, n, apart):
    """Vectors whose pairs have about the cosine `apart`."""
    v = draw.normal(size=(n, len(centre)))
    v -= (v @ centre)[:, None] * centre
    v /= np.linalg.norm(v, axis=1)[:, None]
    return math.sqrt(apart) * centre + math.sqrt(1 - apart) * v


def vectors(seed, dim, sizes):
    draw = np.random.default_rng(seed)
    out = []
    for n, apart in sizes:
        centre = draw.normal(size=dim)
        out.append(around(draw, centre / np.linalg.norm(centre), n, apart) * draw.choice([0.01, 1.0, 70.0], (n, 1)))
    v = np.concatenate(out)[draw.permutation(sum(n for n, _ in sizes))].astype(np.float32)
    return [(int(i), [float(x) for x in w]) for i, w in enumerate(v)]


ODD = [
    (900, None), (901, []), (902, [0.0, 0.0]), (903, [NAN, 1.0]), (904, [INF, 1.0]), (905, [None, 1.0]), (None, None),
    (906, [1.0, 1.0]), (907, [2.0, 2.0]), (None, [1.0, 1.0]), (906, [1.0, 1.0]), (908, [3e38, 3e38]), (909, [1e-44, 1e-44]), (910, [-1.0, -1.0]),
    (911, [5.0]), (912, [7.0]), (913, [-7.0]), (914, [0.0, -0.0, 1.0]), (915, [-0.0, 0.0, 1.0]), (None, [3.0, 1.0, 9.0]),
]


@pytest.mark.parametrize("options", [{}, {"hot_rows": 20, "cell_rows": 15}])
def test_like_brute_force(spark, options):
    rows = vectors(3, 32, [(80, 0.0), (60, 0.99), (60, 0.97), (50, 0.955), (40, 0.95), (40, 0.93)])
    rows += [(700 + i, rows[5][1]) for i in range(30)] + ODD
    assert Counter(found(spark, rows, **options)) == Counter(slow(rows))


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = vectors(4, 16, [(60, 0.2), (20, 0.98)]) + [(500 + i, [0.25] * 16) for i in range(40)]
    assert Counter(found(spark, rows, cell_rows=10)) == Counter(slow(rows))


def test_a_chain_is_one_component(spark):
    turn = np.arccos(0.96)
    rows = [(9 - i, [math.cos(i * turn), math.sin(i * turn)] + [0.0] * 30) for i in range(8)]
    assert Counter(found(spark, rows)) == Counter(slow(rows))


def test_pairs_at_the_threshold_meet():
    for dim, rows in ((64, 50_000), (64, 3_000_000), (24, 20_000)):
        code = nv.Code.get(dim, rows, 0.95)
        assert code._missed(np.random.default_rng(11), 0.95) <= 0.004
        assert code._missed(np.random.default_rng(12), 0.97) <= 0.001


def test_decoding_finds_the_greatest_products():
    code = nv.Code.get(24, 20_000, 0.95)
    unit = nv._directions(np.random.default_rng(5), 6, 24)
    row, filters = code.decode(unit)
    for i in range(len(unit)):
        for k in range(nv.CODES):
            one, two = (s[i] for s in code.blocks_of(unit, k))
            sums = np.sort((one[:, None] + two[None, :]).ravel())[::-1][: code.wanted]
            words = filters[(row == i) & (filters >> 43 == k)] - (k << 43)
            assert np.allclose(np.sort(one[words // code.size] + two[words % code.size])[::-1], sums)


def test_the_byte_bound_never_loses_a_link():
    draw = np.random.default_rng(6)
    code = nv.Code.get(64, 20_000, 0.95)
    centre = nv._directions(draw, 1, 64)[0]
    unit = np.concatenate([around(draw, centre, 150, 0.95), nv._directions(draw, 150, 64)])
    steps, scale, rest = nv.sketched(code, unit)
    side = steps, scale, rest, np.zeros(len(unit))
    near = nv.maybe_near(side, side, math.acos(0.95))
    assert near[unit @ unit.T >= 0.95].all()
    assert near[150:, 150:].mean() < 0.05


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nv.near_vectors(frame).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert nv.near_vectors(frame).count() == 0
