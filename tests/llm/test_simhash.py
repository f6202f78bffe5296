import random

import numpy as np
import pytest
import xxhash

from tidemark.llm.simhash import Split, forest, near_duplicates, plan_parts


def slow_fingerprint(text):
    words, lower = [], (text or "").encode().lower()
    word = bytearray()
    for c in lower + b" ":
        if c == 32 or 9 <= c <= 13:
            if word:
                words.append(bytes(word))
            word = bytearray()
        else:
            word.append(c)
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 4 else [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, distance=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= distance and label[j] > label[i]:
                    label[j], changed = label[i], True
        if not changed:
            break
    least = {}
    for k, (i, _) in zip(label, rows):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [(i, f"{fp:016x}", least.get(k)) for (i, _), fp, k in zip(rows, fps, label)]


def texts(seed, n=60):
    pick = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "DELTA", "été", "zeta", "eta\tx", "theta\niota", "k\xa0l"]
    base = [" ".join(pick.choice(words) for _ in range(pick.randint(1, 60))) for _ in range(n // 3)]
    rows = list(base)
    while len(rows) < n:
        text = pick.choice(base).split(" ")
        text[pick.randrange(len(text))] = pick.choice(words)
        rows.append(" ".join(text))
    return rows


@pytest.mark.parametrize("hot_rows", [50_000, 3])
def test_like_brute_force(spark, hot_rows):
    rows = list(enumerate(texts(7))) + [(100, None), (101, ""), (102, " \n"), (103, "one"), (0, "one"), (None, "one"), (104, "x " * 30000)]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, fp long, root string")
    found = [tuple(r) for r in near_duplicates(docs, hot_rows=hot_rows).collect()]
    assert sorted(found, key=str) == sorted(slow_components(rows), key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert near_duplicates(docs).count() == 0


def test_every_near_pair_meets_in_a_probe():
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    other = fps.copy()
    for _ in range(4):
        other ^= np.uint64(1) << draw.integers(0, 64, 500).astype(np.uint64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    for rows in (100, 10**6, 10**9):
        parts = plan_parts(rows, 4, bits.T @ bits)
        assert sorted(b for p in parts for b in p) == list(range(64))
        split = Split(parts, tuple(draw.random(1 << min(10, len(p))) * 50 for p in parts), 4)
        levels = split.allocate(fps)
        assert (levels.sum(axis=1) == 4 - len(parts) + 1).all()
        apart = np.stack([np.bitwise_count(split.values(fps, i) ^ split.values(other, i)) for i in range(len(parts))], axis=1)
        assert (apart.astype(int) <= levels).any(axis=1).all()


def test_forest_connects_all():
    draw = np.random.default_rng(2)
    fps = np.zeros(400, np.uint64)
    for _ in range(9):
        fps ^= np.where(draw.random(400) < 0.5, np.uint64(1) << draw.integers(0, 24, 400).astype(np.uint64), np.uint64(0))
    fps = np.unique(fps)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in forest(fps, 4):
        for x, y in zip(a.tolist(), b.tolist()):
            assert bin(x ^ y).count("1") <= 4
            root[find(x)] = find(y)
    for i, x in enumerate(fps.tolist()):
        for y in fps[:i].tolist():
            if bin(x ^ y).count("1") <= 4:
                assert find(x) == find(y)
