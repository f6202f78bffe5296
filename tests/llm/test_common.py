import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common as C


def test_words_and_hashes_follow_the_text_alone():
    texts = ["a bb  ccc", None, "", " a\tbb\x0bccc\n", "é\xa0x y", "bb", "z" * 1000]
    data, at = C.bytes_of(pa.array(texts))
    first, end, start = C.words_of(data, at)
    got = [[bytes(data[a:b]) for a, b in zip(first[i:j], end[i:j])] for i, j in zip(start[:-1], start[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    hashes = C.span_hashes(data, first, end)
    by_word = {}
    for a, b, h in zip(first, end, hashes.tolist()):
        assert by_word.setdefault(bytes(data[a:b]), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_chunks_hold_every_row_and_stay_small():
    pick = random.Random(3)
    texts = ["x" * pick.choice([0, 1, 50, 500]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(300))], ["text", "i"])
    parts = list(C.in_chunks(iter([batch.slice(7), batch.slice(0, 0)]), "text", 900))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(7, 300))
    assert all(p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= 900 for p in parts)


def test_groups_cross_batches_whole():
    keys = np.sort(np.random.default_rng(1).integers(0, 12, 200))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 9])], ["k"]) for a in range(0, 200, 9)]
    seen = []
    for table in C.keyed_groups(iter(batches), "k"):
        mine = table.column("k").to_pylist()
        assert not set(mine) & set(seen)
        seen += mine
    assert seen == keys.tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randint(-30, 60), pick.randint(-30, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (200, 200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges + edges[:5], "a long, b long")
    assert {tuple(r) for r in C.components(frame).collect()} == {(n, find(n)) for n in list(root)}
    assert C.components(frame.limit(0)).count() == 0


def test_samples_are_bounded(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS h", "CAST(id AS STRING) AS text")
    few = C.least_hashes(rows, 20_000, 50)
    assert len(few) == 50 and few == sorted(few)
    assert few == sorted(tuple(r) for r in rows.collect())[:50]
    assert len(C.least_hashes(rows.limit(20), 20, 50)) == 20
