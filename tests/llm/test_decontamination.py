import random
import string

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontamination
from tidemark.llm.decontamination import contaminated, keep_clean


def words(text):
    out = [w.strip(string.punctuation) for w in (text or "").encode().lower().decode().split()]
    return [w for w in out if w]


def slow_cover(text, item, tile=5):
    """Greedy string tiling by its definition: scan for the longest match of free words, mark, repeat."""
    size = min(tile, len(item))
    if not size:
        return 0, 0
    a, b = [False] * len(text), [False] * len(item)
    n_tiles = 0
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(text)):
                n = 0
                while p + n < len(text) and q + n < len(item) and not a[p + n] and not b[q + n] and text[p + n] == item[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < size:
            return sum(b) / len(item), n_tiles
        n_tiles += 1
        for j in range(n):
            a[p + j] = b[q + j] = True


def tables():
    pick = random.Random(11)
    vocabulary = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(pick.choice(vocabulary) for _ in range(pick.randint(1, 40)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "?! --"), (93, "a a a a a a a a"), (94, items[3][1]), (94, items[3][1]), (None, "null item has these six words")]
    docs = []
    for i in range(80):
        body = [pick.choice(vocabulary) for _ in range(pick.randint(0, 60))]
        item = words(pick.choice(items[:25])[1])
        kind = i % 5
        if kind == 1:
            body[len(body) // 2 : len(body) // 2] = item
        elif kind == 2:
            half = len(item) // 2
            body = item[half:] + body + item[:half]
        elif kind == 3:
            noisy = list(item)
            noisy[pick.randrange(len(noisy))] = "other"
            body += noisy
        elif kind == 4:
            body += [w.upper() + "," for w in item] * 2
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), (202, "a a a a a a a"), (203, "a " * 500), (204, "null item has these six words"), (None, "Null item (has these) six words!"), (204, "null item has these six words")]
    return docs, items


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_like_brute_force(spark, block):
    docs, items = tables()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, tiles string").repartition(4)
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    want = []
    for i, text in docs:
        for j, item in items:
            share, n = slow_cover(words(text), words(item))
            if share >= 0.8:
                want.append((i, j, round(share, 9), n))
    found = contaminated(frame, bench, block_bytes=block)
    assert found.columns == ["doc_id", "item_id", "coverage", "n_tiles", "tiles"]
    got = [(r.doc_id, r.item_id, round(r.coverage, 9), r.n_tiles) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = keep_clean(frame, bench, block_bytes=block)
    assert kept.columns == frame.columns
    bad = {i for i, *_ in want}
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(i) for i, _ in docs if i not in bad)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contaminated(docs, bench).count() == 0
    full = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert contaminated(full, bench.limit(0)).count() == 0
    assert contaminated(full, bench).count() == 1
    assert keep_clean(full, bench.limit(0)).count() == 1


def test_tiles_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "e f g h i j a b c d e f g h i")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    row = contaminated(docs, bench, coverage=0.5).first()
    assert [tuple(t) for t in row.tiles] == [(6, 0, 9)] and np.isclose(row.coverage, 0.9)


def test_any_number_of_marks_is_no_part_of_a_word():
    texts = pa.array(["word", "." * 70 + "word" + "!" * 200, "..." * 100 + " word", "wo" + "." * 90 + "rd"])
    found, start = decontamination.word_hashes(texts)
    by_text = [found[a:b].tolist() for a, b in zip(start[:-1], start[1:])]
    assert by_text[0] == by_text[1] == by_text[2] and len(by_text[0]) == 1
    assert by_text[3] != by_text[0] and len(by_text[3]) == 1
