import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.packing import best_fit, configurations, fractional, knapsack, pack, slots, walk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_the_knapsack_is_the_best_of_all():
    def slow(lengths, worth, capacity):
        best = 0
        def go(i, left, value):
            nonlocal best
            best = max(best, value)
            if i < len(lengths):
                for k in range(left // lengths[i] + 1):
                    go(i + 1, left - k * lengths[i], value + k * worth[i])
        go(0, capacity, 0)
        return best

    pick = random.Random(1)
    for _ in range(40):
        lengths = sorted(pick.sample(range(2, 20), 4))
        worth = [pick.random() * x for x in lengths]
        best, choice = knapsack(np.array(lengths), np.array(worth), 20)
        for room in (7, 13, 20):
            got = walk(choice, room)
            assert sum(got) <= room
            assert abs(sum(worth[lengths.index(x)] for x in got) - best[room]) < 1e-9
            assert abs(best[room] - slow(lengths, worth, room)) < 1e-9


@pytest.mark.parametrize("histogram", [{}, {2048: 5}, {1: 1}, {1: 5000}, {1025: 7}, {1024: 7}, {700: 300, 648: 100, 2048: 1}, "many"])
def test_configurations_hold_the_histogram(histogram):
    if histogram == "many":
        draw = np.random.default_rng(3)
        histogram = dict(Counter(np.minimum(2048, draw.lognormal(6, 1.1, 20000).astype(int) + 1).tolist()))
    found = configurations(histogram)
    held = Counter()
    for times, config in found:
        assert times > 0 and sum(x * n for x, n in config.items()) <= 2048
        for x, n in config.items():
            held[x] += times * n
    assert held == Counter({x: n for x, n in histogram.items() if n})
    used = sum(t for t, _ in found)
    bound = -(-sum(x * n for x, n in histogram.items()) // 2048)
    plain = sum(t for t, _ in best_fit([], {x: n for x, n in histogram.items() if x < 2048}, 2048)) + histogram.get(2048, 0)
    assert bound <= used <= plain * 1.001 + 1
    ranks = Counter()
    for length, first, end, *_ in slots(found):
        assert ranks[length] == first
        ranks[length] = end
    assert ranks == held


def check(rows, docs, capacity):
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        borders = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(borders, borders[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values(), default=0) <= capacity
    return len(filled)


@pytest.mark.parametrize("capacity,salt", [(2048, 100_000), (16, 3)])
def test_pieces_and_places(spark, monkeypatch, capacity, salt):
    monkeypatch.setattr(packing, "SALT_ROWS", salt)
    pick = random.Random(2)
    docs = [(i, " ".join(pick.choice(["one", "two", "thrée", "x<|endoftext|>y"]) for _ in range(int(pick.lognormvariate(3, 1.5))))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "same text"), (502, "same text"), (None, "no id"), (503, "long " * 5000), (504, "中文 \x1c" * 30), (505, "w " * 2046), (506, "w " * 2047)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, length int, ids int")
    rows = pack(frame, PATH, capacity).collect()
    n = check(rows, docs, capacity)
    assert n <= -(-sum(r.length for r in rows) // capacity) * 1.03 + 1


def test_empty_and_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, PATH).count() == 0
    one = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    row = pack(one, PATH, with_ids=True).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*Tokenizer.from_file(PATH).encode("hello there").ids, 0]


def test_every_piece_keeps_its_own_ids(spark):
    pick = random.Random(4)
    docs = [(i, " ".join(pick.choice(["one", "two", "three"]) for _ in range(pick.randint(0, 90)))) for i in range(200)]
    docs += [(7, "again and again")] * 30 + [(None, None)] * 5 + [(8, "other text, same id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = pack(frame, PATH, 32, with_ids=True).collect()
    places = pack(frame, PATH, 32).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in rows) == Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in places)
    assert {(r.sequence_id, r.offset, r.length) for r in rows} == {(r.sequence_id, r.offset, r.length) for r in places}


@pytest.mark.parametrize("histogram,best", [({1025: 3000, 682: 3000, 333: 3000}, 3000), ({1100: 4000, 600: 4000, 340: 4000}, 4000)])
def test_hot_lengths_need_few_sequences(histogram, best):
    found = configurations(histogram)
    held = Counter()
    for times, config in found:
        assert sum(x * n for x, n in config.items()) <= 2048
        held.update({x: times * n for x, n in config.items()})
    assert held == Counter(histogram)
    assert sum(t for t, _ in found) <= best * 1.02


@pytest.mark.parametrize("kind,limit", [("three", 1.05), (1000, 1.05), (2000, 1.05), ("texts", 1.05), (30, 1.15)])
def test_the_program_is_solved(kind, limit):
    """All demand is covered, by a sum near the tokens over the capacity; few lengths may not combine to full sequences."""
    draw = np.random.default_rng(3)
    if kind == "three":
        histogram = {1025: 3000, 682: 3000, 333: 3000}
    elif kind == "texts":
        histogram = Counter(x for x in (draw.lognormal(6, 1.1, 20000).astype(int) + 1).tolist() if x < 2048)
    else:
        histogram = dict(zip(draw.choice(np.arange(1, 2048), kind, replace=False).tolist(), draw.integers(1, 100, kind).tolist()))
    lengths = np.array(sorted(histogram, reverse=True))
    demand = np.array([histogram[x] for x in lengths.tolist()])
    shares, bound = fractional(lengths, demand, 2048)
    covered = Counter()
    for share, config in shares:
        assert share > 0 and sum(x * n for x, n in config.items()) <= 2048
        for x, n in config.items():
            covered[x] += share * n
    assert all(covered[x] >= n * (1 - 1e-9) for x, n in histogram.items())
    tokens = (lengths * demand).sum() / 2048
    total = sum(n for n, _ in shares)
    assert tokens <= bound * (1 + 1e-9) and bound <= total * (1 + 1e-9)
    assert total <= limit * bound * (1 + 1e-9)


def test_a_bound_above_the_tokens():
    """Pieces of more than half a sequence stand alone, whatever small ones go with them."""
    shares, bound = fractional(np.array([1100, 900]), np.array([1000, 10]), 2048)
    assert bound >= 950 and sum(n for n, _ in shares) <= 1050


def test_most_pieces_are_placed_by_the_program():
    draw = np.random.default_rng(5)
    histogram = dict(Counter(np.minimum(2047, draw.lognormal(6, 1.1, 40_000).astype(int) + 1).tolist()))
    lengths = np.array(sorted(histogram, reverse=True))
    groups, left = packing.rounded(fractional(lengths, np.array([histogram[x] for x in lengths.tolist()]), 2048)[0], histogram)
    assert sum(left.values()) <= 0.25 * sum(histogram.values())
    used = sum(t for t, _ in best_fit(groups, left, 2048))
    assert used <= 1.004 * sum(x * n for x, n in histogram.items()) / 2048 + 1
