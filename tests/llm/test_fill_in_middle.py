import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import fill_in_middle
from tidemark.llm.fill_in_middle import rearrange, restore


def slow(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text, text
    hexed = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    if h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    pre, mid, suf = ("".join(p) for p in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


def texts(count):
    pick = random.Random(3)
    parts = ["a", "\n", "\n\n", "é", "文", "𝄞", "<", "P>", "S>", "<P", "<<S", ">", " ", "\r\n", "\x00", "word\n"]
    rows = [(i, "".join(pick.choice(parts) for _ in range(pick.randint(0, 30)))) for i in range(count)]
    return rows + [
        (-5, "x\ny\nz"), (1 << 60, "one\ntwo\n"), (count, None), (count + 1, ""), (None, "a\nb\nc"), (None, None), (3, "same\nrow\n"),
        (3, "same\nrow\n"), (count + 2, "\n"), (count + 3, "\n" * 500), (count + 4, "no line " * 9), (count + 5, "a<P>\nb"),
    ]


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (40, 0), (100, 100), (0, 50)])
def test_like_brute_force(spark, rate, spm_rate):
    rows = texts(300)
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n int, form string")
    made = restore(rearrange(docs, rate=rate, spm_rate=spm_rate))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    wanted = [slow(i, t, rate=rate, spm_rate=spm_rate) for i, t in rows]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(wanted, key=str)


def test_marks_of_neighbouring_texts_do_not_join(spark):
    rows = [(1, "a\n<"), (2, "P>\nb"), (3, "<S"), (4, ">")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["form"] for r in rearrange(docs).collect()} <= {"psm", "spm"}


def test_windows_carry_the_shift(monkeypatch):
    rows = texts(80)
    blob = [(t or "").encode() for _, t in rows]
    data = np.frombuffer(b"".join(blob), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(b) for b in blob])])
    known = np.array([i is not None for i, _ in rows])
    draw = fill_in_middle.draws([i for i, _ in rows], 7)
    whole = fill_in_middle.rearranged(data, at, draw, known, 100, 50)
    monkeypatch.setattr(fill_in_middle, "WINDOW", 7)
    small = fill_in_middle.rearranged(data, at, draw, known, 100, 50)
    for a, b in zip(whole, small):
        assert (a == b).all()
    back, borders = fill_in_middle.restored(small[0], small[1], small[3])
    assert back.tobytes() == data.tobytes() and (borders == at).all()


def test_long_text(spark):
    text = "".join(f"line {i} é\n" for i in range(300_000))
    docs = spark.createDataFrame([(11, text)], "doc_id long, text string")
    row = tuple(restore(rearrange(docs)).first())
    assert row == slow(11, text)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert restore(rearrange(docs)).count() == 0
