import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity as T


def made(n=600, seed=5):
    """Texts with a bad word, or a word with a bad beginning, somewhere in a third of them."""
    pick = random.Random(seed)
    plain = ["word%d" % i for i in range(300)]
    rows = []
    for i in range(n):
        words = [pick.choice(plain) for _ in range(pick.randint(1, 200))]
        toxic = int(i % 3 == 0)
        if toxic:
            words[pick.randrange(len(words))] = pick.choice(["rotten", "Foul,", "vile."]) if i % 2 else "grrrk" + "".join(pick.choice("abcdefgh") for _ in range(5))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_windows_cover_every_word():
    start = np.concatenate([[0], np.cumsum([0, 1, 47, 48, 49, 84, 85, 500, 0])])
    text, first, size = T.windows(start)
    hit = np.zeros(start[-1], int)
    for t, a, n in zip(text, first, size):
        assert start[t] <= a and a + n <= start[t + 1] and 0 < n <= T.WINDOW
        hit[a : a + n] += 1
    assert (hit > 0).all()
    assert 0 not in np.bincount(text, minlength=9)[[1, 2, 3, 4, 5, 6, 7]]


def test_gradients_and_layouts_agree():
    draw = np.random.default_rng(0)
    model = T.Model.fresh(draw.standard_normal((T.VIEWS, T.BUCKETS)), 1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids, real = draw.integers(0, 50, (6, 9, T.VIEWS)), np.arange(9)[None] < np.array([9, 1, 4, 9, 7, 2])[:, None]
    label = np.array([0, 1, 0, 1, 1, 0.0])
    np.testing.assert_allclose(model.forward(ids, real), model.logits(ids, real), atol=1e-4)

    def loss():
        p = T.sigmoid(model.forward(ids, real).astype(float))
        return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())

    grad = model.gradients(ids, real, label)
    for name, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = model.weights[name][at]
        model.weights[name][at] = old + 1e-2
        up = loss()
        model.weights[name][at] = old - 1e-2
        down = loss()
        model.weights[name][at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3 + 0.05 * abs(g[at]), name


@pytest.fixture(scope="module")
def frames(spark):
    rows = made()
    extra = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "word1 " * 60000 + "rotten " + "word2 " * 3000), (9005, "word3 " * 20000), (None, "word1"), (9003, " ")]
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in [r[:2] for r in rows] + extra], "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None), (700000, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_held_out(frames):
    docs, labels, rows = frames
    out = T.toxicity(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == docs.count()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    odd = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id > 9000}
    assert odd[9001].score == odd[9002].score == odd[9003].score == 0.0
    assert odd[9004].predicted == 1 and odd[9005].predicted == 0 and odd[None].held_out is False
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = T.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_empty_and_one_class(spark, frames):
    docs, labels, _ = frames
    assert T.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in T.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in T.toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_the_scale_of_a_text_does_not_hide_a_word():
    feats, start = T.features(pa.array(["Rotten.", "(rotten)", "rotten!!", "other"]))
    assert feats[0].tolist() == feats[1].tolist() == feats[2].tolist() != feats[3].tolist()
    assert start.tolist() == [0, 1, 2, 3, 4]


def test_marks_at_the_ends_of_words_are_left_out():
    plain, start = T.features(pa.array(["some word here", "it's"]))
    marked, _ = T.features(pa.array(["(((some*** " + "!" * 70 + "word" + "?" * 90 + " 'here'", "--it's..."]))
    np.testing.assert_array_equal(plain, marked)
    only, at = T.features(pa.array(["!!! !", "", None]))
    assert at.tolist() == [0, 2, 2, 2] and (only[0] == only[1]).all()


def test_the_sample_of_a_repeated_id_is_bounded(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(T, "train", lambda feats, start, label, seed: fitted.append((start, label)))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(1, f"more {i}") for i in range(500)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for rows in (10, 1000):
        T.fit(docs, labels, rows=rows)
    assert len(fitted[0][1]) <= 20
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert len(fitted[1][1]) == len(ids) + 500 * (1 in ids)
