import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import lm_model, lm_scoring
from tidemark.llm.lm_scoring import lm_scores
from tidemark.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def corpus():
    pick = random.Random(8)
    follows = {w: [pick.choice("abcdefghij") * pick.randint(1, 4) for _ in range(3)] for w in [c * n for c in "abcdefghij" for n in (1, 2, 3, 4)]}
    rows = []
    for i in range(250):
        word, out = "a", []
        for _ in range(pick.randint(0, 120)):
            word = pick.choice(follows[word])
            out.append(word.upper() if pick.random() < 0.1 else word)
        if pick.random() < 0.3:
            out.append("rare%d" % pick.randint(0, 40))
        rows.append((i, pick.choice([" ", "\n", "  "]).join(out)))
    return rows


ODD = [(900, None), (901, ""), (902, " \n "), (903, "x\xa0y \xa0 \x85 z"), (904, "a " * 30000), (905, "<|endoftext|> a"), (None, "a b rare1"), (906, "ünï 中文"), (906, "ünï 中文")]


@pytest.mark.parametrize("frequent", [lm_scoring.FREQUENT, 3])
def test_base_like_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    rows = corpus() + ODD
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, key string").repartition(5)
    out = lm_scores(docs, PATH)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in [*words(t), "<end>"])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        each = [*words(t), "<end>"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in each)
        want.append((i, held[i], len(each), sum(counts[w] > 0 for w in each), total, round(base, 5)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == sorted(want, key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scores(docs, PATH).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), PATH).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and row.score < 0


@pytest.fixture(scope="module")
def model():
    encoder = Encoder.get("byte_bpe_50k.json", open(PATH, "rb").read())
    flat, sizes = lm_scoring.sequences_of(encoder, [" ".join(words(t)) for _, t in corpus()], 50256)
    return lm_model.train(flat, sizes, 50257), flat, sizes


def test_every_context_sums_to_one(model):
    m, flat, _ = model
    assert np.allclose(np.bincount(m.kind, np.exp(m.inside), lm_model.CLASSES)[np.unique(m.kind)], 1)
    z = m.hidden(flat[None, :20], np.ones((1, 20), bool))
    assert np.allclose(np.exp(m.class_logs(z)).sum(axis=2), 1, atol=1e-4)
    # classes without ids hold next to nothing
    logs = m.class_logs(z)[:, :, np.unique(m.kind)]
    assert np.exp(logs).sum(axis=2).min() > 0.9


def test_each_id_once_and_causal(model):
    m, flat, _ = model
    long = np.concatenate([flat, flat])[:400]
    logs = m.logs(long, np.array([400]))
    assert len(logs) == 399 and np.isfinite(logs).all()
    changed = long.copy()
    changed[300] = 7
    other = m.logs(changed, np.array([400]))
    assert np.allclose(logs[:299], other[:299], atol=1e-5) and not np.isclose(logs[299], other[299])
    split = m.logs(np.concatenate([long, long[:2], long[:30]]), np.array([400, 2, 30]))
    assert np.allclose(split[:399], logs, atol=1e-4) and np.allclose(split[399], logs[0], atol=1e-4) and np.allclose(split[400:], logs[:29], atol=1e-4)
    for sizes in ([0], [1], [32], [33], [57], [5000]):
        of, first, size, old = lm_model.windows_of(np.array(sizes))
        assert int((size - old).sum()) == sizes[0]


def test_only_what_was_not_scored_is_computed(model):
    m, flat, _ = model
    ids = flat[: 5 * 32].reshape(5, 32)
    want = m.hidden(ids, np.ones((5, 32), bool))
    for old in (0, 8):
        got = m.fast_hidden(m.wide(), m.slot[ids], old)
        assert got.shape == (5, 32 - old, lm_model.DIM) and np.allclose(got, want[:, old:], atol=1e-5)


def test_scores_far_below_zero_stay_finite(model):
    m, flat, sizes = model
    eye = 40 * np.eye(lm_model.DIM, dtype=np.float32)
    far = lm_model.Model(m.weights | {"q": eye, "k": -eye, "classes": 100 * m.weights["classes"]}, m.slot, m.kind, m.inside)
    logs = far.logs(flat[:200], np.array([200]))
    assert np.isfinite(logs).all() and (logs <= 0).all()
    ids = flat[None, :20]
    loss, grad = far.gradients(ids, np.ones((1, 20), bool), flat[None, 1:21])
    assert np.isfinite(loss) and all(np.isfinite(g).all() for g in grad.values())


def test_one_pass_moves_all_weights(model):
    m, flat, _ = model
    own = lm_model.Model({k: v.copy() for k, v in m.weights.items()}, m.slot, m.kind, m.inside)
    sizes = np.array([100, 60])
    lm_model.fit(own, flat[:160], sizes, 3, 2)
    # Adam as written down, on the same batches
    weights = {k: v.astype(float) for k, v in m.weights.items()}
    plain = lm_model.Model(weights, m.slot, m.kind, m.inside)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    of, first, size, _ = lm_model.windows_of(sizes - 1)
    where = (np.array([0, 100])[of] + first)[:, None] + np.arange(32)
    real = np.arange(32) < size[:, None]
    where = np.where(real, where, 0)
    for step in (1, 2):
        _, grad = plain.gradients(flat[where], real, flat[np.where(real, where + 1, 0)])
        for k, g in grad.items():
            a, b = moments[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            weights[k] = weights[k] - 0.01 * step / 50 * 0.05 ** (step / 2) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
        plain.weights.update(weights)
    assert all(np.allclose(own.weights[k], weights[k], atol=2e-5) for k in weights)


def test_scores_do_not_depend_on_what_lies_around(model):
    m, flat, _ = model
    pick = np.random.default_rng(1)
    parts = [flat[a : a + n] for a, n in zip(pick.integers(0, 300, 200), pick.integers(2, 90, 200))]

    def scored(order):
        logs = m.logs(np.concatenate([parts[i] for i in order]), np.array([len(parts[i]) for i in order]))
        cuts = np.cumsum([len(parts[i]) - 1 for i in order])[:-1]
        return dict(zip(order, (x.tolist() for x in np.split(logs, cuts))))

    want = scored(list(range(200)))
    got = {}
    for order in np.array_split(pick.permutation(200), 7):
        got |= scored(order.tolist())
    assert got == want


def test_gradients(model):
    m, flat, _ = model
    m = lm_model.Model({k: v.astype(np.float64) for k, v in m.weights.items()}, m.slot, m.kind, m.inside)
    ids, target = flat[:24].reshape(3, 8), flat[1:25].reshape(3, 8)
    real = np.arange(8)[None] < np.array([8, 3, 5])[:, None]
    _, grad = m.gradients(ids, real, target)
    for name, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = m.weights[name][at]
        m.weights[name][at] = old + 1e-4
        up = m.gradients(ids, real, target)[0]
        m.weights[name][at] = old - 1e-4
        down = m.gradients(ids, real, target)[0]
        m.weights[name][at] = old
        assert abs((up - down) / 2e-4 - g[at]) < 1e-4 + 0.02 * abs(g[at]), name


def test_windows_repeat_a_quarter_as_context(model):
    _, first, _, old = lm_model.windows_of(np.array([5000]))
    assert (old[1:] >= 8).all() and (np.diff(first) <= 24).all()
    m, flat, _ = model
    long = flat[:200]
    changed = long.copy()
    changed[24] = 7
    # the first fresh position of the second window, 32, still sees input 24
    assert not np.isclose(m.logs(long, np.array([200]))[32], m.logs(changed, np.array([200]))[32], rtol=0, atol=1e-7)


def held_out_gain(spark, docs):
    """Mean by which `score` of a held-out token beats the base, in log10."""
    out = [r for r in lm_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), PATH).collect() if r.held_out]
    return sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)


def test_learns_from_long_texts_alone(spark):
    pick = random.Random(4)
    follows = {w: pick.sample(range(20), 2) for w in range(20)}
    docs, word = [], 0
    for i in range(6):
        out = []
        for _ in range(35_000):
            word = pick.choice(follows[word])
            out.append("w%d" % word)
        docs.append((i, " ".join(out)))
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    assert any(held) and not all(held) and min(len(t) for _, t in docs) > 100_000
    assert held_out_gain(spark, docs) > 0  # without a text to learn from it is -0.3


def test_shards_learn_what_the_start_has_not(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "START_IDS", 500)
    monkeypatch.setattr(lm_scoring, "SHARD_IDS", 4000)
    learnt = []
    average = lm_scoring.moved
    monkeypatch.setattr(lm_scoring, "moved", lambda *a: learnt.append(a[1]) or average(*a))
    rows = [(i, t) for i, t in corpus()] * 4
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = [sorted((r.doc_id, round(r.score, 4)) for r in lm_scores(frame.repartition(n), PATH).collect()) for n in (2, 7)]
    assert out[0] == out[1]
    assert len(learnt) == 2 * lm_scoring.ROUNDS
    encoder = Encoder.get("byte_bpe_50k.json", open(PATH, "rb").read())
    kept = [" ".join(words(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    flat, _ = lm_scoring.sequences_of(encoder, kept, 50256)
    met = np.bincount(flat)
    # every id of the training texts that is there twice was learnt in some round
    assert len(np.setdiff1d(np.unique(np.concatenate(learnt)), [0])) == (met >= 2).sum()


def test_each_id_learnt_once_and_counted(spark):
    texts = ["a b c " * n for n in (0, 1, 400, 2000)]
    encoder = Encoder.get("byte_bpe_50k.json", open(PATH, "rb").read())
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "h long, text string")
    content = spark.sparkContext.broadcast(("byte_bpe_50k.json", open(PATH, "rb").read()))
    pieces = frame.mapInArrow(lm_scoring._cut_ids(content, 50256), "h long, opens boolean, n long, body binary")
    flat, sizes = lm_scoring.sequences_of(encoder, lm_scoring.plain_texts(lm_scoring.pa.array(texts)), 50256)
    assert sum(r.n for r in pieces.collect()) == (sizes - 1).sum()
    got = {r.i: r.n for r in pieces.select("opens", "body").mapInArrow(lm_scoring._id_counts(50257), "i long, n long").groupBy("i").sum("n").toDF("i", "n").collect()}
    assert got == Counter(flat.tolist())


def test_words_that_share_40_bits_are_two(monkeypatch, model):
    content = SimpleNamespace(value=("byte_bpe_50k.json", open(PATH, "rb").read()))
    monkeypatch.setattr(lm_scoring, "_words", lambda texts: (np.array([5, 5 + (1 << 47)], np.uint64), np.array([0, 1, 2])))
    monkeypatch.setattr(lm_scoring.TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    none = np.zeros(0, np.int64)
    know = lm_scoring.Shared(model[0], none.view(np.uint64), none, 4, 2, 50256, np.zeros(50257, bool))
    texts = lm_scoring.pa.RecordBatch.from_pydict({"id": [0, 1], "text": ["x", "y"], "learn": [True, False]})
    scored = list(lm_scoring._score(SimpleNamespace(value=know), content, 1, 1)(iter([texts])))
    rare = [b.select(["bucket", "body"]) for b in scored if b.column("kind")[0].as_py() == 1]
    *sums, met = lm_scoring._rare(4, 1)(iter(rare))
    assert met.column("bucket").to_pylist() == [1]
    # the held-out word is none of the training words
    known = [lm_scoring.unpack(body)[1].tolist() for b in sums for body in b.column("body").to_pylist()]
    assert known == [[1, 0]]
