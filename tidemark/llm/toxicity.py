"""Toxicity of whole texts: a bidirectional GRU with attention pooling over characters and words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, Powers, bytes_of, cut, in_chunks, mix, ranges, words_of

BUCKETS = 1 << 14
VIEWS = 4  # the word, its first 4 bytes, its first 6, its last 4
DIM = 8
HIDDEN = 8
ATTEND = 8
WINDOW = 48
STRIDE = 36
TRAIN_ROWS = 6000  # most labelled rows the model is fitted on, half of them toxic if there are as many
TRAIN_WORDS = 20_000  # a longer text is not taken into the fitting sample
EPOCHS = 6
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def without_marks(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the ASCII marks at their ends, however many; of a word of marks only, the first stays."""
    place = np.arange(len(data))
    real = ~PUNCTUATION[data]
    following = np.minimum.accumulate(np.where(real, place, len(data))[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(real, place, -1))
    inner = np.minimum(following[first], end)
    some = inner < end
    return np.where(some, inner, first), np.where(some, preceding[end - 1] + 1, first + 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word of all texts, one column per view, and where each text begins."""
    data, at = bytes_of(texts)
    data = LOWER[data]
    first, end, start = words_of(data, at)
    first, end = without_marks(data, first, end)
    up, down = Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    spans = [(first, end), (first, np.minimum(end, first + 4)), (first, np.minimum(end, first + 6)), (np.maximum(first, end - 4), end)]
    out = np.empty((len(first), VIEWS), np.int32)
    for i, (a, b) in enumerate(spans):
        out[:, i] = mix((sums[b] - sums[a]) * down[a] + np.uint64(i)) % np.uint64(BUCKETS)
    return out, start


def windows(start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over all words of each text: text, first word, number of words."""
    size = np.diff(start)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(size)), count)
    first = start[:-1][text] + STRIDE * ranges(np.zeros(len(size), np.int64), count)
    return text, first, np.minimum(WINDOW, start[1:][text] - first)


def sigmoid(x):
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    """Weights by name; `constant` is the score of all texts where labels are of one class or none."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    @classmethod
    def fresh(cls, odds: np.ndarray, seed: int) -> Model:
        draw = np.random.default_rng(seed)

        def normal(*shape):
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        table = (0.1 * draw.standard_normal((VIEWS, BUCKETS, DIM))).astype(np.float32)
        table[:, :, 0] = odds
        weights = {"table": table, "attend": normal(2 * HIDDEN, ATTEND), "look": normal(ATTEND), "out": normal(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            weights |= {f"x{side}": normal(DIM, 3 * HIDDEN), f"h{side}": normal(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(weights)

    def forward(self, ids: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; ids are (window, word, view), real tells words from padding."""
        w, n, length = self.weights, ids.shape[0], ids.shape[1]
        x = w["table"][0][ids[:, :, 0]]
        for v in range(1, VIEWS):
            x = x + w["table"][v][ids[:, :, v]]
        mask = real.astype(np.float32)[:, :, None]
        states = np.empty((n, length, 2 * HIDDEN), np.float32)
        trace = {}
        for side, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            gates = np.ascontiguousarray((x @ w[f"x{side}"] + w[f"c{side}"]).transpose(1, 0, 2))
            h = np.zeros((n, HIDDEN), np.float32)
            steps = []
            for t in order:
                inner = h @ w[f"h{side}"]
                zr = sigmoid(gates[t][:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(gates[t][:, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
                moved = (1 - z) * (new - h) * mask[:, t]
                if keep is not None:
                    steps.append((t, h, z, r, new, inner[:, 2 * HIDDEN :]))
                h = h + moved
                states[:, t, (0 if side == "f" else HIDDEN) : (HIDDEN if side == "f" else 2 * HIDDEN)] = h
            trace[side] = steps
        seen = np.tanh(states @ w["attend"])
        score = seen @ w["look"] - 1e4 * (1 - mask[:, :, 0])
        score = np.exp(score - score.max(axis=1, keepdims=True))
        share = score / score.sum(axis=1, keepdims=True)
        pooled = np.einsum("nl,nlh->nh", share, states)
        if keep is not None:
            keep |= {"x": x, "mask": mask, "states": states, "trace": trace, "seen": seen, "share": share, "pooled": pooled}
        return pooled @ w["out"] + w["bias"][0]

    def logits(self, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
        """What `forward` returns, laid out for speed: (word, unit, window), in place."""
        w, n, length = self.weights, ids.shape[0], ids.shape[1]
        turned = ids.transpose(1, 0, 2)
        x = w["table"][0][turned[:, :, 0]]
        for v in range(1, VIEWS):
            x += w["table"][v][turned[:, :, v]]
        x = x.transpose(0, 2, 1)
        mask = real.T.astype(np.float32)
        whole = real.all(axis=0)
        states = np.empty((length, 2 * HIDDEN, n), np.float32)
        with np.errstate(over="ignore"):
            for side, at, order in (("f", 0, range(length)), ("b", HIDDEN, range(length - 1, -1, -1))):
                gates = np.matmul(w[f"x{side}"].T, x)
                gates += w[f"c{side}"][:, None]
                inward = np.ascontiguousarray(w[f"h{side}"].T)
                h = np.zeros((HIDDEN, n), np.float32)
                for t in order:
                    inner, gate, new = inward @ h, gates[t, : 2 * HIDDEN], gates[t, 2 * HIDDEN :]
                    gate += inner[: 2 * HIDDEN]
                    np.negative(gate, gate)
                    np.exp(gate, gate)
                    gate += 1
                    np.reciprocal(gate, gate)
                    inner[2 * HIDDEN :] *= gate[HIDDEN:]
                    new += inner[2 * HIDDEN :]
                    np.tanh(new, new)
                    new -= h
                    new *= 1 - gate[:HIDDEN]
                    if not whole[t]:
                        new *= mask[t]
                    h = np.add(h, new, out=states[t, at : at + HIDDEN])
        seen = np.tanh(np.matmul(w["attend"].T, states))
        score = np.matmul(w["look"], seen) - 1e4 * (1 - mask)
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        return w["out"] @ (states * share[:, None, :]).sum(axis=0) + w["bias"][0]

    def gradients(self, ids: np.ndarray, real: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        w, keep = self.weights, {}
        d_logit = ((sigmoid(self.forward(ids, real, keep)) - label) / len(label)).astype(np.float32)
        grad = {"out": keep["pooled"].T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * w["out"]
        d_states = keep["share"][:, :, None] * d_pooled[:, None, :]
        d_share = np.einsum("nh,nlh->nl", d_pooled, keep["states"])
        d_score = keep["share"] * (d_share - (keep["share"] * d_share).sum(axis=1, keepdims=True))
        grad["look"] = np.einsum("nl,nla->a", d_score, keep["seen"])
        d_seen = d_score[:, :, None] * w["look"] * (1 - keep["seen"] ** 2)
        grad["attend"] = np.einsum("nlh,nla->ha", keep["states"], d_seen)
        d_states += d_seen @ w["attend"].T
        d_x = np.zeros_like(keep["x"])
        for side in "fb":
            own = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, 2 * HIDDEN)
            d_h = np.zeros((len(label), HIDDEN), np.float32)
            grad[f"h{side}"], grad[f"c{side}"] = np.zeros_like(w[f"h{side}"]), np.zeros_like(w[f"c{side}"])
            d_gates = np.empty((*ids.shape[:2], 3 * HIDDEN), np.float32)
            for t, h, z, r, new, inner in reversed(keep["trace"][side]):
                d_h = d_h + d_states[:, t, own]
                d_move = d_h * keep["mask"][:, t]
                d_new = d_move * (1 - z) * (1 - new**2)
                d_z = d_move * (h - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                gate = np.concatenate([d_z, d_r, d_new], axis=1)
                back = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_gates[:, t] = gate
                grad[f"h{side}"] += h.T @ back
                d_h = d_h - d_move * (1 - z) + back @ w[f"h{side}"].T
            grad[f"c{side}"] = d_gates.sum(axis=(0, 1))
            grad[f"x{side}"] = np.einsum("nld,nlg->dg", keep["x"], d_gates)
            d_x += d_gates @ w[f"x{side}"].T
        d_x *= keep["mask"]
        grad["table"] = np.zeros_like(w["table"])
        flat = d_x.reshape(-1, DIM)
        for v in range(VIEWS):
            for j in range(DIM):
                grad["table"][v, :, j] = np.bincount(ids[:, :, v].ravel(), flat[:, j], BUCKETS)
        return grad

    def best(self, feats: np.ndarray, start: np.ndarray, batch: int = 512) -> np.ndarray:
        """Greatest window logit of each text; minus infinity for a text without words."""
        text, first, size = windows(start)
        logit = np.empty(len(text), np.float32)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            spot = np.arange(int(size[pick].max()))[None, :]
            real = spot < size[pick][:, None]
            logit[pick] = self.logits(feats[np.where(real, first[pick][:, None] + spot, 0)], real)
        out = np.full(len(start) - 1, -np.inf)
        np.maximum.at(out, text, logit)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        logit = self.best(*features(texts))
        return np.where(np.isfinite(logit), sigmoid(self.scale * np.where(np.isfinite(logit), logit, 0) + self.shift), 0.0)


def _log_odds(feats, start, label) -> np.ndarray:
    """How much more often toxic texts hold each bucket, by view."""
    text = np.repeat(np.arange(len(label)), np.diff(start))
    out = np.zeros((VIEWS, BUCKETS), np.float32)
    for v in range(VIEWS):
        pair = np.unique(feats[:, v].astype(np.int64) * len(label) + text)
        bucket, toxic = pair // len(label), label[pair % len(label)] == 1
        with_it, without = np.bincount(bucket[toxic], minlength=BUCKETS), np.bincount(bucket[~toxic], minlength=BUCKETS)
        p, n = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
        out[v] = np.clip(np.log((with_it + 0.5) / (p + 1)) - np.log((without + 0.5) / (n + 1)), -3, 5) * ((with_it + without) >= 3)
    return out


def train(feats: np.ndarray, start: np.ndarray, label: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fit on whole labelled texts: the windows richest in telling words stand for their text, and any window for a clean one."""
    if len(set(label.tolist())) < 2:
        return Model({}, constant=float(label.mean()) if len(label) else 0.0)
    draw = np.random.default_rng(seed)
    odds = _log_odds(feats, start, label)
    model = Model.fresh(odds, seed)
    telling = np.sum([odds[v][feats[:, v]] for v in range(VIEWS)], axis=0)
    text, first, size = windows(start)
    peak = np.array([telling[a : a + n].max() for a, n in zip(first.tolist(), size.tolist())])
    order = np.lexsort((-peak, text))
    rank = np.empty(len(text), np.int64)
    rank[order] = ranges(np.zeros(len(start), np.int64), np.bincount(text, minlength=len(start)))
    pool = np.flatnonzero(rank < 2)
    others = np.flatnonzero((rank >= 2) & (label[text] == 0))
    moments: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.weights.items()}
    step = 0
    epochs = max(epochs, min(60, 40_000 // max(1, len(pool))))  # few labels are gone over more often
    for epoch in range(epochs):
        some = draw.permutation(others)[: len(pool) // 2]
        hard = pool[(label[text[pool]] == 0) | (rank[pool] == 0)]
        chosen = draw.permutation(np.concatenate([hard, some]))
        rate = 0.01 * 0.05 ** (epoch / epochs)
        for a in range(0, len(chosen), 128):
            pick = chosen[a : a + 128]
            spot = np.arange(WINDOW)[None, :]
            real = spot < size[pick][:, None]
            ids = feats[np.where(real, first[pick][:, None] + spot, 0)]
            step += 1
            for name, g in model.gradients(ids, real, label[text[pick]].astype(np.float32)).items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.weights[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    logit = model.best(feats, start)
    fine = np.isfinite(logit)
    x, y = np.clip(logit[fine], -15, 15), label[fine]
    a, b = 1.0, 0.0
    for _ in range(400):  # the greatest of many windows is calibrated on whole texts
        gap = sigmoid(a * x + b) - y
        a, b = max(0.05, a - 0.05 * float((gap * x).mean()) - 1e-4 * a), b - 0.2 * float(gap.mean())
    model.scale, model.shift = a, b
    return model


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: int = TRAIN_ROWS, longest: int = TRAIN_WORDS, seed: int = 7,
) -> Model:
    """A model from at most `rows` labelled texts (of at most `longest` words), all outside the held-out fifth.

    Held out is an id whose crc32 as text leaves 0 when divided by 5. The sample takes
    the least hashes of ids, half of it toxic where there are enough. Where an id has several
    texts all carry its label; of more than `2 * rows` texts those of the least hashes stay.
    """
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(
        F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.max("label").alias("label"))
    half = rows // 2
    sample = [ids.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(half) for k in (0, 1)]
    wanted = sample[0].unionByName(sample[1])
    # at most `rows` rows of two numbers: small whatever the tables hold
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(wanted), "id").where(F.length("text") <= 12 * longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            feats, start = features(batch.column("text"))
            parts = [feats[a:b].astype("<u2").tobytes() for a, b in zip(start[:-1], start[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(parts, pa.binary())], ["id", "label", "feats"])

    # a repeated id may have any number of rows: tasks keep 2 * rows at most, and the driver reads as many from a table
    least = texts.mapInArrow(run, "id long, label int, feats binary").orderBy(F.xxhash64("id"), "id", F.xxhash64("feats")).limit(2 * rows)
    found = cut(least, "toxicity").toArrow()
    order = np.argsort(found.column("id").to_numpy(), kind="stable")
    parts = [np.frombuffer(found.column("feats")[int(i)].as_py(), "<u2").reshape(-1, VIEWS).astype(np.int32) for i in order]
    keep = [i for i, p in enumerate(parts) if len(p) <= longest]
    label = found.column("label").to_numpy()[order][keep].astype(np.int64)
    parts = [parts[i] for i in keep]
    feats = np.concatenate(parts) if parts else np.zeros((0, VIEWS), np.int32)
    start = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return train(feats, start, label, seed)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id and `score`, the calibrated greatest logit over all overlapping windows.

    A text without words, empty or null, scores 0. Repeated rows are all returned; a null id
    stays null; an empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of a fixed size, 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(shared.value.scores(batch.column("text")).astype(float))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, score double").select(F.col("id").alias(id_col), "score")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids with `held_out`, `score` and `predicted` (1 from a score of 0.5 on), from a model fitted on `labels`.

    Without labels of both classes every score is the share of toxic labels (0 without any).
    """
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(
        id_col, F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores below 0.5, with all their columns."""
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, text_col, 1 << 20):
            texts = batch.column(text_col).cast(pa.string()).fill_null("")
            yield batch.filter(pa.array(shared.value.scores(texts) < 0.5))

    return docs.mapInArrow(run, docs.schema)
