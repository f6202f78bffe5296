"""A small causal self-attention model over subword ids, in numpy, with a class-factored output."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.llm.common import runs_of

DIM = 16
INNER = 32
WINDOW = 32
FRESH = 24  # positions a window adds; the others repeat as context
CLASSES = 128
ALONE = 64  # most frequent ids that are a class of their own
CONTEXT_IDS = 128
BATCH = 128
SCORED = 128  # windows scored at a time
EPOCHS = 2
LARGEST = 60  # of a logit
ALIKE = 8  # widths of windows are multiples of it


def windows_of(sizes: np.ndarray, fresh: int = FRESH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over sequences of `sizes` inputs: sequence, first input, number of inputs, how many of them were scored before."""
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // fresh)), 0)
    of = np.repeat(np.arange(len(sizes)), count)
    rank = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first = rank * fresh
    return of, first, np.minimum(WINDOW, sizes[of] - first), np.where(rank > 0, WINDOW - fresh, 0)


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    slot: np.ndarray  # row of the embedding for each id; 0 for ids met less than twice
    kind: np.ndarray  # class of each id
    inside: np.ndarray  # log probability of each id in its class

    def hidden(self, ids: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        w = self.weights
        n, length = ids.shape
        x = w["embed"][self.slot[ids]] + w["place"][:length]
        q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
        score = np.matmul(q, k.transpose(0, 2, 1))
        score *= np.float32(1 / np.sqrt(DIM))
        score += np.triu(np.full((length, length), -1e9, np.float32), 1)
        score -= score.max(axis=2, keepdims=True)
        np.exp(score, score)
        score /= score.sum(axis=2, keepdims=True)
        mixed = np.matmul(score, v)
        y = x + mixed @ w["o"]
        inner = np.maximum(y @ w["up"] + w["up0"], 0)
        z = y + inner @ w["down"]
        if keep is not None:
            keep |= {"x": x, "q": q, "k": k, "v": v, "share": score, "mixed": mixed, "y": y, "inner": inner, "z": z}
        return z

    def class_logs(self, z: np.ndarray) -> np.ndarray:
        logit = z @ self.weights["classes"] + self.weights["classes0"]
        logit -= logit.max(axis=-1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(axis=-1, keepdims=True))

    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the embedding and of the places, each beside its products with `near` and `told`, and a one at the end."""
        whole = np.concatenate([np.eye(DIM, dtype=np.float32), *self.products(), np.zeros((DIM, 1), np.float32)], axis=1)
        embed = self.weights["embed"] @ whole
        embed[:, -1] = 1
        return embed, self.weights["place"] @ whole

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """`near`: what stands between two inputs in their attention score; `told`: what an input adds where it is attended to."""
        w = self.weights
        return w["q"] @ w["k"].T / w["q"].dtype.type(np.sqrt(DIM)), w["v"] @ w["o"]

    def fast_hidden(self, wide: tuple[np.ndarray, np.ndarray], slots: np.ndarray, old: int) -> np.ndarray:
        """What `hidden` returns from input `old` of each window on."""
        w = self.weights
        n, length = slots.shape
        rows = wide[0].take(slots, 0)
        rows += wide[1][:length]
        x, asked, told = rows[:, :, :DIM], rows[:, old:, DIM : 2 * DIM], rows[:, :, 2 * DIM :]
        score = np.matmul(asked, x.transpose(0, 2, 1))
        np.exp(hold(score, bound(asked, x)), out=score)
        score *= np.tri(length, dtype=score.dtype)[old:]
        mixed = np.matmul(score, told)  # sums of the scores come out beside it
        z = mixed[:, :, :DIM] / mixed[:, :, DIM:]
        z += x[:, old:]
        inner = np.matmul(z, w["up"])
        inner += w["up0"]
        np.maximum(inner, 0, out=inner)
        z += np.matmul(inner, w["down"])
        return z

    def gradients(self, ids, real, target) -> tuple[float, dict[str, np.ndarray]]:
        """Mean class loss over real positions, and its gradients.

        Shares are kept as exponentials over their sums, so that the large arrays (inputs by
        inputs, positions by classes) are read as seldom as may be.
        """
        w = self.weights
        n, length = ids.shape
        total = max(1, int(real.sum()))
        rows, real, want = self.slot[ids].ravel(), real.ravel(), self.kind[target].ravel()
        x = w["embed"].take(rows, 0).reshape(n, length, DIM)
        x += w["place"][:length]
        products = np.concatenate(self.products(), axis=1)
        both = (x.reshape(-1, DIM) @ products).reshape(n, length, 2 * DIM)
        asked, told = both[:, :, :DIM], both[:, :, DIM:]
        score = np.matmul(asked, x.transpose(0, 2, 1))
        np.exp(hold(score, bound(asked, x)), out=score)
        score *= np.tri(length, dtype=score.dtype)
        below = (score.reshape(-1, length) @ np.ones(length, score.dtype)).reshape(n, length, 1)
        mixed = np.matmul(score, told)
        mixed /= below
        y = (x + mixed).reshape(-1, DIM)
        inner = y @ w["up"]
        inner += w["up0"]
        np.maximum(inner, 0, out=inner)
        z = y + inner @ w["down"]

        e, own, at = hold(z @ w["classes"], bound(z, w["classes"].T)), np.exp(w["classes0"]), np.arange(len(z))
        chosen = e[at, want] + w["classes0"][want]
        np.exp(e, out=e)
        sums = e @ own
        loss = -float((chosen - np.log(sums))[real].sum()) / total
        # the gradient of a logit is e * own * part, the wanted one's less by 1 / total
        e[at, want] -= sums / own[want]
        part = real / (sums * total)
        part = part.astype(e.dtype)[:, None]
        grad = {"classes": (e.T @ (z * part)).T * own, "classes0": part[:, 0] @ e * own}
        d_z = e @ (w["classes"] * own).T
        d_z *= part
        d_inner = d_z @ w["down"].T
        d_inner *= inner > 0
        grad |= {"down": inner.T @ d_z, "up": y.T @ d_inner, "up0": np.ones(len(z), z.dtype) @ d_inner}
        d_y = (d_z + d_inner @ w["up"].T).reshape(n, length, DIM)
        d_mixed = d_y / below
        d_score = np.matmul(d_mixed, told.transpose(0, 2, 1))
        d_score -= np.einsum("nij,nij->ni", d_mixed, mixed)[:, :, None]
        d_score *= score
        d_both = np.empty_like(both)
        d_both[:, :, :DIM] = np.matmul(d_score, x)
        d_both[:, :, DIM:] = np.matmul(score.transpose(0, 2, 1), d_mixed)
        flat = d_both.reshape(-1, 2 * DIM)
        d_products = x.reshape(-1, DIM).T @ flat
        d_near, d_told = d_products[:, :DIM] / w["q"].dtype.type(np.sqrt(DIM)), d_products[:, DIM:]
        grad |= {"q": d_near @ w["k"], "k": d_near.T @ w["q"], "v": d_told @ w["o"].T, "o": w["v"].T @ d_told}
        d_x = np.matmul(d_score.transpose(0, 2, 1), asked)
        d_x += d_y
        d_x += (flat @ products.T).reshape(n, length, DIM)
        grad["place"] = np.zeros_like(w["place"])
        grad["place"][:length] = d_x.sum(axis=0)
        cells = (rows[:, None] * DIM + np.arange(DIM)).ravel()
        grad["embed"] = np.bincount(cells, d_x.ravel(), w["embed"].size).reshape(-1, DIM).astype(w["embed"].dtype)
        return loss, grad

    def logs(self, sequences: np.ndarray, sizes: np.ndarray, wide: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Natural log probability of every id after the first of each sequence; sequences lie one after the other.

        Long sequences are read in overlapping windows; every id is scored once, with the
        context of the window it is fresh in. `wide` is what `wide()` returns.
        """
        wide = wide or self.wide()
        start = np.cumsum(sizes) - sizes
        inputs = np.maximum(sizes - 1, 0)
        of, first, size, old = windows_of(inputs)
        begin = start[of] + first
        out_at = (np.cumsum(inputs) - inputs)[of] + first
        out = np.empty(int(inputs.sum()))
        # a window's products are its own and as wide as its size asks for, so that they round alike whatever lies around it
        width = np.minimum(WINDOW, -(-size // ALIKE) * ALIKE)
        order = np.lexsort((width, old))
        slots, kinds, own = self.slot[sequences], self.kind[sequences], np.exp(self.weights["classes0"])
        blocks = [(a, min(a + SCORED, first + n)) for first, n in zip(*runs_of((old * WINDOW + width)[order])) for a in range(first, first + n, SCORED)]
        for a, b in blocks:
            pick = order[a:b]
            known, spot = int(old[pick[0]]), np.arange(int(width[pick[0]]))
            where = np.minimum(begin[pick][:, None] + spot, len(sequences) - 2)
            z = self.fast_hidden(wide, slots[where], known)
            logit = hold(np.matmul(z, self.weights["classes"]).reshape(-1, CLASSES), bound(z, self.weights["classes"].T))
            wanted = kinds[where[:, known:] + 1].ravel()
            chosen = logit[np.arange(len(wanted)), wanted] + self.weights["classes0"][wanted]
            np.exp(logit, out=logit)
            chosen -= np.log(logit @ own)
            real = (spot < size[pick][:, None])[:, known:]
            fresh = (out_at[pick][:, None] + spot)[:, known:]
            out[fresh[real]] = chosen[real.ravel()]
        return out + np.delete(self.inside[sequences], start[sizes > 0])


def bound(a: np.ndarray, b: np.ndarray) -> float:
    """No product of a row of `a` and a row of `b` is above it."""
    return float(np.sqrt(np.einsum("...i,...i", a, a).max(initial=0) * np.einsum("...i,...i", b, b).max(initial=0)))


def hold(logit: np.ndarray, most: float) -> np.ndarray:
    """Logits of at most `most`, in place; beyond 60, far above what is seen, they are cut off so that no sum overflows or is zero."""
    return logit if most < LARGEST else np.clip(logit, -LARGEST, LARGEST, out=logit)


def near_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each of the most frequent ids, -1 for all others."""
    near = np.full(len(counts), -1)
    top = np.argsort(-counts, kind="stable")[:CONTEXT_IDS]
    near[top] = np.arange(len(top))
    return near


def context_cells(sequence: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and what stands beside them: the rank of the frequent id before, and CONTEXT_IDS on, of the one after."""
    before, after = near[sequence[:-1]], near[sequence[1:]]
    ids = np.concatenate([sequence[1:][before >= 0], sequence[:-1][after >= 0]])
    return ids, np.concatenate([before[before >= 0], after[after >= 0] + CONTEXT_IDS])


def profiles_of(cells: np.ndarray) -> np.ndarray:
    """Roots of the shares of what stands beside an id, a row per id."""
    return np.sqrt(cells / np.maximum(cells.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def classes_of(counts: np.ndarray, profiles: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot, class and log probability inside the class of every id, from its count and what stands beside it.

    The most frequent ids stand alone; the others are grouped by what they follow and what
    follows them, by k-means; ids met less than twice share the last class.
    """
    vocabulary = len(counts)
    seen = np.flatnonzero(counts >= 2)
    slot = np.zeros(vocabulary, np.int32)
    slot[seen] = np.arange(1, len(seen) + 1)
    by_count = np.argsort(-counts, kind="stable")
    kind = np.full(vocabulary, CLASSES - 1, np.int32)
    alone = by_count[:ALONE][counts[by_count[:ALONE]] >= 2]
    rest = np.setdiff1d(seen, alone)
    if len(rest):
        x = profiles[rest]
        groups = min(CLASSES - 1 - ALONE, len(rest))
        draw = np.random.default_rng(seed)
        weight = counts[rest].astype(float)
        centre = x[draw.choice(len(rest), groups, replace=False, p=weight / weight.sum())]
        for _ in range(8):
            label = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
            for g in range(groups):
                mine = label == g
                if mine.any():
                    centre[g] = np.average(x[mine], axis=0, weights=np.sqrt(weight[mine]))
        kind[rest] = ALONE + label
    kind[alone] = np.arange(len(alone))
    mass = counts + 0.5 * (kind == CLASSES - 1)
    per_class = np.bincount(kind, mass, CLASSES)
    with np.errstate(divide="ignore"):
        inside = np.log(mass) - np.log(per_class[kind])
    return slot, kind, inside


def fresh_model(counts: np.ndarray, profiles: np.ndarray, seed: int = 5) -> Model:
    """A model that has learnt no windows yet."""
    draw = np.random.default_rng(seed)
    slot, kind, inside = classes_of(counts, profiles, seed)

    def normal(*shape):
        return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    weights = {
        "embed": (0.3 * draw.standard_normal((int(slot.max()) + 1, DIM))).astype(np.float32), "place": np.zeros((WINDOW, DIM), np.float32),
        "q": normal(DIM, DIM), "k": normal(DIM, DIM), "v": normal(DIM, DIM), "o": normal(DIM, DIM), "up": normal(DIM, INNER),
        "up0": np.zeros(INNER, np.float32), "down": normal(INNER, DIM), "classes": normal(DIM, CLASSES), "classes0": np.zeros(CLASSES, np.float32)}
    return Model(weights, slot, kind, inside)


def fit(model: Model, sequences: np.ndarray, sizes: np.ndarray, seed: int, epochs: int, top: float = 0.01, fall: float = 0.05, fresh: int = FRESH) -> None:
    """Go `epochs` times over the windows of sequences lying one after the other; the rate falls from `top` by `fall`."""
    draw, weights = np.random.default_rng(seed), model.weights
    start, inputs = np.cumsum(sizes) - sizes, np.maximum(sizes - 1, 0)
    of, first, size, _ = windows_of(inputs, fresh)
    begin = start[of] + first
    names, rest = list(weights), np.concatenate([w.ravel() for w in weights.values()])
    at = 0
    for name in names:  # views, so that one pass moves them all
        weights[name] = rest[at : at + weights[name].size].reshape(weights[name].shape)
        at += weights[name].size
    m, v, change = np.zeros_like(rest), np.zeros_like(rest), np.empty_like(rest)
    step, steps = 0, epochs * (-(-len(of) // BATCH))
    for _ in range(epochs):
        order = draw.permutation(len(of))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            spot = np.arange(int(size[pick].max()))[None, :]
            real = spot < size[pick][:, None]
            where = np.where(real, begin[pick][:, None] + spot, 0)
            _, grad = model.gradients(sequences[where], real, sequences[np.where(real, where + 1, 0)])
            g = np.concatenate([grad[name].ravel() for name in names])
            step += 1
            rate = top * min(1, step / 50) * fall ** (step / steps)
            m += np.multiply(np.subtract(g, m, out=change), 0.1, out=change)
            np.multiply(g, g, out=g)
            v += np.multiply(np.subtract(g, v, out=change), 0.01, out=change)
            np.sqrt(v, out=change)
            change *= float(1 / np.sqrt(1 - 0.99**step))
            change += 1e-7
            np.divide(m, change, out=change)
            change *= rate / (1 - 0.9**step)
            rest -= change


def start_fit(model: Model, sequences: np.ndarray, sizes: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> None:
    """Fit from nothing; few windows are gone over more often."""
    count = len(windows_of(np.maximum(sizes - 1, 0))[0])
    fit(model, sequences, sizes, seed, max(epochs, min(80, 150 * BATCH // max(1, count))))


def train(sequences: np.ndarray, sizes: np.ndarray, vocabulary: int, seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Fit on sequences that begin and end with the end id, lying one after the other."""
    counts = np.bincount(sequences, minlength=vocabulary)
    cells = np.zeros((vocabulary, 2 * CONTEXT_IDS), np.float32)
    np.add.at(cells, context_cells(sequences, near_of(counts)), 1)
    model = fresh_model(counts, profiles_of(cells), seed)
    start_fit(model, sequences, sizes, seed, epochs)
    return model


def learn_apart(model: Model, sequences: np.ndarray, sizes: np.ndarray, seed: int, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Learn every id after the first of each sequence once, from the given weights, which stay as they are.

    Returned: rows of the embedding that were read, how often, their change, the change of
    all other weights one after the other, the number of ids learnt.
    """
    rows, at, n = np.unique(model.slot[sequences], return_inverse=True, return_counts=True)
    slot = np.zeros_like(model.slot)
    slot[sequences] = at
    own = Model({k: (v[rows] if k == "embed" else v.copy()) for k, v in model.weights.items()}, slot, model.kind, model.inside)
    fit(own, sequences, sizes, seed, 1, top, 0.3, WINDOW)
    others = np.concatenate([(own.weights[k] - v).ravel() for k, v in model.weights.items() if k != "embed"])
    return rows, n, own.weights["embed"] - model.weights["embed"][rows], others, int(np.maximum(sizes - 1, 0).sum())


def moved(model: Model, rows: np.ndarray, change: np.ndarray, others: np.ndarray) -> Model:
    """The model with changes added to its weights."""
    weights, at = {}, 0
    for name, old in model.weights.items():
        weights[name] = old.copy()
        if name == "embed":
            weights[name][rows] += change
        else:
            weights[name] += others[at : at + old.size].reshape(old.shape)
            at += old.size
    return Model(weights, model.slot, model.kind, model.inside)
