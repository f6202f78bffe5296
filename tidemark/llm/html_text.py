"""Main text of web pages: a bidirectional LSTM reads the blocks of a page in order and labels each."""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_chunks, least_hashes

BUCKETS = 4096
DIM = 12
EXTRA = 4
HIDDEN = 12
SAMPLE_PAGES = 300  # most given pages the labeller is fitted on
SAMPLE_LENGTH = 100_000  # characters; a longer page is not in the fitting sample
MADE_PAGES = 700
EPOCHS = 12
BATCH_PAGES = 128

TAG = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
BARE = re.compile(r"[^>\"']*")
# Elements whose content is no text.
RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea")}
TRAIL = 32  # elements above a block that its path names, the nearest
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split())
FOREIGN = frozenset("svg math".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("article aside body div footer form header html main nav ol section table td th tr ul dl figure blockquote".split())
# What the made pages call their parts.
MAIN_NAMES = ["content", "post", "entry", "story", "article-body", "main-text", "post-content", "text"]
OTHER_PARTS = {
    "nav": ["menu", "nav", "navbar", "breadcrumb", "topbar"], "aside": ["sidebar", "widget", "related", "rail"],
    "footer": ["footer", "copyright", "bottom"], "header": ["header", "masthead", "site-header", "banner"],
    "div": ["ad", "ads", "advert", "sponsor", "promo", "cookie-notice", "notice", "consent", "newsletter", "share", "popup"],
    "section": ["comments", "comment-list", "replies", "responses", "discussion"], "form": ["search", "login", "subscribe", "contact-form"],
}


@dataclass
class Block:
    path: tuple[str, ...]
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def markup(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Begin, end, tag, whether it closes, and attributes of all markup in order; comments and declarations have no tag.

    One pass that never goes back, whatever is left open: a quote that nothing closes ends
    with the next `>`, and a tag, comment or declaration that nothing closes is the rest of
    the page. A raw element is one piece with its content, as an opening tag.
    """
    size = len(page)
    unclosed: set[str] = set()

    def found(what: str, at: int) -> int:
        """Where `what` is next; what is not there is not looked for again."""
        if what in unclosed:
            return -1
        where = page.find(what, at)
        if where < 0:
            unclosed.add(what)
        return where

    at = 0
    while (begin := found("<", at)) >= 0:
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if page.startswith(opening, begin):
                where = found(closing, begin + len(opening))
                at = size if where < 0 else where + len(closing)
                yield begin, at, None, False, ""
                break
        else:
            name = TAG.match(page, begin + 1)
            if name is None:
                at = begin + 1
                continue
            at = name.end()
            while True:
                at = BARE.match(page, at).end()
                if at >= size or page[at] == ">":
                    break
                close = found(page[at], at + 1)
                if close < 0:
                    close = found(">", at)
                    at = size if close < 0 else close
                    break
                at = close + 1
            attributes, tag, closes = page[name.end() : at], name[1].lower(), page[begin + 1] == "/"
            at = min(at + 1, size)
            if tag in RAW_ENDS and not closes:
                end = RAW_ENDS[tag].search(page, at)
                at = size if end is None else end.end()
            yield begin, at, tag, closes, attributes


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """Text blocks of a page in order: text, the path of tags and names above it, characters inside links.

    Inline tags do not end a block; block tags and line breaks do. Scripts, styles,
    text areas, comments and declarations are no text; every other element is read, and the
    path says where. Open tags left open are closed by
    what cannot stand in them.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: dict[str, int] = {}
    now = Block(())

    def add(raw: str) -> None:
        text = references.unescape(raw) if "&" in raw else raw
        if not now.pieces:
            now.path = tuple(n for tag, names in stack[-TRAIL:] if tag not in INLINE for n in (tag, *names))
        now.pieces.append(text)
        if opened.get("a"):
            now.linked += len(text)

    def turn() -> None:
        nonlocal now
        if any(p and not p.isspace() for p in now.pieces):
            out.append(now)
        now = Block(())

    def push(tag: str, names: tuple[str, ...]) -> None:
        stack.append((tag, names))
        opened[tag] = opened.get(tag, 0) + 1

    def cut_to(depth: int) -> None:
        for tag, _ in stack[depth:]:
            opened[tag] -= 1
        del stack[depth:]

    at = 0
    for begin, end, tag, closes, attributes in markup(page):
        if begin > at:
            add(page[at:begin])
        at = end
        if tag is None:
            continue
        if tag in RAW_ENDS and not closes:
            turn()
            continue
        if closes:
            if opened.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        cut_to(i)
                        break
                    if stack[i][0] in HOLDS and tag not in HOLDS:
                        break
            if tag not in INLINE:
                turn()
            continue
        alone = attributes.rstrip().endswith("/")
        if tag in INLINE:
            if tag not in VOID and not alone:
                push(tag, ())
            continue
        foreign = tag in FOREIGN or any(opened.get(t) for t in FOREIGN)
        turn()
        if tag not in VOID and not (foreign and alone):
            ends = CLOSES.get(tag, set()) | {"p"} if tag != "br" and not foreign else set()
            if any(opened.get(t) for t in ends):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        cut_to(i)
                        break
                    if stack[i][0] in HOLDS and stack[i][0] not in ("tr",):
                        break
            names = tuple("." + n for value in NAMES.findall(attributes) for n in NAME.findall(value.lower())) if attributes else ()
            push(tag, names)
    if at < len(page):
        add(page[at:])
    turn()
    return [(text, b.path, b.linked) for b in out if (text := b.text())]


class Reader:
    """Numbers of the blocks of pages: buckets of path names and words, and a few measures."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], list[int]] = {}

    def read(self, pages: list[list[tuple[str, tuple[str, ...], int]]]):
        names, name_at, words, word_at, extra = [], [0], [], [0], []
        for page in pages:
            for k, (text, path, linked) in enumerate(page):
                if path not in self.paths:
                    if len(self.paths) > 20_000:
                        self.paths.clear()
                    trail = [crc32(n.encode()) % BUCKETS for n in path] + [crc32("/".join(path[-3:]).encode()) % BUCKETS]
                    self.paths[path] = trail
                names += self.paths[path]
                name_at.append(len(names))
                words += [crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in text.lower().split()]
                word_at.append(len(words))
                extra.append((np.log1p(len(text)) / 8, linked / max(1, len(text)), k / len(page), text[-1:] in ".!?:;\"'"))
        return (np.array(names, np.int64), np.array(name_at), np.array(words, np.int64), np.array(word_at),
                np.array(extra, np.float32).reshape(-1, EXTRA), np.array([len(p) for p in pages], np.int64))


def sigmoid(x):
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _means(table, ids, at):
    if len(at) == 1:
        return np.zeros((0, table.shape[1]), np.float32)
    return np.add.reduceat(table[ids], at[:-1], axis=0) / np.diff(at)[:, None].astype(np.float32)


@dataclass
class Labeller:
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        draw = np.random.default_rng(seed)
        width = 2 * DIM + EXTRA

        def normal(*shape):
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        weights = {"names": (0.3 * draw.standard_normal((BUCKETS, DIM))).astype(np.float32),
                   "words": (0.05 * draw.standard_normal((BUCKETS, DIM))).astype(np.float32),
                   "out": normal(2 * HIDDEN), "skip": normal(width), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            weights |= {f"x{side}": normal(width, 4 * HIDDEN), f"h{side}": normal(HIDDEN, 4 * HIDDEN), f"c{side}": np.zeros(4 * HIDDEN, np.float32)}
        return cls(weights)

    def forward(self, read, keep: dict | None = None) -> np.ndarray:
        """Logit of every block, pages side by side as rows of a padded batch."""
        names, name_at, words, word_at, extra, sizes = read
        w = self.weights
        total, longest = int(sizes.sum()), int(sizes.max(initial=0))
        x = np.concatenate([_means(w["names"], names, name_at), _means(w["words"], words, word_at), extra], axis=1)
        real = np.arange(longest)[None, :] < sizes[:, None]
        padded = np.zeros((len(sizes), longest, x.shape[1]), np.float32)
        padded[real] = x
        states = np.zeros((len(sizes), longest, 2 * HIDDEN), np.float32)
        trace = {}
        n = HIDDEN
        for side, order in (("f", range(longest)), ("b", range(longest - 1, -1, -1))):
            gates = padded @ w[f"x{side}"] + w[f"c{side}"]
            h = np.zeros((len(sizes), n), np.float32)
            c = np.zeros((len(sizes), n), np.float32)
            steps = []
            for t in order:
                g = gates[:, t] + h @ w[f"h{side}"]
                ifo, new = sigmoid(g[:, : 3 * n]), np.tanh(g[:, 3 * n :])
                i, f, o = ifo[:, :n], ifo[:, n : 2 * n], ifo[:, 2 * n :]
                m = real[:, t : t + 1].astype(np.float32)
                cell = (f * c + i * new) * m
                squashed = np.tanh(cell)
                if keep is not None:
                    steps.append((t, h, c, i, f, o, new, squashed, m))
                h, c = o * squashed * m, cell
                states[:, t, (0 if side == "f" else n) : (n if side == "f" else 2 * n)] = h
            trace[side] = steps
        flat = states[real]
        if keep is not None:
            keep |= {"x": x, "padded": padded, "real": real, "trace": trace, "flat": flat}
        return flat @ w["out"] + x @ w["skip"] + w["bias"][0] if total else np.zeros(0, np.float32)

    def gradients(self, read, label: np.ndarray) -> dict[str, np.ndarray]:
        names, name_at, words, word_at, _, sizes = read
        w, keep, n = self.weights, {}, HIDDEN
        d = ((sigmoid(self.forward(read, keep)) - label) / max(1, len(label))).astype(np.float32)
        grad = {"out": keep["flat"].T @ d, "skip": keep["x"].T @ d, "bias": d.sum(keepdims=True)}
        d_states = np.zeros((*keep["real"].shape, 2 * n), np.float32)
        d_states[keep["real"]] = d[:, None] * w["out"]
        d_padded = np.zeros_like(keep["padded"])
        for side in "fb":
            own = slice(0, n) if side == "f" else slice(n, 2 * n)
            d_h, d_c = np.zeros((len(sizes), n), np.float32), np.zeros((len(sizes), n), np.float32)
            grad[f"h{side}"] = np.zeros_like(w[f"h{side}"])
            d_gates = np.zeros((*keep["real"].shape, 4 * n), np.float32)
            for t, h, c, i, f, o, new, squashed, m in reversed(keep["trace"][side]):
                d_h = (d_h + d_states[:, t, own]) * m
                d_cell = (d_c + d_h * o * (1 - squashed**2)) * m
                d_g = np.concatenate([d_cell * new * i * (1 - i), d_cell * c * f * (1 - f), d_h * squashed * o * (1 - o), d_cell * i * (1 - new**2)], axis=1)
                d_gates[:, t] = d_g
                grad[f"h{side}"] += h.T @ d_g
                d_h, d_c = d_g @ w[f"h{side}"].T, d_cell * f
            grad[f"c{side}"] = d_gates.sum(axis=(0, 1))
            grad[f"x{side}"] = np.einsum("nld,nlg->dg", keep["padded"], d_gates)
            d_padded += d_gates @ w[f"x{side}"].T
        d_x = d_padded[keep["real"]] + d[:, None] * w["skip"]
        for name, ids, at, part in (("names", names, name_at, d_x[:, :DIM]), ("words", words, word_at, d_x[:, DIM : 2 * DIM])):
            grad[name] = np.zeros_like(w[name])
            size = np.diff(at)
            np.add.at(grad[name], ids, np.repeat(part / size[:, None], size, axis=0))
        return grad

    def texts(self, pages: list[str], reader: Reader) -> list[str]:
        """The blocks labelled as main text of each page, in order, joined by one space."""
        found = [blocks(p) for p in pages]
        out = []
        for a in range(0, len(found), BATCH_PAGES):
            part = found[a : a + BATCH_PAGES]
            logit = iter(self.forward(reader.read(part)).tolist())
            out += [" ".join([b[0] for b in page if next(logit) > 0]) for page in part]
        return out


def known_label(path: tuple[str, ...]) -> int:
    """Whether the elements and names above a block mark it as main text: the labels of given pages."""
    bad = {"nav", "header", "footer", "aside", "form", "head", "title", "button", "figcaption"}
    bad |= {"." + n for names in OTHER_PARTS.values() for name in names for n in name.split("-") if n not in ("list", "contact", "site")}
    good = {"article", "main", *("." + n for name in MAIN_NAMES for n in [name.split("-")[0]])}
    inside = [n for n in path if n in good or n in bad]
    return int(bool(inside) and not any(n in bad for n in path))


def made_page(draw: random.Random, lines: list[str]) -> tuple[str, list[int]]:
    """A page in a layout of its own, from given lines, and the label of each block."""
    label: list[int] = []

    def some(lo: int, hi: int, short: bool) -> list[str]:
        picked = [draw.choice(lines).split() for _ in range(draw.randint(lo, hi))]
        return [references.escape(" ".join(w[: draw.randint(1, 4)] if short else w[: draw.randint(3, 60)])) for w in picked if w]

    def other(tag: str) -> str:
        name = draw.choice(OTHER_PARTS[tag])
        outer = tag if draw.random() < 0.6 else "div"
        listed = tag in ("nav", "aside") and draw.random() < 0.8
        parts = some(1, 6, listed or draw.random() < 0.5)
        label.extend([0] * len(parts))
        inner = "".join(f"<li><a href='/x'>{p}</a></li>" if listed else f"<p>{p}</p>" for p in parts) if len(parts) > 1 else "".join(parts)
        mark = f' {draw.choice(["class", "id"])}="{name}"' if outer == "div" or draw.random() < 0.6 else ""
        return f"<{outer}{mark}>{'<ul>' * listed}{inner}{'</ul>' * listed}</{outer}>"

    def body() -> str:
        outer = draw.choice(["article", "main", "div", "section"])
        mark = f' class="{draw.choice(MAIN_NAMES)}"' if outer in ("div", "section") or draw.random() < 0.4 else ""
        parts = []
        for k, p in enumerate(some(1, 12, False)):
            label.append(1)
            parts.append(f"<h1>{p}</h1>" if k == 0 and draw.random() < 0.7 else f"<{draw.choice(['p', 'p', 'p', 'h2', 'li', 'blockquote'])}>{p}")
            if draw.random() < 0.05:
                parts.append(other(draw.choice(["div", "aside", "form"])))
        return f"<{outer}{mark}>{''.join(parts)}</{outer}>"

    title = some(1, 1, True)
    label.extend([0] * len(title))
    page = f"<html><head><title>{''.join(title)}</title></head><body>"
    for tag in draw.sample(["nav", "header", "div", "aside", "form"], draw.randint(0, 4)):
        page += other(tag)
    wrapped = draw.random() < 0.3
    page += "<div class='wrapper'>" * wrapped + body() + "</div>" * wrapped
    for tag in draw.sample(["section", "footer", "aside", "div", "nav"], draw.randint(0, 4)):
        page += other(tag)
    return page, label


def train(pages: list[str], seed: int = 11, made: int = MADE_PAGES, epochs: int = EPOCHS) -> Labeller:
    """Fit on given pages, labelled by their elements, and on as many layouts again made from their lines."""
    draw = random.Random(seed)
    given = [b for b in (blocks(p) for p in pages) if b]
    lines = [text for page in given for text, _, _ in page] or ["one line of plain text that stands for any other"]
    examples = [(page, [known_label(path) for _, path, _ in page]) for page in given]
    for _ in range(made):
        page, label = made_page(draw, lines)
        found = blocks(page)
        if len(found) == len(label):
            examples.append((found, label))
    model, reader = Labeller.fresh(seed), Reader()
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        draw.shuffle(examples)
        rate = 0.02 * 0.05 ** (epoch / epochs)
        for a in range(0, len(examples), 32):
            part = examples[a : a + 32]
            read = reader.read([p for p, _ in part])
            step += 1
            for name, g in model.gradients(read, np.array([y for _, ys in part for y in ys], np.float32)).items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.weights[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = SAMPLE_PAGES,
) -> DataFrame:
    """`text` and `n_chars` of every page, one row per row of `pages`, with its id and url.

    The labeller is fitted on at most `sample_pages` pages (by hash) and on made layouts; then every block of every page is labelled with the whole page as
    context. Character references are decoded, white space in a block becomes one space,
    blocks are trimmed and joined by one space. Null or empty html, and a page without main
    text, give an empty text. Null ids and urls and repeated rows are returned as they are;
    an empty table gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    sample = rows.where((F.length("html") > 0) & (F.length("html") <= SAMPLE_LENGTH)).select(
        F.xxhash64("id", "url", "html").alias("h"), "html")
    given = [html for _, html in least_hashes(sample, pages.count(), sample_pages)]
    shared = pages.sparkSession.sparkContext.broadcast(train(given))  # weights of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in in_chunks(batches, "html", 1 << 20):
            texts = shared.value.texts(batch.column("html").to_pylist(), reader)
            texts = [t.encode("utf-8", "replace").decode("utf-8") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
