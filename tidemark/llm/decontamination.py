"""Benchmark decontamination by greedy string tiling: how much of a test item a text covers, in any order."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BASE, LOWER, bytes_of, in_chunks, mix, runs_of, span_hashes, words_of

TILE = 5  # least words of a match
COVERAGE = 0.8
BLOCK_BYTES = 8 << 20
SIEVE_BITS = 22
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, lower-cased and without ASCII marks at their ends, and where each text begins.

    A word of marks only is left out.
    """
    data, at = bytes_of(texts)
    data = LOWER[data]
    first, end, start = words_of(data, at)
    if not len(first):
        return np.zeros(0, np.uint64), start
    # the nearest byte that is no mark, from each place on and up to each place
    real = ~PUNCTUATION[data]
    place = np.arange(len(data))
    following = np.minimum.accumulate(np.where(real, place, len(data))[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(real, place, -1))
    first = np.minimum(following[first], end)
    end = np.maximum(preceding[end - 1] + 1, first)
    real = first < end
    hashes = span_hashes(data, first, end)[real]
    return hashes, np.concatenate([[0], np.cumsum(real)])[start]


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(BASE) + words[j : j + n]
    return mix(out)


def tiles(places: np.ndarray, spots: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the text, place in the item, words), the longest free match first.

    `places` and `spots` say where runs of `size` words are equal. Those in a row on one
    diagonal are a maximal match; a match that is partly taken when its turn comes is cut
    to its free stretches, which wait for theirs.
    """
    order = np.lexsort((places, places - spots))
    p, q = places[order], spots[order]
    new = np.concatenate([[True], (np.diff(p - q) != 0) | (np.diff(p) != 1)])
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(p)]])) + size - 1
    waiting = [(-int(n), int(q[i]), int(p[i])) for i, n in zip(first, length)]
    heapq.heapify(waiting)
    text_taken: set[int] = set()
    item_taken: set[int] = set()
    out = []
    while waiting:
        n, spot, place = heapq.heappop(waiting)
        free = [place + j not in text_taken and spot + j not in item_taken for j in range(-n)]
        if all(free):
            out.append((place, spot, -n))
            text_taken.update(range(place, place - n))
            item_taken.update(range(spot, spot - n))
            continue
        begin = None
        for j, open_ in enumerate([*free, False]):
            if open_ and begin is None:
                begin = j
            elif not open_ and begin is not None:
                if j - begin >= size:
                    heapq.heappush(waiting, (begin - j, spot + begin, place + begin))
                begin = None
    return out


class Items:
    """Test items of one block, with the runs of words that lead to them."""

    def __init__(self, ids: list, words: list[np.ndarray], tile: int):
        self.ids, self.sizes = ids, np.array([len(w) for w in words], np.int64)
        self.seeds = {}
        for size in sorted({min(tile, len(w)) for w in words if len(w)}):
            rows = [(h, i, j) for i, w in enumerate(words) if min(tile, len(w)) == size for j, h in enumerate(rolling(w, size).tolist())]
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[(hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
            self.seeds[size] = (hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.packbits(sieve))

    def matches(self, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(text, item, share of the item's words in tiles, tiles) where the share is `coverage` or more."""
        words, start = word_hashes(texts)
        for size, (hashes, item, spot, packed) in self.seeds.items():
            found = rolling(words, size)
            sieve = np.unpackbits(packed).astype(bool)
            hit = np.flatnonzero(sieve[(found >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
            low, high = np.searchsorted(hashes, found[hit]), np.searchsorted(hashes, found[hit], side="right")
            text = np.searchsorted(start, hit, side="right") - 1
            real = (high > low) & (hit + size <= start[text + 1])
            hit, text, low, many = hit[real], text[real], low[real], (high - low)[real]
            if not len(hit):
                continue
            seed = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            place, text = np.repeat(hit, many), np.repeat(text, many)
            pair = text * len(self.ids) + item[seed]
            order = np.argsort(pair, kind="stable")
            for first, n in zip(*(x.tolist() for x in runs_of(pair[order]))):
                mine = order[first : first + n]
                t, i = int(text[mine[0]]), int(item[seed[mine[0]]])
                need = coverage * self.sizes[i]
                if size * n < need:  # every seed covers `size` words at most
                    continue
                parts = tiles(place[mine] - start[t], spot[seed[mine]], size)
                share = sum(p[2] for p in parts) / self.sizes[i]
                if share >= coverage:
                    yield t, i, share, parts


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, tile: int, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks of about `block_bytes` of text; the driver holds one block at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").toArrow()
        if part.num_rows:
            words, start = word_hashes(part.column("text").combine_chunks())
            yield Items(part.column("id").to_pylist(), [words[a:b] for a, b in zip(start[:-1], start[1:])], tile)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    tile: int = TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pairs of a text and a test item of which tiles cover at least `coverage` of the words.

    Columns: document id, item id, `coverage`, `n_tiles`, `tiles` (place in the text, place in
    the item, number of words; by place). Words are compared lower-cased and without marks at
    their ends. Runs of `tile` shared words (of all words, for a shorter item) join texts with
    items; from these matches the longest that is still free is marked, again and again, so
    a passage in another order is covered as well. The benchmark is broadcast in blocks of
    `block_bytes`; documents are never shuffled.

    Null and empty texts and items, and items of marks only, are in no pair. Repeated rows
    of either table give repeated pairs. Null ids are returned. Empty tables give an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item long, coverage double, n_tiles int, tiles array<struct<place:long,spot:long,words:long>>"
    tile_type = pa.list_(pa.struct([("place", pa.int64()), ("spot", pa.int64()), ("words", pa.int64())]))
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, item_col, text_col, tile, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in in_chunks(batches, "text", 512 << 10):
                found = list(shared.value.matches(batch.column("text"), coverage))
                if found:
                    yield pa.RecordBatch.from_arrays([
                        batch.column("id").take(pa.array([f[0] for f in found])),
                        pa.array([shared.value.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()),
                        pa.array([len(f[3]) for f in found], pa.int32()),
                        pa.array([[dict(zip(("place", "spot", "words"), t)) for t in sorted(f[3])] for f in found], tile_type)],
                        ["id", "item", "coverage", "n_tiles", "tiles"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "coverage", "n_tiles", "tiles")


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    tile: int = TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of `docs` that cover no test item, with all their columns."""
    for items in item_blocks(benchmark, item_col, text_col, tile, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in in_chunks(batches, text_col, 512 << 10):
                texts = batch.column(text_col).cast(pa.string()).fill_null("")
                keep = np.ones(batch.num_rows, bool)
                for text, *_ in shared.value.matches(texts, coverage):
                    keep[text] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
