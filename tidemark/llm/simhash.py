"""Near duplicates by SimHash: all fingerprints within a Hamming distance, by the generalised pigeonhole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, in_chunks, keyed_groups, runs_of, shuffle_partitions

SHINGLE = 4
DISTANCE = 4
SEED = 42
HOT_ROWS = 50_000
PREFIX_BITS = 10
SMALL_GROUP = 24
# Cost of a verified candidate against a shipped probe.
CANDIDATE_COST = 0.1


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of a text: majority bits over the XXH64 of all its word shingles.

    Fewer words than a shingle hash as one sequence; no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(lengths + 1) - lengths - 1
    end = (begin + lengths)[size - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(begin[: len(end)].tolist(), end.tolist())), np.uint64, len(end))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per row of `docs`: its id and `fp`, the fingerprint as a signed long. Null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            known: dict[bytes, int] = {}
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                if text is None:
                    continue
                if text not in known:
                    known[text] = fingerprint(text, size)
                out[i] = known[text]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


@dataclass(frozen=True)
class Split:
    """How 64 bits are cut into parts, and how dense each part is around its prefixes."""

    parts: tuple[tuple[int, ...], ...]
    density: tuple[np.ndarray, ...]
    distance: int

    def values(self, fps: np.ndarray, part: int) -> np.ndarray:
        out = np.zeros(len(fps), np.uint64)
        for k, bit in enumerate(self.parts[part]):
            out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
        return out

    def prefix(self, values: np.ndarray, part: int) -> np.ndarray:
        return (values >> np.uint64(max(0, len(self.parts[part]) - PREFIX_BITS))).astype(np.int64)

    def allocate(self, fps: np.ndarray) -> np.ndarray:
        """Threshold of each part for each fingerprint, -1 where a part is not probed.

        The thresholds sum to distance - parts + 1, so a pair within the distance is within
        the threshold of a part (generalised pigeonhole). Among these, dynamic programming
        takes those with the least estimated probes and candidates.
        """
        n, m, top = len(fps), len(self.parts), self.distance
        goal = top - m + 1
        levels = np.arange(-1, top + 1)
        best = np.full((n, top + m + 2), np.inf)  # by the sum so far, plus m
        best[:, m] = 0
        picks = []
        for i, bits in enumerate(self.parts):
            near = self.density[i][self.prefix(self.values(fps, i), i)]
            ball = np.array([sum(comb(len(bits), k) for k in range(t + 1)) for t in levels], float)
            cost = ball[None, :] * (1 + CANDIDATE_COST * near[:, None])
            new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
            for j, t in enumerate(levels):
                src = best[:, max(0, -t) : best.shape[1] - max(0, t)]
                dst = slice(max(0, t), best.shape[1] + min(0, t))
                trial = src + cost[:, j : j + 1]
                better = trial < new[:, dst]
                new[:, dst] = np.where(better, trial, new[:, dst])
                pick[:, dst] = np.where(better, t, pick[:, dst])
            best = new
            picks.append(pick)
        at, out = np.full(n, goal + m), np.zeros((n, m), np.int64)
        for i in range(m - 1, -1, -1):
            out[:, i] = picks[i][np.arange(n), at]
            at = at - out[:, i]
        return out


def plan_parts(rows: int, distance: int, together: np.ndarray) -> tuple[tuple[int, ...], ...]:
    """Parts of the 64 bits: as many as make probing `rows` fingerprints cheapest, correlated bits in one part."""
    def cost(m: int) -> float:
        width, spare = 64 / m, distance - m + 1
        levels = [spare // m + (i < spare % m) for i in range(m)] if spare >= 0 else [0] * (distance + 1)
        probes = sum(comb(round(width), k) for t in levels for k in range(t + 1))
        return m + probes * (1 + CANDIDATE_COST * rows / 2.0 ** width)

    m = min(range(1 + (distance > 2), distance + 2), key=cost)
    ones = np.diag(together) / max(rows, 1)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-9))
    phi = np.abs((together / max(rows, 1) - np.outer(ones, ones)) / np.outer(spread, spread))
    np.fill_diagonal(phi, 0)
    free, parts = list(range(64)), []
    for i in range(m):
        width = (64 + i) // m
        group = [max(free, key=lambda b: phi[b, free].sum())]
        while len(group) < width:
            group.append(max((b for b in free if b not in group), key=lambda b: phi[b, group].sum()))
        parts.append(tuple(group))
        free = [b for b in free if b not in group]
    return tuple(parts)


def _together(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for every pair of bits how many have both: 64 sums of 64, whatever the size."""
    def run(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 8192):
                bits = np.unpackbits(fps[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(64)), pa.array(total.astype(np.int64).tolist())], ["bit", "counts"])

    sums = nodes.select("fp").mapInArrow(run, "bit long, counts array<long>")
    cells = sums.select("bit", F.posexplode("counts").alias("other", "n")).groupBy("bit", "other").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((64, 64))
    for bit, other, n in cells:
        out[bit, other] = n
    return nodes.count(), out


def _split(nodes: DataFrame, distance: int) -> Split:
    rows, together = _together(nodes)
    parts = plan_parts(rows, distance, together)
    bare = Split(parts, (), distance)

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(len(parts)):
                value, n = np.unique(bare.prefix(bare.values(fps, i), i), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), i)), pa.array(value), pa.array(n)], ["part", "value", "n"])

    counts = nodes.select("fp").mapInArrow(run, "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n"))
    density = [np.zeros(1 << min(PREFIX_BITS, len(p))) for p in parts]
    for part, value, n in counts.collect():
        density[part][value] = n / 2.0 ** max(0, len(parts[part]) - PREFIX_BITS)
    return Split(parts, tuple(density), distance)


def _hot_values(nodes: DataFrame, split: Split, hot_rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Values of each part that more than `hot_rows` fingerprints share: at most rows / hot_rows of a part."""
    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(len(split.parts)):
                value, n = np.unique(split.values(fps, i), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), i)), pa.array(value.view(np.int64)), pa.array(n)], ["part", "value", "n"])

    rows = nodes.select("fp").mapInArrow(run, "part long, value long, n long").groupBy("part", "value").agg(
        F.sum("n").alias("n")).where(F.col("n") > hot_rows).collect()
    return [
        (np.array([r.value for r in rows if r.part == i], np.int64).view(np.uint64),
         np.array([-(-r.n // hot_rows) for r in rows if r.part == i], np.int64))
        for i in range(len(split.parts))
    ]


def _probes(split: Split, hot: list[tuple[np.ndarray, np.ndarray]]):
    """Rows (key, fp, own): each fingerprint under its own value of every part, and under all values in its thresholds.

    A key near a hot value is split into pairs of blocks: a fingerprint of block b goes to
    all pairs with b, so every two fingerprints of the key still meet.
    """
    masks = [
        [np.array([sum(1 << b for b in pick) for pick in combinations(range(len(bits)), t)], np.uint64)
         for t in range(1, split.distance + 1)]
        for bits in split.parts
    ]

    def run(batches):
        for batch in batches:
            whole = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(whole), 4096):
                fps = whole[at : at + 4096]
                levels = split.allocate(fps)
                for i in range(len(split.parts)):
                    values = split.values(fps, i)
                    keys, who, own = [values], [fps], [np.ones(len(fps), bool)]
                    for t in range(1, int(levels[:, i].max()) + 1):
                        rows = np.flatnonzero(levels[:, i] >= t)
                        mask = masks[i][t - 1]
                        keys.append((values[rows][:, None] ^ mask[None, :]).ravel())
                        who.append(np.repeat(fps[rows], len(mask)))
                        own.append(np.zeros(len(rows) * len(mask), bool))
                    key, fp, mine = np.concatenate(keys), np.concatenate(who), np.concatenate(own)
                    pair = np.zeros(len(key), np.int64)
                    if len(hot[i][0]):
                        blocks = np.ones(len(key), np.int64)
                        for value, n in zip(*hot[i]):
                            close = np.bitwise_count(key ^ value) <= split.distance
                            blocks[close] = np.maximum(blocks[close], n)
                        mult = np.where(blocks > 1, blocks, 1)
                        other = np.arange(int(mult.sum())) - np.repeat(np.cumsum(mult) - mult, mult)
                        key, fp, mine, blocks = (np.repeat(x, mult) for x in (key, fp, mine, blocks))
                        block = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
                        pair = np.minimum(block, other) * blocks + np.maximum(block, other)
                    yield pa.RecordBatch.from_arrays([
                        pa.array((key.astype(np.int64) * (len(split.parts) + 1) + i)), pa.array(pair.astype(np.int32)),
                        pa.array(fp.view(np.int64)), pa.array(mine)], ["key", "pair", "fp", "own"])

    return run


def forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among `fps`: at most one less than there are fingerprints.

    Leaders gather what is within the distance of them; two gatherings whose leaders are
    near enough are then compared in blocks until one link is found.
    """
    links, groups, rest = [], [], fps
    while len(rest):
        near = np.bitwise_count(rest ^ rest[0]) <= distance
        group = rest[near]
        if len(group) > 1:
            links.append((np.full(len(group) - 1, rest[0]), group[1:]))
        groups.append(group)
        rest = rest[~near]
    if len(groups) == 1 or len(groups) == len(fps):
        return links
    leaders = np.array([g[0] for g in groups], np.uint64)
    root = np.arange(len(groups))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, group in enumerate(groups):
        if len(group) == 1:
            continue
        for j in np.flatnonzero(np.bitwise_count(leaders ^ leaders[i]) <= 3 * distance).tolist():
            if j == i or (j < i and len(groups[j]) > 1) or find(i) == find(j):
                continue
            for at in range(0, len(group), 1024):
                part = group[at : at + 1024]
                hit = np.argwhere(np.bitwise_count(part[:, None] ^ groups[j][None, :]) <= distance)
                if len(hit):
                    links.append((part[hit[0, 0]].reshape(1), groups[j][hit[0, 1]].reshape(1)))
                    root[find(i)] = find(j)
                    break
    return links


def _verify(distance: int):
    def run(batches):
        for table in keyed_groups(batches, "bucket"):
            key = table.column("bucket").to_numpy()
            fp = table.column("fp").to_numpy().view(np.uint64)
            own = table.column("own").to_numpy(zero_copy_only=False)
            first, size = runs_of(key)
            live = (np.add.reduceat(own.astype(np.int64), first) > 0) & (size > 1)
            a, b = [], []
            small = np.repeat(live & (size <= SMALL_GROUP), size)
            k, f, o = key[small], fp[small], own[small]
            for lag in range(1, SMALL_GROUP):
                if lag >= len(k):
                    break
                hit = (k[lag:] == k[:-lag]) & (o[lag:] | o[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= distance)
                a.append(f[lag:][hit])
                b.append(f[:-lag][hit])
            for i in np.flatnonzero(live & (size > SMALL_GROUP)):
                for left, right in forest(np.unique(fp[first[i] : first[i] + size[i]]), distance):
                    a.append(left)
                    b.append(right)
            if a:
                left, right = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, enough of them to keep every component whole."""
    split = _split(nodes, distance)
    hot = _hot_values(nodes, split, hot_rows)
    probes = nodes.select("fp").mapInArrow(_probes(split, hot), "key long, pair int, fp long, own boolean")
    parts = shuffle_partitions(nodes.sparkSession)
    # one number for key and pair, so that a run of rows is one group; equal numbers of two keys only meet in vain
    dealt = probes.select(F.xxhash64("key", "pair").alias("bucket"), "fp", "own").repartition(parts, "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(_verify(distance), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Group texts whose SimHash fingerprints chain by links of at most `distance` differing bits.

    One row per row of `docs`: the id, `fingerprint` (16 hex digits) and `component_id`, the
    least id of the group. Bits are cut into parts of correlated bits; each fingerprint
    gets a threshold per part by dynamic programming on estimated candidates, probes the
    values in it, and what meets there is compared whole. Equal fingerprints are one node, so
    a group of copies costs one; a group of near copies yields a forest, not its pairs.

    Null and empty texts have fingerprint zero and link like any other. A row with a null
    id is returned; if no row of its group has an id, its component_id is null. Repeated
    rows are all returned. An empty table gives an empty result. Other columns are not read.
    """
    marked = cut(fingerprints(docs, id_col, text_col, size), "simhash")
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash")
    found = components(links(nodes, distance, hot_rows), "simhash")
    rooted = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(labelled, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the least of its group; rows without an id stay."""
    kept = near_duplicates(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(id_col)
    return docs.join(kept, id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
