"""Packing of token sequences: a configuration linear program over the histogram of lengths, rounded."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, in_chunks
from tidemark.llm.tokens import BATCH_BYTES, Encoder, vocabulary

CAPACITY = 2048
END = 0
# How near the fractional solution comes to a lower bound, and the pricings one start has for that.
GAP = 0.05
PATIENCE = 1000
FINER = 400
# A step covers this share of a length's demand; a weight falls by e to the STEEP where a length is covered once more.
STEP = 0.1
STEEP = 8.0
SALT_ROWS = 100_000


def pieces(docs: DataFrame, path: str, capacity: int, end: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    shared = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(*shared.value)
        closing = np.array([end], "<u4").tobytes()
        key = TaskContext.get().partitionId() << 40
        for batch in in_chunks(batches, "text", BATCH_BYTES):
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(encoder.ids(batch.column("text").to_pylist())):
                raw += closing
                n = len(raw) // 4
                borders = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(borders, borders[1:])):
                    part = raw[4 * a : 4 * b]
                    of.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    ids.append(part if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.arange(key, key + len(of))), pa.array(ids, pa.binary())],
                ["id", "piece", "start", "length", "ids_crc32", "key", "ids"])
            key += len(of)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, key long, ids binary")


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every capacity the greatest worth that fits, and the length last put in (0: a token is left empty).

    One pass over the capacities, each over all lengths at once; copies are not limited.
    """
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    of_length = np.full(capacity + 1, -np.inf)
    of_length[lengths] = worth
    value = np.empty(capacity)
    for at in range(1, capacity + 1):
        now = np.add(best[at - 1 :: -1], of_length[1 : at + 1], out=value[:at])
        k = now.argmax()
        if now[k] > best[at - 1]:
            best[at], choice[at] = now[k], k + 1
        else:
            best[at] = best[at - 1]
    return best, choice


def walk(choice: np.ndarray, at: int) -> list[int]:
    """The lengths that make up the best of a capacity."""
    out = []
    while at > 0:
        length = int(choice[at])
        if length:
            out.append(length)
        at -= length or 1
    return out


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[tuple[float, dict[int, int]]], float]:
    """The configuration linear program by multiplicative weights: configurations, how often, in fractions, each is taken, and a lower bound.

    The worth of a length is its share of a sequence times a weight that falls exponentially
    with how far it is covered ahead of the least covered one. One knapsack program prices all
    configurations: it gives each length the best configuration that holds it. Those of the
    least covered lengths are taken, each until the scarcest length in it is covered by one
    step more. Scaled by the least coverage the sum covers all demand; any worths give a lower
    bound, demand's worth over the best configuration's. Done when the two are within `gap`.

    A configuration with a length that is well ahead waits for the next pricing, and steps
    become finer, which suits the lengths of texts; where that does not end in PATIENCE pricings, another start takes
    them too, and the better of the two solutions is the answer. The bound may lie below what
    any solution reaches, so the gap is not always closed.
    """
    spot = np.argsort(lengths)
    sizes, wanted = lengths[spot], demand[spot].astype(np.float64)
    place = {x: i for i, x in enumerate(sizes.tolist())}
    bound, found = float((sizes * wanted).sum() / capacity), []
    for waits in (True, False):
        covered, total, least = np.zeros(len(sizes)), 0.0, 0.0
        taken: dict[tuple, float] = {}
        step, steep = STEP, STEEP
        for turn in range(1, PATIENCE + 1):
            worth = sizes / capacity * np.exp(-steep * (covered - least))
            best, choice = knapsack(sizes, worth, capacity)
            bound = max(bound, float((wanted * worth).sum() / best[capacity]))
            limit = least + step
            for rank, i in enumerate(np.argsort(covered, kind="stable").tolist()):
                if covered[i] >= limit:
                    break
                parts = [place[x] for x in walk(choice, capacity - int(sizes[i]))]
                if waits and rank and any(covered[k] > limit + step for k in parts):
                    continue
                where, copies = np.unique([i, *parts], return_counts=True)
                share = copies / wanted[where]
                times = step / share.max()
                covered[where] += times * share
                total += times
                key = tuple(zip(sizes[where].tolist(), copies.tolist()))
                taken[key] = taken.get(key, 0.0) + times
            least = covered.min()
            if least > 0 and total / least <= (1 + gap) * bound:
                break
            if waits and turn % FINER == 0:
                step, steep = step / 2, steep * 1.5
        if least > 0:
            found.append((total / least, least, taken))
            if total / least <= (1 + gap) * bound:
                break
    _, least, taken = min(found, key=lambda f: f[0])
    return sorted(((n / least, dict(key)) for key, n in taken.items()), key=lambda c: -c[0]), bound


def rounded(shares: list[tuple[float, dict[int, int]]], histogram: dict[int, int]) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Whole numbers of configurations and the pieces they leave.

    Shares are rounded along their running sum, so about as many sequences are taken as the
    program asks for, and none of which a length has run out: what is not covered by whole
    configurations stays for the rest.
    """
    left, out, running = dict(histogram), [], 0.0
    for share, config in shares:
        times = min(int(running + share + 1e-9) - int(running + 1e-9), *(left[x] // n for x, n in config.items()))
        running += share
        if times:
            out.append((times, config))
            for x, n in config.items():
                left[x] -= times * n
    return out, {x: n for x, n in left.items() if n}


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Configurations (times, {length: copies}) that hold exactly the pieces of a histogram, in few sequences.

    The fractional solution is rounded and what it leaves goes by best fit, the longest first,
    into the room that is left, then into new sequences. Best fit over all pieces is tried
    too, and the fewer sequences win. The work depends on the number of lengths, at most
    `capacity`, not on the number of pieces.
    """
    full = [(n, {capacity: 1}) for length, n in histogram.items() if length == capacity and n]
    rest = {x: n for x, n in histogram.items() if n and x < capacity}
    if not rest:
        return full
    lengths = np.array(sorted(rest, reverse=True), np.int64)
    shares, _ = fractional(lengths, np.array([rest[x] for x in lengths.tolist()], np.int64), capacity)
    found = [best_fit(*rounded(shares, rest), capacity), best_fit([], rest, capacity)]
    return full + min(found, key=lambda groups: sum(times for times, _ in groups))


def best_fit(groups: list[tuple[int, dict[int, int]]], rest: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Put pieces into the groups of equal sequences where they fit tightest, the longest pieces first."""
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for times, config in groups:
        by_room.setdefault(capacity - sum(x * n for x, n in config.items()), []).append((times, config))
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                copies = capacity // length
                times = n // copies
                if times:
                    by_room.setdefault(capacity - copies * length, []).append((times, {length: copies}))
                if n % copies:
                    by_room.setdefault(capacity - n % copies * length, []).append((1, {length: n % copies}))
                break
            times, config = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            used = min(times, n)
            if used < times:
                by_room.setdefault(room, []).append((times - used, config))
            by_room.setdefault(room - length, []).append((used, {**config, length: config.get(length, 0) + 1}))
            n -= used
    return [g for gs in by_room.values() for g in gs]


def slots(configs: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies, offset): which ranks of a length lie where."""
    out, rank, sequence = [], {}, 0
    for times, config in configs:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            first = rank.get(length, 0)
            rank[length] = first + times * copies
            out.append((length, first, rank[length], sequence, copies, offset))
            offset += length * copies
        sequence += times
    return out


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack all texts into as few sequences of at most `capacity` tokens as possible.

    One row per piece: id, `piece`, `start`, `length`, `ids_crc32`, `sequence_id`, `offset` and,
    with `with_ids`, the token `ids` as little-endian 32-bit numbers. Every text is followed
    by the id `end`; only longer ones are cut, into full pieces and a shorter first one. Null
    text is empty and takes one token. Repeated rows and null ids are pieces of their own;
    an empty table gives an empty result. Other columns are not read.

    The driver sees the histogram of lengths only. Pieces are ranked within their length
    by salted groups, and the rank says the place: the table of places has a row per length
    and configuration, as many as the pricings found. Token ids are not ranked or sorted: a
    number that each piece was written with brings them to its place.
    """
    spark = docs.sparkSession
    cutting = cut(pieces(docs, path, capacity, end, id_col, text_col, with_ids), "packing")
    counts = {r["length"]: r["n"] for r in cutting.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(configurations(counts, capacity))
    salts = max(1, -(-max(counts.values(), default=1) // SALT_ROWS))

    salted = cutting.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)))
    per_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per_salt.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32", "key")
    ranked = salted.drop("ids").withColumn("at", F.row_number().over(inside) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("at"))

    lookup: dict[int, tuple[np.ndarray, ...]] = {}
    for length in {p[0] for p in places}:
        mine = np.array([p[1:] for p in places if p[0] == length], np.int64)
        lookup[length] = tuple(mine[np.argsort(mine[:, 0])].T)
    shared = spark.sparkContext.broadcast(lookup)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for each in np.unique(length).tolist():
                first, _, start, copies, where = shared.value[each]
                mine = np.flatnonzero(length == each)
                row = np.searchsorted(first, rank[mine], side="right") - 1
                inner = rank[mine] - first[row]
                sequence[mine] = start[row] + inner // copies[row]
                offset[mine] = where[row] + inner % copies[row] * each
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32", "key")] + [pa.array(sequence), pa.array(offset)],
                ["id", "piece", "start", "length", "ids_crc32", "key", "sequence_id", "offset"])

    kind = cutting.schema["id"].dataType.simpleString()
    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", "key", "rank").mapInArrow(
        place, f"id {kind}, piece int, start long, length long, ids_crc32 long, key long, sequence_id long, offset long")
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not with_ids:
        return placed.select(*columns)
    # places are hashed, some 100 bytes a piece; the ids pass by and are never sorted
    return placed.hint("shuffle_hash").join(cutting.select("key", "ids"), "key").select(*columns, "ids")
