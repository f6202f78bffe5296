"""Language-model scores of whole texts: word counts of the whole corpus beside a causal attention model.

The attention model gives every word a probability as the product over its subword ids;
the score mixes it, word by word, with the word's share of all training tokens. Counts of
the most frequent words of the corpus are broadcast, a table of fixed size; all other words meet in buckets of their hashes, with the documents that have them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, bytes_of, cut, in_chunks, keyed_groups, least_hashes, mix, runs_of, shuffle_partitions, span_hashes, words_of
from tidemark.llm.lm_model import CONTEXT_IDS, Model, context_cells, fresh_model, learn_apart, moved, near_of, profiles_of, start_fit
from tidemark.llm.packed import deltas, pack, unpack
from tidemark.llm.tokens import Encoder, vocabulary

FOLDS = 5
HELD_OUT = 1
SHARE = 0.5  # of the attention model in the mixture
FREQUENT = 32_768  # words counted in a pass of their own; the choice changes the work only
PIECE = 1024  # ids of a training text that are dealt as one row
START_IDS = 1_500_000  # ids the driver begins on; a corpus of more is then learnt whole on the executors
ROUNDS = 4  # of that: each learns its share of all pieces, then the shards' changes are averaged
SHARD_IDS = 1_000_000  # ids learnt in a row between averages
RATE = 0.004
ID_BLOCK = 256  # ids of a block of counts
ROW_BLOCK = 1024  # rows of the embedding in a block of changes
CHUNK = 256 << 10
FLUSH = 1 << 20
COUNTED = 4 << 20  # words counted before their counts go on


@dataclass
class Shared:
    """What every task needs: the model, the frequent words with their counts, the number of training tokens and texts."""

    model: Model
    words: np.ndarray
    counts: np.ndarray
    tokens: int
    texts: int
    end: int
    spaced: np.ndarray


def plain_texts(texts: pa.Array) -> list[str]:
    """Texts with A-Z lower-cased and words one space apart."""
    return [b" ".join((raw or b"").lower().split()).decode("utf-8", "replace") for raw in texts.cast(pa.binary()).to_pylist()]


def sequences_of(encoder: Encoder, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts between two end ids, one sequence after the other, and their lengths."""
    parts = [np.frombuffer(raw, "<u4").astype(np.int64) for raw in encoder.ids(texts)]
    edge = np.array([end])
    return np.concatenate([x for p in parts for x in (edge, p, edge)] or [edge[:0]]), np.array([len(p) + 2 for p in parts], np.int64)


def word_logs(shared: Shared, encoder: Encoder, texts: list[str], sizes: np.ndarray, wide: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Natural log probability, by the attention model, of every word and then the end of each text."""
    flat, lengths = sequences_of(encoder, texts, shared.end)
    logs = shared.model.logs(flat, lengths, wide)
    start = np.cumsum(lengths) - lengths
    target = np.delete(flat, start)
    first = np.cumsum(lengths - 1) - (lengths - 1)
    opens = shared.spaced[target]
    opens[first] = True
    opens[first + lengths - 2] = True
    if opens.sum() == (sizes + 1).sum() and (np.add.reduceat(opens, first) == sizes + 1).all():
        return np.add.reduceat(logs, np.flatnonzero(opens))
    # an id went across a blank or a word held one: such texts share their log evenly among their words
    whole = np.add.reduceat(logs, first)
    good = np.add.reduceat(opens, first) == sizes + 1
    out = np.repeat(whole / (sizes + 1), sizes + 1)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    at = np.flatnonzero(opens)
    each = np.add.reduceat(logs, at)
    seen = np.cumsum(np.add.reduceat(opens, first)) - np.add.reduceat(opens, first)
    for i in np.flatnonzero(good):
        out[begin[i] : begin[i] + sizes[i] + 1] = each[seen[i] : seen[i] + sizes[i] + 1]
    return out


def mixed_logs(logs: np.ndarray, counts: np.ndarray, tokens: int) -> np.ndarray:
    """Log10 of the mixture of the attention model and the share of all training tokens."""
    if not tokens:
        return logs / np.log(10)
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(SHARE) + logs, np.log((1 - SHARE) * counts / tokens)) / np.log(10)


def _batch(kind: int, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (kind, bucket, body, and the columns of a text)."""
    return pa.RecordBatch.from_arrays([
        pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
        ["kind", "bucket", "body"])


def _by_bucket(bucket, *columns):
    order = np.argsort(bucket, kind="stable")
    for first, size in zip(*(x.tolist() for x in runs_of(bucket[order]))):
        pick = order[first : first + size]
        yield int(bucket[pick[0]]), [c[pick] for c in columns]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = bytes_of(texts)
    data = LOWER[data]
    first, end, start = words_of(data, at)
    return span_hashes(data, first, end), start


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes with how often they are there, summed over some millions of words."""
    def flush():
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    held, size = [], 0
    for batch in in_chunks(batches, "text", CHUNK):
        hashes, _ = _words(batch.column("text"))
        held.append(hashes)
        size += len(hashes)
        if size >= COUNTED:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _frequent(learn: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent words of all training texts in order of their hashes, their counts, and the number of all words."""
    counted = cut(learn.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm")
    # by way of a table: a collected limit would send the driver that many rows from every partition
    top = cut(counted.orderBy(F.desc("n"), "word").limit(FREQUENT), "lm").collect()
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r.n for r in top], np.int64)[order], counted.agg(F.sum("n")).first()[0] or 0


def _cut_ids(content, end: int):
    """Training texts as pieces of ids; the last id of a piece is the first of the next, so each is learnt once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(*content.value)
        for batch in in_chunks(batches, "text", CHUNK):
            flat, sizes = sequences_of(encoder, plain_texts(batch.column("text")), end)
            h = batch.column("h").to_numpy().view(np.uint64)
            rows, begin = [], 0
            for i, size in enumerate(sizes.tolist()):
                for a in range(0, size - 1, PIECE):
                    ids = flat[begin + a : begin + min(size, a + PIECE + 1)]
                    rows.append((i, a, len(ids), pack(ids)))
                begin += size
            of, at = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(h[of] + mix(at.astype(np.uint64))).view(np.int64)), pa.array(at == 0), pa.array([r[2] - 1 for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.binary())], ["h", "opens", "n", "body"])

    return run


def _id_counts(vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for opens, body in zip(batch.column("opens").to_pylist(), batch.column("body").to_pylist()):
                ids = unpack(body)[0]
                np.add.at(counts, ids if opens else ids[1:], 1)
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], ["i", "n"])

    return run


def _contexts(near):
    """What stands beside the ids of a block, summed over a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = near.value
        cells, one = np.zeros(len(ranks) * 2 * CONTEXT_IDS, np.int32), np.int32(1)
        for batch in batches:
            for body in batch.column("body").to_pylist():
                ids, beside = context_cells(unpack(body)[0], ranks)
                np.add.at(cells, ids * (2 * CONTEXT_IDS) + beside, one)  # a flat index is several times faster than a pair
        blocks, bodies = [], []
        for a in range(0, len(ranks), ID_BLOCK):
            block = cells[a * 2 * CONTEXT_IDS : (a + ID_BLOCK) * 2 * CONTEXT_IDS]
            spot = np.flatnonzero(block)
            if len(spot):
                blocks.append(a // ID_BLOCK)
                bodies.append(pack(deltas(spot), block[spot].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])

    return run


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in keyed_groups(batches, "bucket"):
        for block, bodies in _grouped(table):
            cells = np.zeros(ID_BLOCK * 2 * CONTEXT_IDS)
            for spot, n in map(unpack, bodies):
                cells[np.cumsum(spot)] += n
            profile = profiles_of(cells.reshape(ID_BLOCK, -1)).astype("<f2")
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(profile.view(np.uint8).ravel())], pa.binary())], ["bucket", "body"])


def _learn(shared, rate: float):
    """The changes of the weights that a shard's pieces make, in blocks of rows of the embedding; block -1 has all others."""
    def change(held: list[np.ndarray], turn: int) -> pa.RecordBatch:
        rows, n, embed, others, learnt = learn_apart(shared.value, np.concatenate(held), np.array([len(x) for x in held]), 7, rate)
        out = [(-1, pack(np.array([learnt]), others.astype("<f4").view(np.uint8)))]
        for block, (row, times, moves) in _by_bucket(rows // ROW_BLOCK, rows, n, embed):
            out.append((block, pack(row, times, moves.astype("<f4").view(np.uint8).ravel())))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(out), pa.int32()),
             pa.array([turn] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["bucket", "shard", "turn", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0
        for batch in batches:
            for body in batch.column("body").to_pylist():
                held.append(unpack(body)[0])
                size += len(held[-1])
                if size >= 2 * SHARD_IDS:  # equal rows may meet in one shard
                    yield change(held, turn)
                    held, size, turn = [], 0, turn + 1
        if held:
            yield change(held, turn)

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards' changes, each row of the embedding by how often a shard read it, all else by ids learnt."""
    for table in keyed_groups(batches, "bucket"):
        for block, bodies in _grouped(table):
            parts = [unpack(b) for b in bodies]
            if block < 0:
                total = sum(p[0][0] for p in parts)
                mean = sum(p[1].view("<f4").astype(float) * (p[0][0] / total) for p in parts)
                body = pack(mean.astype("<f4").view(np.uint8))
            else:
                times, moves = np.zeros(ROW_BLOCK), None
                for row, n, raw in parts:
                    change = raw.view("<f4").reshape(len(row), -1)
                    moves = np.zeros((ROW_BLOCK, change.shape[1])) if moves is None else moves
                    times[row % ROW_BLOCK] += n
                    moves[row % ROW_BLOCK] += change * n[:, None]
                row = np.flatnonzero(times)
                body = pack(block * ROW_BLOCK + row, (moves[row] / times[row][:, None]).astype("<f4").view(np.uint8).ravel())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([body], pa.binary())], ["bucket", "body"])


def _model(learn: DataFrame, content, end: int, parts: int) -> Model:
    """The attention model: counts, classes and windows of all training texts.

    The driver begins on the pieces of least hash, some START_IDS ids. Where there are more,
    all pieces are dealt to shards by hash and learnt there in ROUNDS rounds; what a shard
    learns depends on the rows alone, not on how the table is partitioned.
    """
    spark = learn.sparkSession
    hashed = learn.select(F.xxhash64("id", "text").alias("h"), "text")
    pieces = cut(hashed.mapInArrow(_cut_ids(content, end), "h long, opens boolean, n long, body binary"), "lm")
    n_pieces, ids = pieces.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = np.zeros(end + 1, np.int64)
    for i, n in pieces.select("opens", "body").mapInArrow(_id_counts(end + 1), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[i] = n
    near = spark.sparkContext.broadcast(near_of(counts))
    cells = pieces.select("body").mapInArrow(_contexts(near), "bucket int, body binary")
    cells = cells.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket")
    profiles = np.zeros((-(-(end + 1) // ID_BLOCK) * ID_BLOCK, 2 * CONTEXT_IDS), np.float32)
    for block, body in cells.mapInArrow(_profiles, "bucket int, body binary").collect():
        profiles[block * ID_BLOCK : (block + 1) * ID_BLOCK] = unpack(bytes(body))[0].view("<f2").reshape(ID_BLOCK, -1)
    model = fresh_model(counts, profiles)

    wanted = max(1, -(-START_IDS * n_pieces // max(1, ids)))
    begin = [unpack(bytes(body))[0] for _, body in least_hashes(pieces.select("h", "body"), n_pieces, wanted)]
    begin = begin or [np.array([end, end])]  # no training text: classes of no use
    start_fit(model, np.concatenate(begin), np.array([len(x) for x in begin]))
    if ids <= START_IDS:
        return model
    shards = max(1, -(-ids // (ROUNDS * SHARD_IDS)))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        mine = pieces.where(F.pmod("h", F.lit(ROUNDS)) == turn).select("h", "body")
        dealt = mine.repartitionById(shards, F.pmod(F.shiftright("h", 8), F.lit(shards)).cast("int")).sortWithinPartitions("h", "body")
        changes = dealt.select("body").mapInArrow(_learn(shared, RATE * 0.5**turn), "bucket int, shard int, turn int, body binary")
        changes = changes.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket", "shard", "turn")
        found = {r.bucket: unpack(bytes(r.body)) for r in changes.select("bucket", "body").mapInArrow(_average, "bucket int, body binary").collect()}
        others = found.pop(-1)[0].view("<f4")
        rows = np.concatenate([x[0] for x in found.values()])
        model = moved(model, rows, np.concatenate([x[1] for x in found.values()]).view("<f4").reshape(len(rows), -1), others)
    return model


def _score(shared, content, n_words: int, n_texts: int):
    """Kind 0: a text with what its frequent words and its end give. Kind 1: its other words, by hash."""
    def flush(held):
        h, keys, learn, logs = (np.concatenate(x) for x in zip(*held))
        rows = [(b, pack(p[0], deltas(p[1]), p[2].view(np.uint8), p[3].astype("<f4").view(np.uint8)))
                for b, p in _by_bucket((h >> np.uint64(40)).astype(np.int64) % n_words, h, keys, learn, logs)]
        none = pa.nulls(len(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array([1] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
             none.cast(pa.int64()), none.cast(pa.bool_()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.float64())],
            ["kind", "bucket", "body", "id", "learn", "key", "n_tokens", "n_known", "base", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know, encoder = shared.value, Encoder.get(*content.value)
        wide = know.model.wide()
        key = TaskContext.get().partitionId() << 40
        held, size = [], 0
        for batch in in_chunks(batches, "text", CHUNK):
            hashes, start = _words(batch.column("text"))
            sizes = np.diff(start)
            logs = word_logs(know, encoder, plain_texts(batch.column("text")), sizes, wide)
            last = np.cumsum(sizes + 1) - 1
            of = np.repeat(np.arange(len(sizes)), sizes)
            inner, closing = np.delete(logs, last), logs[last]
            spot = np.minimum(np.searchsorted(know.words, hashes), max(0, len(know.words) - 1))
            often = know.words[spot] == hashes if len(know.words) else np.zeros(len(hashes), bool)
            counts = know.counts[spot[often]]
            n = len(sizes)
            base = np.bincount(of[often], np.log10(counts + 0.5), n) + np.log10(know.texts + 0.5)
            score = np.bincount(of[often], mixed_logs(inner[often], counts, know.tokens), n) + mixed_logs(closing, np.full(n, know.texts), know.tokens)
            known = np.bincount(of[often], counts > 0, n).astype(np.int64) + (know.texts > 0)
            keys = key + np.arange(n)
            key += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), pa.array((mix(keys.astype(np.uint64)) % np.uint64(n_texts)).astype(np.int32)), pa.nulls(n, pa.binary()), batch.column("id"),
                 batch.column("learn"), pa.array(keys), pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(score)],
                ["kind", "bucket", "body", "id", "learn", "key", "n_tokens", "n_known", "base", "score"])
            if (~often).any():
                learn = batch.column("learn").to_numpy(zero_copy_only=False)
                held.append((hashes[~often], keys[of[~often]], learn[of[~often]], inner[~often]))
                size += int((~often).sum())
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _grouped(table: pa.Table) -> Iterator[tuple[int, list[bytes]]]:
    bucket, body = table.column("bucket").to_numpy(), table.column("body")
    for first, size in zip(*(x.tolist() for x in runs_of(bucket))):
        yield int(bucket[first]), body.slice(first, size).to_pylist()


def _rare(tokens: int, n_texts: int):
    """Kind 0: sums over rare words by text, for the bucket of the text. Kind 1: how many distinct training words were met."""
    def run(batches):
        distinct = 0
        for table in keyed_groups(batches, "bucket"):
            for _, bodies in _grouped(table):
                parts = [unpack(b) for b in bodies]
                h = np.concatenate([p[0] for p in parts])
                keys = np.concatenate([np.cumsum(p[1]) for p in parts])
                learn = np.concatenate([p[2] for p in parts]) > 0
                logs = np.concatenate([p[3] for p in parts]).view("<f4").astype(float)
                order = np.argsort(h, kind="stable")
                first, size = runs_of(h[order])
                per_word = np.add.reduceat(learn[order].astype(np.int64), first)
                distinct += int((per_word > 0).sum())
                counts = np.empty(len(h), np.int64)
                counts[order] = np.repeat(per_word, size)
                each, at = np.unique(keys, return_inverse=True)
                base = np.bincount(at, np.log10(counts + 0.5))
                score = np.bincount(at, mixed_logs(logs, counts, tokens))
                known = np.bincount(at, counts > 0).astype(np.int64)
                rows = [(b, pack(deltas(p[0]), p[1], p[2].view(np.uint8).copy(), p[3].view(np.uint8).copy()))
                        for b, p in _by_bucket((mix(each.astype(np.uint64)) % np.uint64(n_texts)).astype(np.int64), each, known, base, score)]
                yield _batch(0, rows)
        yield _batch(1, [(distinct, b"")])

    return run


def _sum(tokens: int, distinct: int):
    def run(batches):
        bucket, waiting, sums = None, [], None
        below = np.log10(tokens + 0.5 * (distinct + 1))
        for batch in batches:
            kinds, of = batch.column("kind").to_numpy(), batch.column("bucket").to_numpy()
            body = batch.column("body")
            at = 0
            while at < batch.num_rows:
                if of[at] != bucket:
                    bucket, waiting, sums = of[at], [], None
                if kinds[at] == 0:
                    waiting.append(unpack(body[at].as_py()))
                    at += 1
                    continue
                stop = at + int(np.argmin(np.append((kinds[at:] == 1) & (of[at:] == bucket), False)))
                rows = batch.slice(at, stop - at)
                at = stop
                if sums is None:
                    keys = np.concatenate([np.cumsum(p[0]) for p in waiting] or [np.zeros(0, np.int64)])
                    each, where = np.unique(keys, return_inverse=True)
                    cols = [np.concatenate([p[i].view(k) for p in waiting] or [np.zeros(0, k)]) for i, k in ((1, np.int64), (2, np.float64), (3, np.float64))]
                    sums = (each, *[np.bincount(where, c, len(each)) for c in cols])
                keys = rows.column("key").to_numpy()
                spot = np.minimum(np.searchsorted(sums[0], keys), max(0, len(sums[0]) - 1))
                hit = sums[0][spot] == keys if len(sums[0]) else np.zeros(len(keys), bool)
                known, base, score = (np.where(hit, s[spot], 0) if len(s) else np.zeros(len(keys)) for s in sums[1:])
                n = rows.column("n_tokens").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), pa.array(n), pa.array(rows.column("n_known").to_numpy() + known.astype(np.int64)),
                     pa.array(rows.column("base").to_numpy() + base - n * below), pa.array(rows.column("score").to_numpy() + score)],
                    ["id", "n_tokens", "n_known", "base", "score"])

    return run


def lm_scores(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model log10 probabilities of every whole text, one row per row of `docs`.

    Columns: id, `held_out` (crc32 of the id as text leaves 1 when divided by 5), `n_tokens`
    (words and one end), `n_known` (of them met in training texts), `train_tokens`, `base_score`
    (smoothed word counts) and `score` (the mixture). Training texts are all not held out.
    The attention model learns from all of them, and all counts cover all.

    Null text is empty: its end alone is scored. A null id is not held out and its text is
    learnt from. Repeated rows count as often as they are there and are all returned. An
    empty table gives an empty result. Other columns are not read. Without any training text
    the base of every token is 1 and the model knows classes of no use: every id is as likely.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    content = vocabulary(spark, path)
    encoder = Encoder.get(*content.value)
    end = encoder.tokenizer.get_vocab_size() - 1
    words = encoder.tokenizer.id_to_token
    spaced = np.array([(words(i) or "").startswith("Ġ") for i in range(end + 1)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("learn", F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS != HELD_OUT, F.lit(True)))
    learn = rows.where("learn").select("id", "text")
    texts = learn.count()
    frequent, counts, words_met = _frequent(learn)
    tokens = words_met + texts
    model = _model(learn, content, end, parts)
    shared = spark.sparkContext.broadcast(Shared(model, frequent, counts, tokens, texts, end, spaced))  # some MB whatever the corpus

    columns = "kind int, bucket int, body binary, id long, learn boolean, key long, n_tokens long, n_known long, base double, score double"
    scored = cut(rows.mapInArrow(_score(shared, content, parts, parts), columns), "lm")
    rare = scored.where("kind = 1").select("bucket", "body")
    rare = rare.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket")
    summed = cut(rare.mapInArrow(_rare(tokens, parts), "kind int, bucket int, body binary"), "lm")
    met = summed.where("kind = 1").agg(F.sum(F.col("bucket").cast("long"))).first()[0] or 0
    distinct = met + int((counts > 0).sum()) + int(texts > 0)

    own = [F.lit(None).cast(k).alias(c) for c, k in (("id", "long"), ("key", "long"), ("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("score", "double"))]
    whole = scored.where("kind = 0").select(F.lit(1).alias("kind"), "bucket", "body", "id", "key", "n_tokens", "n_known", "base", "score")
    both = summed.where("kind = 0").select("kind", "bucket", "body", *own).unionByName(whole)
    dealt = both.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket", "kind")
    out = dealt.mapInArrow(_sum(tokens, distinct), "id long, n_tokens long, n_known long, base double, score double")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
