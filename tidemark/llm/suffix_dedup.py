"""Removal of repeated passages: byte-exact, by sorted suffixes at content-chosen anchors.

Every string of LENGTH bytes holds an anchor: the place of the least hash among its
GRAM-byte substrings, which depends on the string alone. Two equal strings so share an
anchor with equal bytes around it, and suffixes need sorting at anchors only, about one
byte in 18, and there only where the anchor's bytes occur in two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BASE, BASE_INVERSE, bytes_of, cut, in_chunks, keyed_groups, mix, ranges, runs_of, shuffle_partitions, span_hashes
from tidemark.llm.packed import deltas, pack, unpack

LENGTH = 50
TOKEN = 8  # bytes of a leading token of a suffix
GRAM = 2 * TOKEN
SIDE = LENGTH - GRAM  # bytes of context a string can have on either side of its anchor
WIDTH = GRAM + 2 * SIDE
CHUNK = 192 << 10
FLUSH = 1 << 20
# An anchor in more documents than this exchanges hashes of whole strings, not contexts: no run gets long.
HOT_DOCS = 256
SPLITTER_SAMPLE = 100_000
RANGE_BYTES = 1 << 20  # packed suffixes of a range: what a task holds at once is small
MOVED_BYTES = 16 << 20  # packed suffixes that one task deals to the ranges
UNPACKED_BYTES = 12 << 20  # of them, unpacked, that it holds at once
CUT_BYTES = 4 << 20  # texts that are cut before their rows go on
LOW40 = np.uint64((1 << 40) - 1)
# What a bucket of documents is sent, in this order.
COPIES, FOUND, TEXTS = 0, 1, 2


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of LENGTH bytes inside one text: its start and its anchor; and the hashes of all grams."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    words = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    grams = n - GRAM + 1
    h = words[:grams] * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h += words[TOKEN : TOKEN + grams]
    h *= np.uint64(0xCA5A826395121157)
    h ^= h >> np.uint64(29)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(grams, dtype=np.uint64)
    size, span = 1, SIDE + 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    start = ranges(at[:-1], np.maximum(np.diff(at) - LENGTH + 1, 0))
    return start, (low[start] & np.uint64(0xFFFFFF)).astype(np.int64), h


def split_long(data: np.ndarray, at: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The buffers themselves, or overlapping pieces of a text beyond the reach of 24-bit places."""
    if len(data) <= limit:
        yield 0, data, at
        return
    for begin in range(0, len(data), limit):
        piece = data[begin : begin + limit + LENGTH - 1]
        yield begin, piece, np.array([0, len(piece)])


def buckets_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    for first, size in zip(*(x.tolist() for x in runs_of(bucket))):
        yield int(bucket[first]), [c[order[first : first + size]] for c in columns]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "body"])


def _anchor_hashes(n_buckets: int):
    """Rows (bucket, body): hashes of anchors with their documents, each once per document."""
    def flush(held):
        h, ids = (np.concatenate(x) for x in zip(*held))
        return _batch([(b, pack(*p[:1], deltas(p[1]))) for b, p in by_bucket((h >> np.uint64(40)).astype(np.int64) % n_buckets, h & LOW40, ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in in_chunks(batches, "text", CHUNK):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            whole, starts = bytes_of(batch.column("text"))
            for _, data, at in split_long(whole, starts):
                start, anchor, h = anchors(data, at)
                if not len(start):
                    continue
                anchor = np.unique(anchor)
                doc = np.searchsorted(at, anchor, side="right") - 1
                code = h[anchor] & np.uint64((1 << 63) - 1)
                order = np.lexsort((code, doc))
                code, doc = code[order], doc[order]
                once = np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])
                held.append((code[once], ids[doc[once]]))
                size += int(once.sum())
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _shared_hashes(n_docs: int, hot_docs: int):
    """Rows (bucket of the document, body): ids with the anchor hashes that two documents have, and whether many have it."""
    def run(batches):
        for table in keyed_groups(batches, "bucket"):
            for _, bodies in _grouped(table):
                parts = [unpack(b) for b in bodies]
                h = np.concatenate([p[0] for p in parts])
                ids = np.concatenate([np.cumsum(p[1]) for p in parts])
                order = np.lexsort((ids, h))
                h, ids = h[order], ids[order]
                first, size = runs_of(h)
                many = ids[first] != ids[first + size - 1]
                keep = np.repeat(many, size)
                hot = np.repeat((size > hot_docs).astype(np.uint64), size)[keep]
                h, ids = h[keep], ids[keep]
                if len(h):
                    order = np.argsort(ids, kind="stable")
                    h, ids, hot = h[order], ids[order], hot[order]
                    yield _batch([(b, pack(p[0] * np.uint64(2) + p[2], deltas(p[1]))) for b, p in by_bucket(buckets_of(ids, n_docs), h, ids, hot)])

    return run


def _grouped(table: pa.Table) -> Iterator[tuple[int, list[bytes]]]:
    bucket = table.column("bucket").to_numpy()
    body = table.column("body")
    for first, size in zip(*(x.tolist() for x in runs_of(bucket))):
        yield int(bucket[first]), body.slice(first, size).to_pylist()


def _merge(ids, rows, begin, end):
    """Intervals of each row in order, touching ones as one."""
    order = np.lexsort((begin, rows, ids))
    ids, rows, begin, end = ids[order], rows[order], begin[order], end[order]
    if not len(ids):
        return ids, rows, begin, end
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])])
    group = np.cumsum(new) - 1
    shift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    fresh = np.concatenate([[True], (begin[1:] + shift[1:]) > reach[:-1]])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:] - 1, [len(ids) - 1]])
    return ids[first], rows[first], begin[first], reach[last] - shift[first]


def _span_rows(ids, rows, begin, end, n_docs):
    ids, rows, begin, end = _merge(ids, rows, begin, end)
    return [(b, pack(*p)) for b, p in by_bucket(buckets_of(ids, n_docs), ids, rows, begin, end - begin)]


def _covered_by_smaller(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a smaller id has the same key."""
    order = np.lexsort((ids, key))
    k = key[order]
    first, size = runs_of(k)
    out = np.zeros(len(key), bool)
    out[order] = ids[order] > np.repeat(ids[order][first], size)
    return out


def row_hashes(context: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes, eight bytes at a time; the last eight may overlap."""
    out = np.zeros(len(context), np.uint64)
    for a in [*range(0, WIDTH - 7, 8), WIDTH - 8]:
        word = np.ascontiguousarray(context[:, a : a + 8]).view("<u8").ravel()
        out = mix(out ^ (word + np.uint64(a)))
    return out


def _contexts(n_docs: int):
    """Rows (kind, bucket, body) from documents and the shared hashes of their bucket.

    Kind 0: spans already known to be repeated, by what is equal inside this task. Kind 1:
    bytes around anchors, one per distinct content. Kind 2: hashes of whole strings at hot anchors.
    """
    def out(kind, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
            ["kind", "bucket", "body"])

    def flush(near, hot):
        if near:
            context, left, right, ids, rows, place = (np.concatenate(x) for x in zip(*near))
            key = mix(row_hashes(context) ^ (left * 64 + right).astype(np.uint64))
            again = _covered_by_smaller(key, ids)
            if again.any():
                yield out(0, _span_rows(ids[again], rows[again], (place - left)[again], (place + GRAM + right)[again], n_docs))
            keep = ~again
            yield out(1, [(0, pack(context[keep].ravel(), left[keep], right[keep], deltas(ids[keep]), rows[keep], place[keep]))])
        if hot:
            key, ids, rows, place = (np.concatenate(x) for x in zip(*hot))
            again = _covered_by_smaller(key, ids)
            if again.any():
                yield out(0, _span_rows(ids[again], rows[again], place[again], place[again] + LENGTH, n_docs))
            keep = ~again
            yield out(2, [(0, pack(key[keep], deltas(ids[keep]), rows[keep], place[keep]))])

    def run(batches):
        near, hot, size = [], [], 0
        bucket, shared_ids, shared = None, None, None
        waiting, gone = [], set()
        for batch in batches:
            for i in range(batch.num_rows):
                kind, of = batch.column("kind")[i].as_py(), batch.column("bucket")[i].as_py()
                if of != bucket:
                    bucket, waiting, shared, gone = of, [], None, set()
                if kind == COPIES:
                    gone.update(unpack(batch.column("body")[i].as_py())[1].tolist())
                    continue
                if kind == FOUND:
                    waiting.append(batch.column("body")[i].as_py())
                    continue
                me, row = batch.column("id")[i].as_py(), batch.column("row")[i].as_py()
                if not waiting or row in gone:
                    continue
                if shared is None:
                    parts = [unpack(b) for b in waiting]
                    shared_ids = np.concatenate([np.cumsum(p[1]) for p in parts])
                    shared = np.concatenate([p[0] for p in parts])
                    order = np.argsort(shared_ids, kind="stable")
                    shared_ids, shared = shared_ids[order], shared[order]
                a, b = np.searchsorted(shared_ids, me), np.searchsorted(shared_ids, me, side="right")
                if a == b:
                    continue
                wanted = np.sort(shared[a:b])
                text = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("body")[i].as_py()), np.uint8)
                for shift, data, at in split_long(text, np.array([0, len(text)])):
                    start, anchor, h = anchors(data, at)
                    if not len(start):
                        continue
                    each = np.unique(anchor)
                    code = h[each] & LOW40
                    spot = np.minimum(np.searchsorted(wanted, code * np.uint64(2)), len(wanted) - 1)
                    hit = (wanted[spot] >> np.uint64(1)) == code
                    is_hot = np.isin(code * np.uint64(2) + np.uint64(1), wanted)
                    place = each[hit & ~is_hot]
                    if len(place):
                        window = np.zeros(len(data) + 2 * SIDE, np.uint8)
                        window[SIDE : SIDE + len(data)] = data
                        left, right = np.minimum(place, SIDE), np.minimum(len(data) - place - GRAM, SIDE)
                        near.append((window[place[:, None] + np.arange(WIDTH)[None, :]], left, right,
                                     np.full(len(place), me), np.full(len(place), row), place + shift))
                        size += len(place) * WIDTH
                    if is_hot.any():
                        owned = start[np.isin(anchor, each[is_hot])]
                        hot.append((span_hashes(data, owned, owned + LENGTH), np.full(len(owned), me), np.full(len(owned), row), owned + shift))
                        size += len(owned) * 32
                if size >= 8 << 20:
                    yield from flush(near, hot)
                    near, hot, size = [], [], 0
        yield from flush(near, hot)

    return run


def leading_tokens(context: np.ndarray) -> np.ndarray:
    """The suffix at each anchor as big-endian tokens: the gram's two, then those of the right side."""
    n = len(context)
    suffix = np.zeros((n, -(-(GRAM + SIDE) // TOKEN) * TOKEN), np.uint8)
    suffix[:, : GRAM + SIDE] = context[:, SIDE:]
    return suffix.view(">u8").astype(np.uint64)


def multikey_order(tokens: np.ndarray) -> np.ndarray:
    """Order of rows of tokens: by the first token, then only rows still equal by the next, and so on."""
    order = np.argsort(tokens[:, 0], kind="stable")
    run = np.zeros(len(order), np.int64)
    for j in range(1, tokens.shape[1]):
        here = tokens[order, j - 1]
        run = np.cumsum(np.concatenate([[0], ((here[1:] != here[:-1]) | (run[1:] != run[:-1])).astype(np.int64)])) if len(here) else run
        first, size = runs_of(run)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        inner = np.lexsort((tokens[order[tied], j], run[tied]))
        order[tied] = order[tied][inner]
    return order


def _sample_tokens(batches):
    for batch in batches:
        for body in batch.column("body").to_pylist():
            context = unpack(body)[0].reshape(-1, WIDTH)
            step = max(1, len(context) // 64)
            lead = leading_tokens(context[::step])[:64, :2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lead[:, 0].view(np.int64)), pa.array(lead[:, 1].view(np.int64))], ["t0", "t1"])


def _together(bodies: Iterator[pa.RecordBatch], ids_at: int, limit: int = UNPACKED_BYTES) -> Iterator[list[np.ndarray]]:
    """Columns of several unpacked bodies, about `limit` bytes of them at a time; packed they may be a small part of that."""
    def joined():
        # the parts go column by column, so that they are not held twice
        width = len(held[0])
        return [np.concatenate([np.cumsum(p.pop(0)) if i == ids_at else p.pop(0) for p in held]) for i in range(width)]

    held, size = [], 0
    for batch in bodies:
        for body in batch.column("body"):
            held.append(unpack(body.as_py()))
            size += sum(c.nbytes for c in held[-1])
            if size >= limit:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _by_splitters(splitters: np.ndarray):
    """Each context to the bucket of its leading tokens; equal grams never part."""
    def run(batches):
        for context, left, right, ids, rows, place in _together(batches, 3):
            context = context.reshape(-1, WIDTH)
            lead = np.ascontiguousarray(context[:, SIDE : SIDE + GRAM]).view(f"S{GRAM}").ravel()
            bucket = np.searchsorted(splitters, lead, side="right")
            for b, (i,) in by_bucket(bucket, np.arange(len(left))):
                yield _batch([(b, pack(context[i].ravel(), left[i], right[i], deltas(ids[i]), rows[i], place[i]))])

    return run


def _by_hash(n_strings: int):
    """Each hash of a string to its bucket."""
    def run(batches):
        for key, ids, rows, place in _together(batches, 1):
            bucket = (key >> np.uint64(40)).astype(np.int64) % n_strings
            yield _batch([(b, pack(p[0], deltas(p[1]), *p[2:])) for b, p in by_bucket(bucket, key, ids, rows, place)])

    return run


def repeated_around(context, left, right, ids) -> tuple[np.ndarray, np.ndarray]:
    """How far before and after its anchor each row is covered by strings a smaller id has: least and greatest start."""
    tokens = leading_tokens(context)
    order = multikey_order(tokens)
    grams = tokens[:, : GRAM // TOKEN][order]
    del tokens
    same = (grams[1:] == grams[:-1]).all(axis=1) if len(order) else np.zeros(0, bool)
    run = np.concatenate([[0], np.cumsum(~same)]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    first, size = runs_of(run)
    met = np.repeat(np.minimum.reduceat(ids[order], first) < np.maximum.reduceat(ids[order], first), size) if len(order) else np.zeros(0, bool)
    live = order[met]
    most, least = np.full(len(ids), -1), np.full(len(ids), SIDE + 1)
    if not len(live):
        return most, least
    column = np.ascontiguousarray(context[live].T)
    base, inverse = np.uint64(BASE), np.uint64(BASE_INVERSE)
    lift = np.uint64(pow(BASE, LENGTH - 1, 1 << 64))
    # the hash of the string that begins at the anchor, then of those that begin one byte earlier each
    window = np.zeros(len(live), np.uint64)
    for j in range(SIDE, WIDTH):
        window = window * base + column[j] + np.uint64(1)
    for delta in range(SIDE + 1):
        a = SIDE - delta
        if delta:
            window = (window - column[a + LENGTH] - np.uint64(1)) * inverse + (column[a] + np.uint64(1)) * lift
        able = np.flatnonzero((left[live] >= delta) & (right[live] >= SIDE - delta))
        if not len(able):
            continue
        key = mix(window[able])
        hit = live[able[_covered_by_smaller(key, ids[live[able]])]]
        most[hit] = np.maximum(most[hit], delta)
        least[hit] = np.minimum(least[hit], delta)
    return most, least


def _compare_contexts(n_docs: int):
    def run(batches):
        for table in keyed_groups(batches, "bucket"):
            for _, bodies in _grouped(table):
                parts = [unpack(b) for b in bodies]
                context = np.concatenate([p[0] for p in parts]).reshape(-1, WIDTH)
                left, right, rows, place = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 4, 5))
                ids = np.concatenate([np.cumsum(p[3]) for p in parts])
                most, least = repeated_around(context, left, right, ids)
                hit = most >= 0
                if hit.any():
                    yield _batch(_span_rows(ids[hit], rows[hit], (place - most)[hit], (place - least)[hit] + LENGTH, n_docs))

    return run


def _compare_strings(n_docs: int):
    def run(batches):
        for table in keyed_groups(batches, "bucket"):
            for _, bodies in _grouped(table):
                parts = [unpack(b) for b in bodies]
                key, rows, place = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
                ids = np.concatenate([np.cumsum(p[1]) for p in parts])
                again = _covered_by_smaller(key, ids)
                if again.any():
                    yield _batch(_span_rows(ids[again], rows[again], place[again], place[again] + LENGTH, n_docs))

    return run


def _cut_out(as_text: bool):
    """Documents with the spans of their bucket taken out."""
    def run(batches):
        bucket, waiting, spans, whole = None, [], None, set()
        none = np.zeros(0, np.int64)

        def flush(batch, done):
            picked, sizes, gone, runs, kept = zip(*done)
            index = pa.array(picked)
            out = [pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
            return pa.RecordBatch.from_arrays(
                [batch.column("id").take(index), batch.column("rest").take(index), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), *out],
                ["id", "rest", "n_bytes", "n_removed", "n_spans", "kept"])

        for batch in batches:
            kinds, of = batch.column("kind").to_numpy(), batch.column("bucket").to_numpy()
            body, rows = batch.column("body"), batch.column("row")
            done, held = [], 0
            for i in range(batch.num_rows):
                if of[i] != bucket:
                    bucket, waiting, spans, whole = of[i], [], None, set()
                if kinds[i] == COPIES:
                    whole.update(unpack(body[i].as_py())[1].tolist())
                    continue
                if kinds[i] == FOUND:
                    waiting.append(body[i].as_py())
                    continue
                if spans is None:
                    parts = [unpack(b) for b in waiting]
                    cols = [np.concatenate([p[j] for p in parts]) if parts else none for j in range(4)]
                    spans = _merge(cols[0], cols[1], cols[2], cols[2] + cols[3])
                    order = np.lexsort((spans[2], spans[1]))
                    spans = [c[order] for c in spans]
                text = zstandard.ZstdDecompressor().decompress(body[i].as_py())
                row = rows[i].as_py()
                held += len(text)
                if row in whole and len(text) >= LENGTH:
                    done.append((i, len(text), len(text), 1, b""))
                else:
                    a, b = np.searchsorted(spans[1], row), np.searchsorted(spans[1], row, side="right")
                    if batch.column("id")[i].as_py() is None:
                        a = b
                    left, at = [], 0
                    for begin, end in zip(spans[2][a:b].tolist(), spans[3][a:b].tolist()):
                        left.append(text[at:begin])
                        at = end
                    left.append(text[at:])
                    rest = b"".join(left)
                    done.append((i, len(text), len(text) - len(rest), int(b - a), rest))
                if held >= CUT_BYTES:
                    yield flush(batch, done)
                    done, held = [], 0
            if done:
                yield flush(batch, done)

    return run


def _copy_rows(n_docs: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
                yield _batch([(b, pack(*p)) for b, p in by_bucket(buckets_of(ids, n_docs), ids, rows)])

    return run


def _press(n_docs: int):
    """Documents with a bucket by id and the text compressed."""
    def run(batches):
        for batch in in_chunks(batches, "text", 4 << 20):
            press = zstandard.ZstdCompressor(level=1)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids = batch.column("id").fill_null(0).to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array(buckets_of(np.ascontiguousarray(ids), n_docs).astype(np.int32)), batch.column("id"), batch.column("row"),
                pa.array([press.compress(t or b"") for t in texts], pa.binary()), batch.column("rest")],
                ["bucket", "id", "row", "body", "rest"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, hot_docs: int = HOT_DOCS,
) -> DataFrame:
    """Take out of every text the bytes of 50-byte strings that also start in a document with a smaller id.

    One row per row of `docs`: `id`, `rest` (a struct of all other columns, whatever their
    names), `n_bytes`, `n_removed`, `n_spans` (maximal removed runs) and `kept`, the remaining
    bytes; with `as_text` these as a string, less the halves of characters that a cut left.

    1. Exact copies of a smaller document are found by SHA-256; they go as a whole.
    2. Hashes of anchors meet; those in one document only are dropped.
    3. The bytes around the others are range-partitioned by splitters sampled from their
       leading tokens, sorted in each bucket by multikey sort, and compared inside runs of
       equal grams. Splitters stand between grams, so no run crosses a boundary. An anchor of
       more than `hot_docs` documents exchanges hashes of its strings instead, which spread.
    4. Spans meet their documents, by buckets of ids.

    Strings are compared by 64-bit hashes. Null text is empty. A row with a null id has no
    place in the order: it is kept whole and nothing is removed because of it. Rows with one
    id are one document: none removes from another. Texts below 50 bytes stay. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    n_docs, n_buckets = parts, parts
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("_"), *others).alias("rest"))
    source = source.withColumn("row", F.xxhash64("id", "text"))

    digests = cut(source.where("id IS NOT NULL").select("id", "row", F.unhex(F.sha2("text", 256)).alias("sha")), "suffix")
    firsts = digests.groupBy("sha").agg(F.min("id").alias("least"))
    copies = digests.join(firsts, "sha").where("id > least").select("id", "row")
    copies = cut(copies.mapInArrow(_copy_rows(n_docs), "bucket int, body binary"), "suffix")

    ided = source.where("id IS NOT NULL")
    hashes = ided.select("id", "text").mapInArrow(_anchor_hashes(n_buckets), "bucket int, body binary")
    shared = hashes.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket").mapInArrow(_shared_hashes(n_docs, hot_docs), "bucket int, body binary")
    shared = cut(shared, "suffix")

    rest_type = source.schema["rest"].dataType.simpleString()

    def pressed(frame, with_rest: bool):
        columns = ["id", "row", "text", "rest" if with_rest else F.lit(None).cast("boolean").alias("rest")]
        kind = rest_type if with_rest else "boolean"
        return frame.select(*columns).mapInArrow(_press(n_docs), f"bucket int, id long, row long, body binary, rest {kind}")

    def met(bodies: DataFrame, frame: DataFrame) -> DataFrame:
        own = [f for f in frame.schema if f.name not in ("bucket", "body")]
        lists = copies.withColumn("kind", F.lit(COPIES)).unionByName(bodies.withColumn("kind", F.lit(FOUND)))
        both = lists.select("kind", "bucket", "body", *[F.lit(None).cast(f.dataType).alias(f.name) for f in own]).unionByName(
            frame.select(F.lit(TEXTS).alias("kind"), "bucket", "body", *[f.name for f in own]))
        return both.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket", "kind")

    around = met(shared, pressed(ided, False).drop("rest"))
    around = cut(around.mapInArrow(_contexts(n_docs), "kind int, bucket int, body binary"), "suffix")
    known = around.where("kind = 0").select("bucket", "body")
    contexts = around.where("kind = 1").select("bucket", "body")
    strings = around.where("kind = 2").select("bucket", "body")

    rows, near = contexts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    hot = strings.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    n_ranges, n_strings = -(-near // RANGE_BYTES) + 1, -(-hot // RANGE_BYTES) + 1
    contexts, strings = contexts.coalesce(near // MOVED_BYTES + 1), strings.coalesce(hot // MOVED_BYTES + 1)
    sampled = contexts.sample(min(1.0, SPLITTER_SAMPLE / 64 / rows), seed=1) if rows else contexts
    tokens = sampled.mapInArrow(_sample_tokens, "t0 long, t1 long").collect()
    lead = np.sort(np.array([np.array(t, np.int64).astype(">i8").tobytes() for t in tokens], f"S{GRAM}"))
    splitters = np.unique(lead[np.linspace(0, len(lead) - 1, n_ranges + 1).astype(int)[1:-1]]) if len(lead) else lead

    by_range = contexts.mapInArrow(_by_splitters(splitters), "bucket int, body binary")
    found = by_range.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket").mapInArrow(_compare_contexts(n_docs), "bucket int, body binary")
    whole = strings.mapInArrow(_by_hash(n_strings), "bucket int, body binary").repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket").mapInArrow(_compare_strings(n_docs), "bucket int, body binary")
    spans = cut(known.unionByName(found).unionByName(whole), "suffix")

    return met(spans, pressed(source, True)).mapInArrow(
        _cut_out(as_text),
        f"id long, rest {rest_type}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
