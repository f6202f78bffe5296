"""Hard negatives by exact inner products, with coordinate pruning inside length buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, keyed_groups

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
# Rows of a length bucket, of the part of it that is pruned at a time, anchors of a pack and of a product.
BUCKET_ROWS = 1 << 15
PART_ROWS = 1 << 12
PACK_ROWS = 1 << 13
STEP_ROWS = 256
# Pieces of work that a small table is cut into at least, and split points of lengths at most.
TILES = 32
SPLITS = 4096
# Coordinates an anchor prunes by; a part of which it leaves more than this share is verified as one product.
FOCUS = 3
DENSE = 0.2
# Scores of longer rows might leave a long; products below EXACT are exact as doubles.
LONGEST = float(1 << 30)
EXACT = float(1 << 53)

BLOCK = "bucket long, dim int, number int, v binary, ids binary, labels binary, anchors binary"


class Part:
    """Rows of about one length, with one sorted list of values for each coordinate of their directions."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, uids: np.ndarray):
        self.rows, self.ids, self.labels, self.uids = rows, ids, labels, uids
        length = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
        self.longest = float(length.max(initial=0.0))
        self.unit = rows / np.where(length > 0, length, 1.0)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._lists[f] = order, self.unit[order, f]
        return self._lists[f]

    def candidates(self, queries: np.ndarray, length: np.ndarray, floor: np.ndarray):
        """For each query the rows that may reach its floor: none, all (-1), or a list.

        A row at an angle of at most arccos(floor / lengths) to the query has each coordinate of
        its direction in a range around the query's own; ranges of the focus coordinates are
        intersected, beginning with the narrowest.
        """
        n, dim = queries.shape
        least = np.divide(floor, length * self.longest, out=np.full(n, -1.0), where=(floor > 0) & (length * self.longest > 0))
        # a query or a part of length zero scores 0
        nothing = (least > 1 + 1e-9) | ((floor > 0) & (length * self.longest == 0))
        out: list[np.ndarray | int] = [-1] * n
        for i in np.flatnonzero(nothing):
            out[i] = np.zeros(0, np.int64)
        live = np.flatnonzero((least > 0) & ~nothing)
        if not len(live) or not dim:
            return out
        unit = queries[live] / length[live, None]
        angle = np.arccos(np.clip(least[live], -1, 1))
        focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        at = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1))
        high = np.cos(np.maximum(at - angle[:, None], 0)) + 1e-9
        low = np.cos(np.minimum(at + angle[:, None], np.pi)) - 1e-9
        first, last = np.zeros_like(focus), np.zeros_like(focus)
        for f in np.unique(focus):
            which = focus == f
            values = self.sorted_list(int(f))[1]
            first[which] = np.searchsorted(values, low[which])
            last[which] = np.searchsorted(values, high[which], side="right")
        by_width = np.argsort(last - first, axis=1)
        for k, i in enumerate(live):
            narrow, *others = by_width[k]
            if last[k, narrow] - first[k, narrow] > DENSE * len(self.rows):
                continue
            found = self.sorted_list(int(focus[k, narrow]))[0][first[k, narrow] : last[k, narrow]]
            for j in others:
                value = self.unit[found, focus[k, j]]
                found = found[(value >= low[k, j]) & (value <= high[k, j])]
            out[i] = found
        return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, exact: in doubles while no sum can leave them, else in Python's integers."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)))
    bound = np.sqrt(np.square(queries).sum(axis=1).max()) * np.sqrt(np.square(rows).sum(axis=1).max())
    if bound < EXACT / 2:
        return queries @ rows.T
    exact = np.array([[int(x) for x in q] for q in queries], object)
    return exact @ np.array([[int(x) for x in r] for r in rows], object).T


def first_of_each(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Indices of the first `limit` of each slot: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, slot))
    begin = np.flatnonzero(np.concatenate([[True], np.diff(slot[order]) != 0])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(order)]])))
    return order[rank < limit]


class Best:
    """The first rows found so far for each slot; its floor is what a new row has to reach."""

    def __init__(self, floor: np.ndarray, limit: int):
        self.floor, self.limit = floor.astype(np.float64), limit
        self.slot = np.zeros(0, np.int64)
        self.score = np.zeros(0, object)
        self.ids = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, ids = np.concatenate([self.slot, slot]), np.concatenate([self.ids, ids])
        score = np.concatenate([self.score, score.astype(np.int64)]).astype(np.int64)
        keep = first_of_each(slot, score, ids, self.limit)
        self.slot, self.score, self.ids = slot[keep], score[keep], ids[keep]
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(self.floor)) == self.limit)
        worst = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(worst, self.slot, self.score)
        self.floor[full] = np.maximum(self.floor[full], worst[full])


def verified(part: Part, queries: np.ndarray, length: np.ndarray, floor: np.ndarray):
    """Exact scores, some queries at a time: their numbers, the part's rows (None for all) and the products."""
    found = part.candidates(queries, length, floor)
    whole = np.array([i for i, f in enumerate(found) if isinstance(f, int)], np.int64)
    for at in range(0, len(whole), STEP_ROWS):
        some = whole[at : at + STEP_ROWS]
        yield some, None, products(queries[some], part.rows)
    for i, rows in enumerate(found):
        if not isinstance(rows, int) and len(rows):
            yield np.array([i]), rows, products(queries[i : i + 1], part.rows[rows])


def parts_of(blocks: pa.Table, dim: int, by_label: bool) -> dict[int, list[Part]]:
    """The rows of one dimension in parts of decreasing length; apart for each label if asked (else under 0)."""
    rows, ids, labels, uids = unpacked(blocks, dim)
    length = np.einsum("ij,ij->i", rows, rows, dtype=np.float64)
    order = np.lexsort((-length, labels)) if by_label else np.argsort(-length, kind="stable")
    key = labels[order] if by_label else np.zeros(len(order), np.int64)
    out: dict[int, list[Part]] = {}
    begin = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])) if len(order) else []
    for a, b in zip(begin, [*begin[1:], len(order)]):
        out[int(key[a])] = [
            Part(rows[some], ids[some], labels[some], uids[some])
            for some in (order[i : min(b, i + PART_ROWS)] for i in range(a, b, PART_ROWS))]
    return out


def unpacked(blocks: pa.Table, dim: int):
    """Rows, ids, labels and places of the blocks of one dimension."""
    pieces = []
    for row in blocks.to_pylist():
        if row["dim"] != dim:
            continue
        ids = np.frombuffer(row["ids"], np.int64)
        rows = np.frombuffer(row["v"], np.float64 if len(row["v"]) == 8 * dim * len(ids) else np.int16)
        pieces.append((
            rows.reshape(len(ids), dim).astype(np.float64), ids, np.frombuffer(row["labels"], np.int32).astype(np.int64),
            (row["bucket"] << 40) + (row["number"] << 20) + np.arange(len(ids))))
    return [np.concatenate(x) for x in zip(*pieces)]


def packed(rows: np.ndarray, dim: int) -> bytes:
    small = not rows.size or np.abs(rows).max() < 1 << 15
    # a block of dimension zero has no bytes either way
    return rows.astype(np.int16 if small and dim else np.float64).tobytes()


def to_blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Whole buckets as blocks of one dimension each, in the order of their numbers."""
    for group in keyed_groups(batches, "bucket"):
        group = group.combine_chunks()
        lists = group.column("vector").chunk(0)
        dims = np.diff(lists.offsets.to_numpy())
        values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids, labels = (group.column(c).to_numpy() for c in ("id", "label"))
        anchors = group.column("anchor").to_numpy()
        made, number = [], 0
        for dim in np.unique(dims).tolist():
            which = np.flatnonzero(dims == dim)
            for at in range(0, len(which), BUCKET_ROWS):
                some = which[at : at + BUCKET_ROWS]
                v = values[begin[some][:, None] + np.arange(dim)[None, :]]
                made.append((
                    group.column("bucket")[0].as_py(), dim, number, packed(v, dim), ids[some].astype(np.int64).tobytes(),
                    labels[some].astype(np.int32).tobytes(), np.packbits(anchors[some]).tobytes()))
                number += 1
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("bucket", "dim", "number", "v", "ids", "labels", "anchors"), m)) for m in made],
            schema=pa.schema([
                ("bucket", pa.int64()), ("dim", pa.int32()), ("number", pa.int32()), ("v", pa.binary()), ("ids", pa.binary()),
                ("labels", pa.binary()), ("anchors", pa.binary())]))


ANCHOR = "uid long, dim int, id long, label int, v binary"


def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors among the rows of blocks, each with its place as `uid`."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            chosen = np.flatnonzero(np.unpackbits(np.frombuffer(row["anchors"], np.uint8))[: len(ids)])
            rows, _, labels, uids = unpacked(pa.Table.from_pylist([row]), row["dim"])
            yield pa.RecordBatch.from_arrays([
                pa.array(uids[chosen], pa.int64()), pa.array(np.full(len(chosen), row["dim"]), pa.int32()),
                pa.array(ids[chosen], pa.int64()), pa.array(labels[chosen], pa.int32()),
                pa.array([rows[i].tobytes() for i in chosen], pa.binary())], ["uid", "dim", "id", "label", "v"])


def positives_of_tile(anchors: pa.Table, blocks: pa.Table, limit: int) -> pa.Table:
    """The first rows of its own label for each anchor of a pack, out of one bucket."""
    out = {"uid": [], "other": [], "score": []}
    dims = anchors.column("dim").to_numpy()
    for dim in np.intersect1d(dims, blocks.column("dim").to_numpy()).tolist():
        mine = anchors.take(np.flatnonzero(dims == dim))
        queries = vectors_of(mine, dim)
        length = np.sqrt(np.square(queries).sum(axis=1))
        labels, uids = mine.column("label").to_numpy(), mine.column("uid").to_numpy()
        parts = parts_of(blocks, dim, by_label=True)
        best = Best(np.full(len(queries), -np.inf), limit)
        for label in np.unique(labels).tolist():
            which = np.flatnonzero(labels == label)
            for part in parts.get(label, ()):
                for some, rows, scores in verified(part, queries[which], length[which], best.floor[which]):
                    some = which[some]
                    good = scores >= best.floor[some][:, None]
                    if good.sum() > 4 * limit * len(some) and scores.shape[1] > limit:
                        good &= scores >= np.partition(scores, -limit - 1, axis=1)[:, -limit - 1][:, None]
                    q, r = np.nonzero(good)
                    row = r if rows is None else rows[r]
                    other = part.uids[row] != uids[some[q]]
                    best.add(some[q][other], scores[q, r][other], part.ids[row][other])
        out["uid"].append(uids[best.slot])
        out["other"].append(best.ids)
        out["score"].append(best.score)
    return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in out.items()})


def vectors_of(anchors: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(anchors.column("v").to_pylist()), np.float64).reshape(anchors.num_rows, dim)


def negatives_of_tile(anchors: pa.Table, blocks: pa.Table, limit: int, low: int, high: int) -> pa.Table:
    """The first rows of another label in the window of each (anchor, positive) of a pack, out of one bucket."""
    out = {"uid": [], "place": [], "negative": [], "score": []}
    dims = anchors.column("dim").to_numpy()
    for dim in np.intersect1d(dims, blocks.column("dim").to_numpy()).tolist():
        mine = anchors.take(np.flatnonzero(dims == dim))
        queries = vectors_of(mine, dim)
        length = np.sqrt(np.square(queries).sum(axis=1))
        labels, uids = mine.column("label").to_numpy(), mine.column("uid").to_numpy()
        known = mine.column("positive_scores").to_pylist()
        most = max(map(len, known))
        floor, ceiling = np.full((len(known), most), np.inf), np.full((len(known), most), -np.inf)
        for i, scores in enumerate(known):
            floor[i, : len(scores)] = [-(-low * s // 100) for s in scores]
            ceiling[i, : len(scores)] = [high * s // 100 for s in scores]
        # an empty window has nothing to look for
        floor[floor > ceiling] = np.inf
        best = Best(floor.ravel(), limit)
        for part in parts_of(blocks, dim, by_label=False)[0]:
            now = best.floor.reshape(floor.shape)
            # a window below zero asks for all rows
            least = np.where(np.isfinite(now), now, np.inf).min(axis=1)
            for some, rows, scores in verified(part, queries, length, least):
                theirs = part.labels if rows is None else part.labels[rows]
                usable = theirs[None, :] != labels[some][:, None]
                for k in range(most):
                    lowest = best.floor.reshape(floor.shape)[some, k][:, None]
                    good = usable & (scores >= lowest) & (scores <= ceiling[some, k][:, None])
                    if good.sum() > 8 * limit * len(some) and scores.shape[1] > limit:
                        inside = np.where(good, scores.astype(np.float64), -np.inf)
                        good &= scores >= np.partition(inside, -limit, axis=1)[:, -limit][:, None]
                    q, r = np.nonzero(good)
                    row = r if rows is None else rows[r]
                    best.add(some[q] * most + k, scores[q, r], part.ids[row])
        out["uid"].append(uids[best.slot // most])
        out["place"].append(best.slot % most)
        out["negative"].append(best.ids)
        out["score"].append(best.score)
    return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in out.items()})


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", bucket_rows: int = BUCKET_ROWS, pack_rows: int = PACK_ROWS,
) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first `negatives` rows of other labels in a window.

    Components become floor(scale * x), scores are exact integer inner products, higher scores
    and then smaller ids come first; the window of a positive reaches from `low` to `high`
    percent of its score. Columns: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Anchors, a stated share of the rows, meet all rows: packs of anchors and
    length buckets form tiles, each a task's work, and every tile hands on its best only.

    No part take: null ids, labels and vectors, vectors with null or non-finite components, and
    vectors longer than 2^30 after scaling, whose scores might not fit a long. Vectors of
    different dimensions do not meet. A repeated row is a row of its own; a row is only not
    compared with itself. Scores below zero give no negatives. Empty tables, anchors without
    positives and positives without negatives give no rows; other columns are not read.
    """
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    taken = rows.select(
        F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("int").alias("label"),
        F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).withColumn("norm", norm).where(F.col("norm") * scale < LONGEST)
    # equal lengths are spread by a draw far below what pruning could notice
    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / (1 << 20)
    taken = taken.withColumn("near", F.col("norm") * (1 + 1e-9 * draw))
    total, anchors = taken.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    buckets = max(1, -(-total // bucket_rows))
    ranges = min(buckets, SPLITS)
    splits = taken.agg(F.percentile_approx("near", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    shares = -(-buckets // ranges)
    bucket = F.lit(0).cast("long")
    if splits:
        bucket = F.size(F.filter(F.lit(sorted(splits)), lambda s: s < F.col("near"))).cast("long")
    dealt = taken.withColumn("bucket", bucket * shares + F.pmod(F.xxhash64("near", "id"), F.lit(shares)))
    blocks = cut(
        dealt.select("bucket", "id", "label", "vector", "anchor").repartition(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(lambda batches: to_blocks(batches, scale), BLOCK), "negatives-blocks")
    buckets = ranges * shares
    tiles = max(TILES, spark.sparkContext.defaultParallelism)
    packs = max(1, -(-anchors // pack_rows), min(anchors, -(-tiles // buckets)))
    spread = blocks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))

    def tiled(queries: DataFrame, best, schema: str) -> DataFrame:
        """Packs of anchors against all buckets; a pack is one row, so copies of it are not rows of a shuffle."""
        fields = [f for f in queries.columns if f != "pack"]
        dealt = queries.withColumn("pack", F.pmod(F.xxhash64("uid"), F.lit(packs)).cast("int"))
        gathered = dealt.groupBy("pack").agg(F.collect_list(F.struct(*fields)).alias("anchors")).withColumn("bucket", every)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({f.name: pa.array([], f.type) for f in empty}, schema=empty)
            inside = left.column("anchors").combine_chunks().flatten()
            return best(pa.Table.from_struct_array(inside), right).cast(empty)

        empty = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])
        return gathered.groupBy("bucket", "pack").cogroup(spread.groupBy("bucket", "pack")).applyInArrow(run, schema)

    asking = cut(blocks.where("anchors is not null").mapInArrow(anchors_of, ANCHOR), "negatives-anchors")
    found = tiled(asking, lambda a, b: positives_of_tile(a, b, positives), "uid long, other long, score long")
    first = Window.partitionBy("uid").orderBy(F.desc("score"), "other")
    chosen = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    chosen = cut(chosen.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "other", "score"))).alias("p")), "negatives-positives")
    asked = cut(asking.join(chosen, "uid").select(
        "uid", "dim", "id", "label", "v", F.col("p.other").alias("positive_ids"), F.col("p.score").alias("positive_scores")), "negatives-asked")
    near = tiled(
        asked.select("uid", "dim", "label", "v", "positive_scores"),
        lambda a, b: negatives_of_tile(a, b, negatives, low, high), "uid long, place long, negative long, score long")
    ranked = near.withColumn(
        "rank", F.row_number().over(Window.partitionBy("uid", "place").orderBy(F.desc("score"), "negative"))
    ).where(F.col("rank") <= negatives)
    return ranked.join(asked.select("uid", "id", "positive_ids", "positive_scores"), "uid").select(
        F.col("id").alias("anchor_id"), F.col("positive_ids")[F.col("place").cast("int")].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"),
        F.col("positive_scores")[F.col("place").cast("int")].alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = v.label AS same, v.r, v.vec_id,
         CAST(list_dot_product(a.v, v.v) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.r <> v.r WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives AS p JOIN scores AS s ON s.anchor = p.anchor AND NOT s.same
  AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3"""
