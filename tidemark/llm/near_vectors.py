"""Near-duplicate vectors by spherical caps: product codes list-decode vectors to filters, filters are joined, pairs verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import components, cut, keyed_groups, runs_of

COSINE = 0.95
# Mean size of a bucket, rows that one block of a bucket or of a neighbourhood has at most.
BUCKET = 64
HOT_ROWS = 4096
CELL_ROWS = 1 << 13
# Independent codes, share of pairs at the very threshold that may miss each other, pairs drawn to measure it.
CODES = 2
MISSED = 0.001
DRAWN = 5000
# Coordinates of a direction that travel with a filter, as bytes.
HEAD = 24
LEAST_DIM = 16
MARGIN = 1e-7
SEED = 20


class Code:
    """Filters of one dimension: after a random rotation, every combination of one word of each block is a direction.

    A vector belongs to the directions that exceed its level, the `wanted`-th greatest of its
    products with all of them; so every vector has as many filters, and near ones share most.
    """

    made: dict[tuple, Code] = {}

    def __init__(self, dim: int, rows: int, cosine: float):
        self.dim = max(dim, LEAST_DIM)
        draw = np.random.default_rng([SEED, dim])
        self.wanted = 6
        while True:
            self._deal(draw, rows)
            if self._missed(draw, cosine) <= MISSED:
                break
            self.wanted = int(self.wanted * 1.35) + 1

    @classmethod
    def get(cls, dim: int, rows: int, cosine: float) -> Code:
        key = (dim, rows, cosine)
        if key not in cls.made:
            cls.made[key] = cls(*key)
        return cls.made[key]

    def _deal(self, draw: np.random.Generator, rows: int) -> None:
        """Books for so many directions that a bucket holds `BUCKET` vectors in the mean."""
        directions = max(64.0, rows * self.wanted / BUCKET)
        blocks = 2
        while directions ** (1 / blocks) > 1024:
            blocks += 1
        self.size = max(2, round(directions ** (1 / blocks)))
        self.width = -(-self.dim // blocks)
        self.turns, self.books = [], []
        for _ in range(CODES):
            turn, _ = np.linalg.qr(draw.normal(size=(self.width * blocks,) * 2))
            self.turns.append(turn[: self.dim])
            books = draw.normal(size=(blocks, self.size, self.width))
            self.books.append(books / np.linalg.norm(books, axis=2, keepdims=True))

    def _missed(self, draw: np.random.Generator, cosine: float) -> float:
        """Share of random pairs at the threshold that no filter brings together."""
        a, b = _directions(draw, DRAWN, self.dim), _directions(draw, DRAWN, self.dim)
        b -= np.einsum("ij,ij->i", a, b)[:, None] * a
        b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1)[:, None]
        met = np.zeros(DRAWN, bool)
        (row_a, of_a), (row_b, of_b) = self.decode(a), self.decode(b)
        met[np.intersect1d(_paired(row_a, of_a), _paired(row_b, of_b))["row"]] = True
        return float((~met).mean())

    def blocks_of(self, unit: np.ndarray, code: int) -> list[np.ndarray]:
        turned = self.padded(unit) @ self.turns[code]
        return [turned[:, b * self.width : (b + 1) * self.width] @ book.T for b, book in enumerate(self.books[code])]

    def padded(self, unit: np.ndarray) -> np.ndarray:
        return unit if unit.shape[1] == self.dim else np.pad(unit, ((0, 0), (0, self.dim - unit.shape[1])))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row, filter) of unit vectors, block by block over sorted lists of words.

        The sum of the i-th best choice so far and the j-th best word of the next block has i * j
        sums at least as great (itself included), so only those with i * j <= wanted are formed.
        """
        rows, filters = [], []
        for at in range(0, len(unit), 4096):
            part = unit[at : at + 4096]
            for code in range(CODES):
                sums, word = np.zeros((len(part), 1)), np.zeros((len(part), 1), np.int64)
                for score in self.blocks_of(part, code):
                    best = self._best(score)
                    one, two = np.divmod(np.arange(sums.shape[1] * best.shape[1]), best.shape[1])
                    formed = (one + 1) * (two + 1) <= self.wanted
                    one, two = one[formed], two[formed]
                    total = sums[:, one] + np.take_along_axis(score, best, axis=1)[:, two]
                    words = word[:, one] * self.size + best[:, two]
                    keep = self._best(total)
                    sums, word = np.take_along_axis(total, keep, axis=1), np.take_along_axis(words, keep, axis=1)
                rows.append(np.repeat(np.arange(at, at + len(part)), word.shape[1]))
                filters.append((word + (code << 43)).ravel())
        return np.concatenate(rows), np.concatenate(filters)

    def _best(self, score: np.ndarray) -> np.ndarray:
        """Columns of the greatest values of each row, the greatest first."""
        if score.shape[1] <= self.wanted:
            return np.argsort(-score, axis=1)
        top = np.argpartition(-score, self.wanted - 1, axis=1)[:, : self.wanted]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1), axis=1)

    def head(self, unit: np.ndarray) -> np.ndarray:
        """The first coordinates of the rotated vectors, zeros where there are fewer."""
        turned = (self.padded(unit) @ self.turns[0])[:, :HEAD]
        return np.pad(turned, ((0, 0), (0, HEAD - turned.shape[1])))


def _directions(draw: np.random.Generator, n: int, dim: int) -> np.ndarray:
    out = draw.normal(size=(n, dim))
    return out / np.linalg.norm(out, axis=1)[:, None]


def _paired(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), [("row", np.int64), ("value", np.int64)])
    out["row"], out["value"] = row, value
    return out


def unit_of(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and unit vectors of an array of lists, one dimension after the other."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    dims = np.diff(offsets)
    for dim in np.unique(dims).tolist():
        which = np.flatnonzero(dims == dim)
        v = values[offsets[which][:, None] + np.arange(dim)[None, :]]
        # the greatest component first, so that squares neither overflow nor vanish
        v = v / np.abs(v).max(axis=1)[:, None]
        yield which, v / np.sqrt(np.square(v).sum(axis=1))[:, None]


def homes_of(batches: Iterator[pa.RecordBatch], cells: int, cosine: float, rows: int) -> Iterator[pa.RecordBatch]:
    """The class rows with `home`, the words nearest to the vector among few in each block."""
    few = max(1, round(cells**0.5))
    for batch in batches:
        home = np.zeros(batch.num_rows, np.int64)
        for which, unit in unit_of(batch.column("vector")):
            code = Code.get(unit.shape[1], rows, cosine)
            near = np.zeros(len(unit), np.int64)
            for score in code.blocks_of(unit, 0)[:2]:
                words = min(few, code.size)
                near = near * words + score[:, :words].argmax(axis=1)
            home[which] = near + (unit.shape[1] << 45)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], [*batch.schema.names, "home"])


def stars(unit: np.ndarray, cosine: float) -> np.ndarray:
    """For each row its leader: the first row, in order, that is linked with it and has no other leader."""
    n = len(unit)
    leader = np.full(n, -1)
    for at in range(0, n, 1024):
        # against the leaders so far
        block = np.arange(at, min(n, at + 1024))
        known = np.flatnonzero(leader[:at] == np.arange(at))
        for k in range(0, len(known), 4096):
            free = block[leader[block] < 0]
            if not len(free):
                break
            linked = unit[free] @ unit[known[k : k + 4096]].T >= cosine
            hit = linked.any(axis=1)
            leader[free[hit]] = known[k : k + 4096][linked[hit].argmax(axis=1)]
        free = block[leader[block] < 0]
        linked = unit[free] @ unit[free].T >= cosine
        alone = linked.sum(axis=1) <= 1
        leader[free[alone]] = free[alone]
        for i in np.flatnonzero(~alone):
            if leader[free[i]] < 0:
                mine = linked[i] & (leader[free] < 0)
                mine[i] = True
                leader[free[mine]] = free[i]
    return leader


MEMBER = T.StructType([
    T.StructField("class", T.LongType()), T.StructField("ball", T.LongType()), T.StructField("copies", T.LongType()),
    T.StructField("inside", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())),
    T.StructField("weight", T.LongType()), T.StructField("members", T.LongType()), T.StructField("radius", T.DoubleType()),
    T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("filters", T.ArrayType(T.LongType())),
    T.StructField("head", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("rest", T.DoubleType()),
])


def balls_of(batches: Iterator[pa.RecordBatch], cosine: float, rows: int) -> Iterator[pa.RecordBatch]:
    """Classes gathered into balls, cell by cell: a leader with rows linked to it, around their mean direction.

    `inside` counts a class's links within its ball, copies included. The leader's row also describes
    the ball: weight and number of members, centre, radius as an angle, the filters of all members,
    and the first coordinates of the centre as bytes with the length of what they leave out.
    """
    for group in keyed_groups(batches, "cell"):
        home, salt = (group.column(c).to_numpy() for c in ("home", "salt"))
        border = np.flatnonzero(np.concatenate([[True], (np.diff(home) != 0) | (np.diff(salt) != 0), [True]]))
        for a, b in zip(border[:-1], border[1:]):
            cell = group.slice(a, b - a)
            for which, unit in unit_of(cell.column("vector")):
                yield from _balls(cell.column("class").to_numpy()[which], cell.column("copies").to_numpy()[which], unit, cosine, rows)


def _balls(classes: np.ndarray, copies: np.ndarray, unit: np.ndarray, cosine: float, rows: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(classes, kind="stable")
    classes, copies, unit = classes[order], copies[order], unit[order]
    leader = stars(unit, cosine)
    order = np.argsort(leader, kind="stable")
    begin, sizes = runs_of(leader[order])
    code = Code.get(unit.shape[1], rows, cosine)
    of_row, filters = code.decode(unit)
    n = len(unit)
    inside, centre, radius = copies - 1, unit.copy(), np.zeros(n)
    for a, size in zip(begin[sizes > 1], sizes[sizes > 1]):
        some = order[a : a + size]
        mean = unit[some].sum(axis=0)
        first = leader[some[0]]
        centre[first] = mean / np.linalg.norm(mean)
        radius[first] = np.arccos(np.clip(unit[some] @ centre[first], -1, 1)).max() + MARGIN
        for at in range(0, size, 1024):
            part = some[at : at + 1024]
            inside[part] = (unit[part] @ unit[some].T >= cosine) @ copies[some] - 1
            # a vector's product with itself may fall short of 1, never of the threshold
    leads = leader == np.arange(n)
    ball_filters = np.unique(_paired(leader[of_row], filters))
    counts = np.bincount(ball_filters["row"], minlength=n)
    head, scale, rest = sketched(code, centre)
    weight = np.bincount(leader, weights=copies, minlength=n).astype(np.int64)
    members = np.bincount(leader, minlength=n)
    dim = unit.shape[1]
    key = ball_filters["value"] + (dim << 45)
    at = np.concatenate([[0], np.cumsum(counts)])
    for lo in range(0, n, 4096):
        some = np.arange(lo, min(n, lo + 4096))
        no = ~leads[some]
        yield pa.RecordBatch.from_arrays([
            pa.array(classes[some]), pa.array(classes[leader[some]]), pa.array(copies[some]), pa.array(inside[some]),
            _lists(unit[some], np.zeros(len(some), bool)), pa.array(weight[some], mask=no), pa.array(members[some], mask=no),
            pa.array(radius[some], mask=no), _lists(centre[some], no),
            pa.ListArray.from_arrays(pa.array(at[lo : some[-1] + 2] - at[lo], pa.int32()), pa.array(key[at[lo] : at[some[-1] + 1]])),
            pa.array([None if x else head[i].tobytes() for i, x in zip(some, no)], pa.binary()),
            pa.array(scale[some], mask=no), pa.array(rest[some], mask=no)], MEMBER.names)


def _lists(rows: np.ndarray, empty: np.ndarray) -> pa.Array:
    sizes = np.where(empty, 0, rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(rows[~empty].ravel()))


def sketched(code: Code, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heads as signed bytes, the size of a step, and the length of all that the bytes leave out."""
    head = code.head(unit)
    scale = np.maximum(np.abs(head).max(axis=1), 1e-12) / 127
    steps = np.rint(head / scale[:, None]).astype(np.int8)
    kept = steps * scale[:, None]
    # the error of the bytes and the coordinates beyond them are orthogonal
    rest = np.sqrt(np.maximum(0, 1 - np.square(head).sum(axis=1)) + np.square(head - kept).sum(axis=1))
    return steps, scale, rest


def maybe_near(left, right, angle: float) -> np.ndarray:
    """Which pairs of balls may hold a link, by an upper bound on the cosine of their centres.

    The bytes' own product is exact; of what they leave out, the other coordinates meet one another
    only, and the bytes' errors are at most half a step a coordinate.
    """
    (steps, scale, rest, radius), (steps2, scale2, rest2, radius2) = left, right
    width = np.sqrt(steps.shape[1])
    kept = (steps.astype(np.float32) * scale[:, None].astype(np.float32)) @ (steps2.astype(np.float32) * scale2[:, None].astype(np.float32)).T
    crossed = 0.5 * width * (scale[:, None] + scale2[None, :]) * 1.05
    bound = kept + crossed + rest[:, None] * rest2[None, :] + 1e-4
    reach = np.minimum(np.pi, angle + radius[:, None] + radius2[None, :] + MARGIN)
    return bound >= np.cos(reach)


def meetings(batches: Iterator[pa.RecordBatch], angle: float) -> Iterator[pa.RecordBatch]:
    """Pairs of balls, the lesser first, that share a filter and may hold a link."""
    for group in keyed_groups(batches, "place"):
        f, i, j = (group.column(c).to_numpy() for c in ("filter", "one", "two"))
        mine, ball = group.column("mine").to_numpy(), group.column("ball").to_numpy()
        steps = np.frombuffer(b"".join(group.column("head").to_pylist()), np.int8).reshape(-1, HEAD)
        scale, rest, radius = (group.column(c).to_numpy() for c in ("scale", "rest", "radius"))
        border = np.flatnonzero(np.concatenate([[True], (np.diff(f) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0), [True]]))
        out = []
        for a, b in zip(border[:-1], border[1:]):
            if b - a < 2:
                continue
            some = np.arange(a, b)
            if i[a] == j[a]:
                one = two = some
            else:
                one, two = some[mine[some] == i[a]], some[mine[some] == j[a]]
            for at in range(0, len(one), 1024):
                part = one[at : at + 1024]
                near = maybe_near(
                    (steps[part], scale[part], rest[part], radius[part]), (steps[two], scale[two], rest[two], radius[two]), angle)
                x, y = np.nonzero(near)
                x, y = ball[part[x]], ball[two[y]]
                keep = x < y if i[a] == j[a] else x != y
                out.append(np.unique(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]]), axis=1))
        pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["p", "q"])


ALL, SOME = 0, 1


def settled(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """What the angle of two centres says: all of their members are linked, or some may be; no row for none."""
    angle = np.arccos(cosine)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (_matrix(batch.column(c)) for c in ("centre_p", "centre_q"))
        radius = batch.column("radius_p").to_numpy() + batch.column("radius_q").to_numpy()
        alone = batch.column("members_p").to_numpy() + batch.column("members_q").to_numpy() == 2
        product = np.concatenate([np.einsum("ij,ij->i", x[None], y[None]) for x, y in zip(a, b)])
        between = np.arccos(np.clip(product, -1, 1))
        linked = np.where(alone, product >= cosine, between + radius <= angle - MARGIN)
        kept = linked | (~alone & (between - radius <= angle + MARGIN))
        table = batch.filter(pa.array(kept))
        yield pa.RecordBatch.from_arrays(
            [*(table.column(c) for c in ("p", "q", "weight_p", "weight_q")), pa.array(np.where(linked, ALL, SOME)[kept], pa.int32())],
            ["p", "q", "weight_p", "weight_q", "kind"])


def _matrix(lists: pa.Array) -> list[np.ndarray]:
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [values[x:y] for x, y in zip(offsets[:-1], offsets[1:])]


def _rows(lists) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


ASKED = pa.schema([("class", pa.int64()), ("p", pa.int64()), ("q", pa.int64()), ("found", pa.int64()), ("vector", pa.list_(pa.float64()))])


def against_centres(members: pa.Table, balls: pa.Table, cosine: float) -> pa.Table:
    """Each member of one ball against neighbouring balls: the sum of their weights where all of a ball
    is linked with it, or a question to the ball's members (`found` null)."""
    if not members.num_rows or not balls.num_rows:
        return ASKED.empty_table()
    angle = np.arccos(cosine)
    centres, radius = _rows(balls.column("centre")), balls.column("radius").to_numpy()
    weight, q = balls.column("weight").to_numpy(), balls.column("q").to_numpy()
    unit, classes = _rows(members.column("vector")), members.column("class").to_numpy()
    p, total, beside, out = members.column("ball")[0].as_py(), np.zeros(len(unit), np.int64), np.zeros(len(q), bool), []
    for at in range(0, len(unit), 1024):
        between = np.arccos(np.clip(unit[at : at + 1024] @ centres.T, -1, 1))
        sure = between + radius <= angle - MARGIN
        total[at : at + 1024] = sure @ weight
        beside |= sure.any(axis=0)
        x, y = np.nonzero(~sure & (between - radius <= angle + MARGIN))
        out.append(_asked(classes[at + x], p, q[y], None, unit[at + x]))
    # balls it has links with, without a class; then the classes' sums, without a ball
    out.append(_asked(None, p, q[beside], None, None))
    out.append(_asked(classes[total > 0], p, None, total[total > 0], None))
    return pa.concat_tables(out)


def _asked(classes, p: int, q, found, vectors) -> pa.Table:
    n = max(len(c) for c in (classes, q) if c is not None)
    columns = [classes, np.full(n, p), q, found]
    return pa.table([
        *[pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns],
        pa.nulls(n, pa.list_(pa.float64())) if vectors is None else _lists(vectors, np.zeros(n, bool))], schema=ASKED)


FOUND = pa.schema([("class", pa.int64()), ("p", pa.int64()), ("q", pa.int64()), ("found", pa.int64())])


def against_members(questions: pa.Table, members: pa.Table, cosine: float) -> pa.Table:
    """How many vectors of one ball each questioner is linked with."""
    if not questions.num_rows or not members.num_rows:
        return FOUND.empty_table()
    ask, unit = _rows(questions.column("vector")), _rows(members.column("vector"))
    copies = members.column("copies").to_numpy()
    found = np.concatenate([(ask[a : a + 1024] @ unit.T >= cosine) @ copies for a in range(0, len(ask), 1024)])
    return questions.select(["class", "p", "q"]).append_column("found", pa.array(found)).cast(FOUND).filter(pa.array(found > 0))


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
    hot_rows: int = HOT_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per row of `rows`: its id, `n_links` to other vectors of at least this cosine, `component_id` and `kept`.

    Equal vectors become one class first, then classes of one neighbourhood that are linked
    with a leader become a ball, so a dense group is a few balls and not all its pairs. Balls
    that share a filter of any member meet; those near enough are settled by their centres
    where these decide, and member by member where not; only counts leave those comparisons.
    No pair below the threshold is linked. A pair at the very threshold shares no filter in
    about one case of a thousand (measured as the code is dealt), a nearer one far less often.

    Null, zero and non-finite vectors link with nothing: no links, their own id as component.
    Vectors of different dimensions do not link. A repeated row is a vector of its own. A null
    id counts as a vector and never is a component's least id. Other columns are not read.
    """
    spark = rows.sparkSession
    angle = float(np.arccos(cosine))
    usable = F.col("vector").isNotNull() & F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0), F.lit(False))
    taken = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    keyed = taken.select(
        "id", "vector", usable.alias("usable"), F.xxhash64(F.lit(1), "vector").alias("a"), F.xxhash64(F.lit(2), "vector").alias("b"))
    # a class by 128 bits of its vector; equal vectors are combined before the shuffle
    classes = keyed.where("usable").groupBy("a", "b").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()), "vectors-classes")
    total = classes.count()
    cells = max(1, total // 512)
    homes = classes.select("class", "copies", "vector").mapInArrow(
        lambda batches: homes_of(batches, cells, cosine, total), "class long, copies long, vector array<double>, home long")
    homes = cut(homes, "vectors-homes")
    crowded = homes.groupBy("home").count().where(F.col("count") > cell_rows).select(
        "home", F.ceil(F.col("count") / cell_rows).alias("salts"))
    dealt = homes.join(crowded, "home", "left").select(
        "class", "copies", "vector", "home", F.pmod(F.xxhash64("class"), F.coalesce("salts", F.lit(1))).alias("salt"))
    dealt = dealt.withColumn("cell", F.xxhash64("home", "salt"))
    members = cut(
        dealt.repartition("cell").sortWithinPartitions("cell", "home", "salt")
        .mapInArrow(lambda batches: balls_of(batches, cosine, total), MEMBER), "vectors-members")
    balls = members.where(F.col("weight").isNotNull())

    entries = balls.select(F.explode("filters").alias("filter"), "ball", "head", "scale", "rest", "radius")
    hot = entries.groupBy("filter").count().where(F.col("count") > hot_rows).select(
        "filter", F.ceil(F.col("count") / hot_rows).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    split = entries.join(hot, "filter", "left").withColumn("mine", F.pmod(F.xxhash64("ball"), parts).cast("int"))
    # a block of a crowded filter meets every block of it once
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "filter", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"),
        "mine", "ball", "head", "scale", "rest", "radius").withColumn("place", F.xxhash64("filter", "one", "two"))
    met = split.repartition("place").sortWithinPartitions("place", "filter", "one", "two").mapInArrow(
        lambda batches: meetings(batches, angle), "p long, q long").distinct()
    about = balls.select("ball", "centre", "radius", "members", "weight")
    both = met
    for side in ("p", "q"):
        both = both.join(about.select(F.col("ball").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in about.columns[1:]]), side)
    links = cut(
        both.select("p", "q", *[f"{c}_{s}" for c in about.columns[1:] for s in "pq"]).mapInArrow(
            lambda batches: settled(batches, cosine), "p long, q long, weight_p long, weight_q long, kind int"), "vectors-links")
    whole, partly = links.where(F.col("kind") == ALL), links.where(F.col("kind") == SOME)

    # a ball whose members are all linked with another's: its weight counts for each of them
    sums = whole.select(F.col("p").alias("ball"), F.col("weight_q").alias("w")).union(whole.select("q", "weight_p")).groupBy("ball").agg(
        F.sum("w").alias("beside"))
    ways = partly.select("p", "q").union(partly.select("q", "p"))
    facing = ways.join(about.select(F.col("ball").alias("q"), "centre", "radius", "weight"), "q")
    own = members.select("class", "ball", "copies", "vector")
    asked = cut(
        own.join(ways.select(F.col("p").alias("ball")).distinct(), "ball", "left_semi").groupBy("ball").cogroup(facing.groupBy("p"))
        .applyInArrow(lambda m, b: against_centres(m, b, cosine), "class long, p long, q long, found long, vector array<double>"),
        "vectors-asked")
    open_ones = asked.where("found is null and class is not null")
    answers = open_ones.groupBy("q").cogroup(
        own.join(open_ones.select(F.col("q").alias("ball")).distinct(), "ball", "left_semi").groupBy("ball")
    ).applyInArrow(lambda x, m: against_members(x, m, cosine), "class long, p long, q long, found long")
    known = asked.where("found is not null or class is null").select("class", "p", "q", "found")
    found = cut(known.union(answers), "vectors-found")

    edges = whole.select(F.col("p").alias("a"), F.col("q").alias("b")).union(
        found.where("q is not null").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    roots = components(edges, "vectors-components")
    per_class = found.where("class is not null").groupBy("class").agg(F.sum("found").alias("across"))
    counted = members.select("class", "ball", "inside").join(sums, "ball", "left").join(per_class, "class", "left").join(
        roots.withColumnRenamed("node", "ball"), "ball", "left"
    ).select(
        "class", F.coalesce("root", "ball").alias("root"),
        (F.col("inside") + F.coalesce("beside", F.lit(0)) + F.coalesce("across", F.lit(0))).alias("n_links"))
    named = cut(classes.select("class", "a", "b", "least").join(counted, "class"), "vectors-counted")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    result = named.join(least, "root").select("a", "b", "n_links", "component_id")
    return keyed.select("id", "a", "b", "usable").join(result.withColumn("usable", F.lit(True)), ["a", "b", "usable"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


SQL = """WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
links AS (
  SELECT a.r AS a, b.r AS b, b.vec_id FROM v AS a JOIN v AS b ON a.r <> b.r AND a.usable AND b.usable AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
least AS (SELECT reached.a, min(v.vec_id) AS component_id FROM reached JOIN v ON v.r = reached.b GROUP BY 1)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.r) AS n_links, component_id,
       coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN least ON least.a = v.r"""
