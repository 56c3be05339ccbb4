"""Nearest neighbours through a few stable projections and a chi-square stopping test.

Vectors are projected on eight Gaussian directions, so the squared projected distance of two vectors
over their squared distance follows a chi-square law with eight degrees of freedom. A kd-tree over
a bounded sample of projections deals all vectors into leaves, and leaves into blocks.

A query takes neighbours in the order of their projected distances and verifies each on the
original vectors, until the test holds: a vector nearer than the tenth best found so far would,
with probability ``SURE``, have had a smaller projected distance than the next one. First every query
is answered in its own block, where it lies already; its tenth best distance then says which other
leaves can hold a neighbour that the test does not rule out, and only there the search goes on,
with the bound from home.

Blocks are read as a stream in the order of leaves: a task holds the blocks of one part of a
leaf and then passes the queries by. A leaf with a large share of the sample, such as one of
many equal vectors, is split into parts. Distances are sums of squared differences in double
precision.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without an id; vectors are compared with those of equal length; rows that repeat
id and vector are one; an id with several vectors is a candidate with each and has a list for each;
fewer than ten candidates are all returned; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.llm.staging import stage

NEAREST, QUERY_STEP = 10, 100
PROJECTIONS, SEED = 8, 20_240_811
#: The stopping test's confidence. A true neighbour is passed over with less than 1 - SURE.
SURE = 0.96
#: Rows the tree is fitted on, vectors meant for a leaf, a block, and a part of a leaf.
SAMPLE, LEAF, BLOCK, PART = 32_768, 4_096, 4_096, 65_536
MOST_LEAVES = 8_192
FIRST_STEP = 64

ROW = pa.schema(
    [("leaf", pa.int32()), ("part", pa.int32()), ("vec_id", pa.int64()), ("vec", pa.binary())]
)
ROW_DDL = "leaf int, part int, vec_id long, vec binary"
#: A block (query false: n vectors of one length) or a query (its own vector and bound).
MIXED = pa.schema(
    [("leaf", pa.int32()), ("part", pa.int32()), ("query", pa.bool_()), ("n", pa.int64()),
     ("ids", pa.binary()), ("vecs", pa.binary()), ("bound", pa.float64())]
)
MIXED_DDL = "leaf int, part int, query boolean, n long, ids binary, vecs binary, bound double"
FOUND = pa.schema(
    [("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()),
     ("score", pa.float64())]
)
FOUND_DDL = "query_id long, query_key long, vec_id long, score double"
HOME = pa.schema([*FOUND, ("leaf", pa.int32()), ("part", pa.int32()), ("vecs", pa.binary())])
HOME_DDL = FOUND_DDL + ", leaf int, part int, vecs binary"


def chi_square(x: float, degrees: int) -> float:
    """P(chi-square <= x) for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for k in range(degrees // 2):
        if k:
            term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def chi_square_at(p: float, degrees: int) -> float:
    """The x at which :func:`chi_square` is ``p``."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


def directions(size: int, count: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, size]).normal(size=(size, count))


@dataclass(frozen=True)
class Tree:
    """Inner nodes by number: an axis, a cut, and children (>= 0: a node, < 0: leaf -child - 1).
    ``low`` and ``high`` are the leaves' cells, ``parts`` how many parts each leaf has."""

    axis: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray

    def leaves(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        if not len(self.axis):
            return node
        going = np.arange(len(points))
        while len(going):
            at = node[going]
            down = points[going, self.axis[at]] <= self.cut[at]
            node[going] = np.where(down, self.below[at], self.above[at])
            going = going[node[going] >= 0]
        return -node - 1

    def within(self, point: np.ndarray, reach: float) -> np.ndarray:
        """Leaves whose cell lies within a squared distance."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero((gap * gap).sum(axis=1) <= reach)


def fitted(points: np.ndarray, total: int, leaf: int = LEAF, part: int = PART) -> Tree:
    """A kd-tree of about ``total / leaf`` leaves: each cut is the median on the widest axis."""
    wanted = min(max(1, total // leaf), MOST_LEAVES, max(1, len(points) // 4))
    least = max(1, len(points) // wanted)
    axis, cut, children = [], [], []
    low, high, parts = [], [], []

    def grow(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
        own = points[rows]
        spread = np.ptp(own, axis=0) if len(rows) else np.zeros(points.shape[1])
        k = int(np.argmax(spread))
        middle = float(np.median(own[:, k])) if len(rows) else 0.0
        down = own[:, k] <= middle
        if len(rows) < 2 * least or down.all():
            low.append(lo)
            high.append(hi)
            share = len(rows) / max(len(points), 1) * total
            parts.append(max(1, math.ceil(share / part)))
            return -len(low)
        number = len(axis)
        axis.append(k)
        cut.append(middle)
        children.append((0, 0))
        left, right = hi.copy(), lo.copy()
        left[k] = right[k] = middle
        children[number] = (grow(rows[down], lo, left), grow(rows[~down], right, hi))
        return number

    edge = np.full(points.shape[1], np.inf)
    grow(np.arange(len(points)), -edge, edge)
    links = np.array(children, dtype=np.int64).reshape(-1, 2)
    return Tree(
        np.array(axis, dtype=np.int64), np.array(cut), links[:, 0], links[:, 1],
        np.array(low), np.array(high), np.array(parts, dtype=np.int64),
    )


def usable(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows that take part, for each length."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(sizes) - sizes
    known = ~np.asarray(ids.is_null())
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero((sizes == size) & known)
        x = values[at[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield numbers[rows[good]], x[good]


def projections_of(table: DataFrame, seed: int, share: float) -> np.ndarray:
    """Projections of a random sample of rows; for the tree alone."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in usable(batch[0], batch[1]):
                points = (x @ directions(x.shape[1])).astype("<f8")
                cells = pa.array([p.tobytes() for p in points], pa.binary())
                yield pa.RecordBatch.from_arrays([cells], names=["point"])

    sample = table.sample(fraction=min(1.0, share), seed=seed)
    rows = sample.mapInArrow(project, "point binary").collect()
    return np.frombuffer(b"".join(bytes(r.point) for r in rows)).reshape(-1, PROJECTIONS)


def dealt(table: DataFrame, tree: Tree, kind: str) -> DataFrame:
    """leaf, part, vec_id, vec of all rows that take part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in usable(batch[0], batch[1]):
                leaf = tree.leaves(x @ directions(x.shape[1]))
                spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                part = spread % tree.parts[leaf].astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(leaf.astype(np.int32)),
                        pa.array(part.astype(np.int32)),
                        pa.array(ids),
                        pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()),
                    ],
                    schema=ROW,
                )

    return table.mapInArrow(deal, ROW_DDL)


def blocked(rows: DataFrame, block: int) -> DataFrame:
    """Rows of one part and length, without repeats, as blocks of vectors."""
    order = ["leaf", "part", F.length("vec"), "vec_id", "vec"]
    placed = rows.repartition("leaf", "part").sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vecs = None, [], []

        def out() -> pa.RecordBatch:
            row = [
                [key[0]], [key[1]], [False], [len(ids)],
                [np.array(ids, dtype="<i8").tobytes()], [b"".join(vecs)], [None],
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(row, MIXED, strict=True)], schema=MIXED
            )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for leaf, part, vec_id, vec in zip(*columns, strict=True):
                own = (leaf, part, len(vec))
                if own == key and ids[-1] == vec_id and vecs[-1] == vec:
                    continue
                if ids and (own != key or len(ids) == block):
                    # the last row stays in view, so that a repeat of it is seen
                    yield out()
                    ids, vecs = [], []
                key = own
                ids.append(vec_id)
                vecs.append(vec)
        if ids:
            yield out()

    return placed.mapInArrow(pack, MIXED_DDL)


class Block:
    def __init__(self, ids: bytes, vecs: bytes, kind: str):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.raw = np.frombuffer(vecs, dtype=kind).reshape(len(self.ids), -1)
        self.x = self.raw.astype(np.float64)
        self.points = self.x @ directions(self.x.shape[1])

    def nearest(
        self, query_id: int, q: np.ndarray, point: np.ndarray, bound: float, reach: float, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the ``k`` nearest here that are not beyond ``bound``, in steps over
        the neighbours in projected order until the test holds."""
        gap = self.points - point
        apart = np.einsum("ij,ij->i", gap, gap)
        # equal vectors project equally but for rounding
        slack = 1e-24 * float(point @ point)
        inside = np.flatnonzero(apart <= reach * bound * bound + slack) if bound < np.inf else None
        if inside is None:
            order = np.argsort(apart, kind="stable")
        else:
            order = inside[np.argsort(apart[inside], kind="stable")]
        apart = apart[order]
        best_ids = np.zeros(0, dtype=np.int64)
        best = np.zeros(0)
        at, step = 0, FIRST_STEP
        while at < len(order):
            limit = reach * bound * bound + slack
            if apart[at] > limit:
                break
            until = min(at + step, int(np.searchsorted(apart, limit, side="right")))
            rows = order[at:until]
            at, step = until, step * 2
            diff = self.x[rows] - q
            score = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            own = (self.ids[rows] == query_id) & (diff == 0).all(axis=1)
            good = ~own & (score <= bound)
            best_ids = np.append(best_ids, self.ids[rows[good]])
            best = np.append(best, score[good])
            if len(best) > k:
                first = np.lexsort((best_ids, best))[:k]
                best_ids, best = best_ids[first], best[first]
            if len(best) == k:
                bound = min(bound, float(best.max()))
        return best_ids, best


def key_of(vec: bytes) -> int:
    return xxhash.xxh64_intdigest(vec) - (1 << 63)


def at_home(blocks: DataFrame, kind: str, step: int, k: int, reach: float) -> DataFrame:
    """What each query finds in its own block. A query that finds nothing has one row with no
    vec_id, so that it is searched for elsewhere."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for leaf, part, _, _, ids, vecs, _ in zip(*columns, strict=True):
                block = Block(ids, vecs, kind)
                for row in np.flatnonzero(block.ids % step == 0):
                    query_id, vec = int(block.ids[row]), block.raw[row].tobytes()
                    near, score = block.nearest(
                        query_id, block.x[row], block.points[row], math.inf, reach, k
                    )
                    n = max(len(near), 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([query_id] * n, pa.int64()),
                            pa.array([key_of(vec)] * n, pa.int64()),
                            pa.array(near if len(near) else [None], pa.int64()),
                            pa.array(score if len(near) else [None], pa.float64()),
                            pa.array([leaf] * n, pa.int32()),
                            pa.array([part] * n, pa.int32()),
                            pa.array([vec] + [None] * (n - 1), pa.binary()),
                        ],
                        schema=HOME,
                    )

    return blocks.mapInArrow(search, HOME_DDL)


def outward(home: DataFrame, tree: Tree, kind: str, k: int, reach: float) -> DataFrame:
    """Each query once for every part of every leaf that the test leaves open, with its bound. Its
    own block is gone through again with that bound, which is quick."""
    queries = home.groupBy("query_id", "query_key").agg(
        F.first("vecs", ignorenulls=True).alias("vecs"),
        F.when(F.count("vec_id") >= k, F.max("score")).alias("bound"),
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for query_id, _, vec, bound in zip(*columns, strict=True):
                q = np.frombuffer(vec, dtype=kind).astype(np.float64)
                point = q @ directions(len(q))
                limit = math.inf if bound is None else bound
                slack = 1e-24 * float(point @ point)
                open_ = tree.within(point, reach * limit * limit + slack)
                leaf = np.repeat(open_, tree.parts[open_])
                ends = np.cumsum(tree.parts[open_])
                part = np.arange(len(leaf)) - np.repeat(ends - tree.parts[open_], tree.parts[open_])
                n = len(leaf)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(leaf.astype(np.int32)),
                        pa.array(part.astype(np.int32)),
                        pa.array([True] * n),
                        pa.array([query_id] * n, pa.int64()),
                        pa.array([None] * n, pa.binary()),
                        pa.array([vec] * n, pa.binary()),
                        pa.array([limit] * n, pa.float64()),
                    ],
                    schema=MIXED,
                )

    return queries.mapInArrow(send, MIXED_DDL)


def verified(mixed: DataFrame, kind: str, k: int, reach: float) -> DataFrame:
    """The nearest of each part for the queries that come by."""
    placed = mixed.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "query")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for leaf, part, query, n, ids, vecs, bound in zip(*columns, strict=True):
                if (leaf, part) != key:
                    key, blocks = (leaf, part), []
                if not query:
                    blocks.append(Block(ids, vecs, kind))
                    continue
                q = np.frombuffer(vecs, dtype=kind).astype(np.float64)
                point = q @ directions(len(q))
                for block in blocks:
                    if block.x.shape[1] == len(q):
                        near, score = block.nearest(n, q, point, bound, reach, k)
                        out.append((n, key_of(vecs), near, score))
            for query_id, query_key, near, score in out:
                if len(near):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([query_id] * len(near), pa.int64()),
                            pa.array([query_key] * len(near), pa.int64()),
                            pa.array(near),
                            pa.array(score),
                        ],
                        schema=FOUND,
                    )

    return placed.mapInArrow(search, FOUND_DDL)


def neighbours(
    table: DataFrame,
    k: int = NEAREST,
    step: int = QUERY_STEP,
    sure: float = SURE,
    leaf: int = LEAF,
    block: int = BLOCK,
    part: int = PART,
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for each row whose id ``step``
    divides, over all rows."""
    single = isinstance(table.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding") if single else F.col("embedding").cast("array<double>"),
    )
    total = rows.count()
    reach = chi_square_at(sure, PROJECTIONS)
    tree = fitted(projections_of(rows, SEED, SAMPLE / max(total, 1)), total, leaf, part)
    blocks = stage(blocked(dealt(rows, tree, kind), block), "projected-blocks")
    home = stage(at_home(blocks, kind, step, k, reach), "projected-home")
    away = verified(blocks.unionByName(outward(home, tree, kind, k, reach)), kind, k, reach)
    found = home.filter("vec_id is not null").select(*FOUND.names).unionByName(away)
    # what a query found at home comes by again: one of each
    once = found.groupBy(*FOUND.names).agg(F.lit(1).alias("one")).drop("one")
    order = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return (
        once.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
