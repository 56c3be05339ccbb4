"""Near-duplicate documents by SimHash, searched with a Gray-order hierarchical index.

Fingerprints sorted by their rank in the Gray code lie beside others that differ in few bits. The
index groups them in that order: each node keeps the bits that all its fingerprints share (a mask
and a pattern), and hands down only the bits that its parent does not already fix. A search adds
up the differences on the way down and drops a whole group as soon as they pass the radius.

The fingerprints are dealt to tasks by shared bits: cut into ``radius + c`` blocks, two
fingerprints within the radius agree on ``c`` of them at least, so they meet in one of the
groups formed by every choice of ``c`` blocks. ``c`` grows with the number of fingerprints. A group
with more than ``TILE`` fingerprints is cut into tiles, and each pair of tiles is searched by
itself. A group reports its components as stars, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.components import components
from netquarry.llm.staging import stage

WORDS = 4
RADIUS = 4
SEED = 42
TILE = 2048
GROUP = 64
LEAF, FAN = 16, 8
LANES = np.uint64(0x0101010101010101)
BLOCK = 255
FLUSH = 200_000


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of the text, A-Z in lower case; of all words if there are fewer."""
    found = text.encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends, end = [], -1
    for w in found:
        end += len(w) + 1
        ends.append(end)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [
        digest(joined[a:b], seed)
        for a, b in zip(starts, ends[words - 1 :], strict=False)
    ]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The SimHash of each list. Bits are counted eight at a time in the bytes of 64-bit words, in
    blocks short enough for a byte."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    padded = np.zeros(int(blocks.sum()) * BLOCK, dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    for h, at in zip(hashes, (first * BLOCK).tolist(), strict=True):
        padded[at : at + len(h)] = h
    table = padded.reshape(-1, BLOCK)
    out = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(8):
        lanes = ((table >> np.uint64(k)) & LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(counts, first, axis=0)
        bits = (2 * counts > sizes[:, None]).astype(np.uint64)
        for j in range(8):
            out |= bits[:, j] << np.uint64(8 * j + k)
    return out


def fingerprints(docs: DataFrame, **carried: Column) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number), and the ``carried`` longs. No word: zero."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *carried)])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, waiting, n = [np.zeros(0, dtype=np.uint64)], [], 0
            for text in batch[1].to_pylist():
                waiting.append(shingle_hashes(text or ""))
                n += len(waiting[-1])
                if n >= FLUSH:
                    found.append(majority(waiting))
                    waiting, n = [], 0
            if waiting:
                found.append(majority(waiting))
            values = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(values), *batch.columns[2:]], schema=schema
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        *(c.alias(name) for name, c in carried.items()),
    )
    return rows.mapInArrow(mark, ", ".join(f"{c} long" for c in schema.names))


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order: each bit becomes the parity of the bits above it."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


class GrayIndex:
    """Codes in Gray order under levels of shared masked patterns, bottom level first."""

    def __init__(self, codes: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.codes, self.leaf, self.fan = codes, leaf, fan
        levels = []
        ones, some = codes, codes
        size = leaf
        while True:
            starts = np.arange(0, len(ones), size)
            ones = np.bitwise_and.reduceat(ones, starts)
            some = np.bitwise_or.reduceat(some, starts)
            levels.append((ones, ~(ones ^ some)))
            if len(ones) <= fan:
                break
            size = fan
        self.levels = []
        for depth, (pattern, mask) in enumerate(levels):
            if depth + 1 < len(levels):  # what the parent does not fix already
                above = levels[depth + 1][1][np.arange(len(mask)) // fan]
                self.levels.append((pattern, mask & ~above))
            else:
                self.levels.append((pattern, mask))
        self.shared = levels[0][1]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, code number) of all pairs within the radius."""
        pattern, mask = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        total = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
        keep = total <= radius
        q, node, total = q[keep], node[keep], total[keep]
        for depth in range(len(self.levels) - 2, -1, -1):
            pattern, mask = self.levels[depth]
            q, node, total = self._descend(q, node, total, self.fan, len(pattern))
            total = total + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            keep = total <= radius
            q, node, total = q[keep], node[keep], total[keep]
        leaf = node
        q, node, total, leaf = self._descend(
            q, node, total, self.leaf, len(self.codes), leaf
        )
        total = total + np.bitwise_count((queries[q] ^ self.codes[node]) & ~self.shared[leaf])
        keep = total <= radius
        return q[keep], node[keep]

    @staticmethod
    def _descend(q, node, total, fan, size, extra=None):
        child = (node[:, None] * fan + np.arange(fan)).ravel()
        keep = child < size
        spread = [np.repeat(x, fan)[keep] for x in (q, total)]
        out = (spread[0], child[keep], spread[1])
        return out if extra is None else (*out, np.repeat(extra, fan)[keep])


def linked(left: np.ndarray, right: np.ndarray | None, radius: int):
    """(left number, right number) of the pairs within the radius; without ``right``, of left with
    itself, smaller number first."""
    codes = left if right is None else right
    if len(codes) <= GROUP:
        close = np.bitwise_count(left[:, None] ^ codes[None, :]) <= radius
        if right is None:
            close = np.triu(close, 1)
        yield np.nonzero(close)
        return
    index = GrayIndex(codes)
    for at in range(0, len(left), 512):
        q, c = index.search(left[at : at + 512], radius)
        q = q + at
        if right is None:
            q, c = q[q < c], c[q < c]
        yield q, c


def stars(size: int, links) -> np.ndarray:
    """For each of ``size`` members the smallest member it is connected with."""
    label = np.arange(size)
    links = [(a, b) for a, b in links if len(a)]
    changed = bool(links)
    while changed:
        before = label.copy()
        for a, b in links:
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
        label = label[label]
        changed = not np.array_equal(before, label)
    return label


def group_links(
    codes: np.ndarray, ids: np.ndarray, sides: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Star links (id, id) of one group. ``sides``: 0 for a group by itself, else 1 and 2 for the
    two tiles to hold against each other."""
    if sides[0] == 0:
        label = stars(len(codes), linked(codes, None, radius))
    else:
        one, two = np.flatnonzero(sides == 1), np.flatnonzero(sides == 2)
        if not len(one) or not len(two):
            return ids[:0], ids[:0]
        found = ((one[a], two[b]) for a, b in linked(codes[one], codes[two], radius))
        label = stars(len(codes), found)
    moved = label != np.arange(len(codes))
    return ids[moved], ids[label[moved]]


def agreeing(n: int, radius: int) -> list[int]:
    """Masks of the blocks that two codes within the radius agree on, one for each choice."""
    c = 1
    while c < 4 and n >> (64 * c // (radius + c)) > GROUP:
        c += 1
    blocks = radius + c
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(each, c)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(codes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b (ids) from distinct ``fp`` with an ``id``: links whose components are those of all
    pairs within the radius. ``codes`` should be stored: it is read a few times."""
    masks = agreeing(codes.count(), radius)
    spread = codes.filter(F.col("id").isNotNull()).select(
        "fp",
        "id",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(i).alias("choice"),
                        F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits"),
                    )
                    for i, m in enumerate(masks)
                )
            )
        ).alias("g"),
    ).select("fp", "id", "g.choice", "g.bits")
    crowded = (
        spread.groupBy("choice", "bits")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > tile)
        .select("choice", "bits", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    )
    dealt = spread.join(crowded, ["choice", "bits"], "left").withColumn(
        "tiles", F.coalesce("tiles", F.lit(1))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        dealt.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "choice",
            "bits",
            F.least("own", "other").alias("one"),
            F.greatest("own", "other").alias("two"),
            F.when(F.col("own") == F.col("other"), 0)
            .when(F.col("own") < F.col("other"), 1)
            .otherwise(2)
            .alias("side"),
            "fp",
            "id",
        )
    )
    key = ["choice", "bits", "one", "two"]
    placed = dealt.repartition(*key).sortWithinPartitions(*key, gray_rank(F.col("fp")))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches, 4):
            side, fp, ids = columns[4], columns[5].view(np.uint64), columns[6]
            out_a, out_b = [ids[:0]], [ids[:0]]
            for a, b in runs(columns[:4]):
                x, y = group_links(fp[a:b], ids[a:b], side[a:b], radius)
                out_a.append(x)
                out_b.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))],
                schema=schema,
            )

    return placed.mapInArrow(search, "a long, b long")


def runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of two or more equal keys."""
    size = len(keys[0])
    change = np.zeros(size + 1, dtype=bool)
    change[0] = change[size] = True
    for k in keys:
        change[1:size] |= k[1:] != k[:-1]
    bounds = np.flatnonzero(change)
    long = np.flatnonzero(np.diff(bounds) > 1)
    for a, b in zip(bounds[long].tolist(), bounds[long + 1].tolist(), strict=True):
        yield a, b


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Sorted batches as arrays, cut so that no group of equal keys is split."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(p) for p in zip(held, columns, strict=True)]
        differs = np.zeros(len(columns[0]), dtype=bool)
        for k in columns[:n_keys]:
            differs |= k != k[-1]
        last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        held = [c[last:] for c in columns]
        if last:
            yield [c[:last] for c in columns]
    if held is not None:
        yield held


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of
    ``radius`` differing bits or fewer), one row per row of ``docs``.

    Null and empty texts and texts without a word have fingerprint zero and link like any other.
    Repeated rows share a component. A null doc_id is kept; it never names a component where
    another row has the fingerprint, else its component is null. Extra columns are ignored."""
    marked = stage(fingerprints(docs), "fingerprints")
    codes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "codes")
    groups = components(fingerprint_links(codes, radius))
    of_code = codes.join(groups, "id", "left").select(
        "fp", F.coalesce("component", "id").alias("component_id")
    )
    return marked.join(of_code, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest doc_id and, among
    equal ones, of the smallest hash of the text. A row is known by id and text: different texts
    that share an id, or have none, are told apart and each stays unless it is a near copy. Rows
    without an id come last in a group. Of repeated rows one stays. Columns and their names are
    free."""
    k1, k2 = F.xxhash64("text"), F.xxhash64("text", F.lit(1))
    marked = stage(fingerprints(docs, k1=k1, k2=k2), "fingerprints")
    codes = stage(marked.select("fp", F.col("fp").alias("id")).distinct(), "codes")
    groups = components(fingerprint_links(codes, radius)).withColumnRenamed("id", "fp")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    kept = (
        marked.join(groups, "fp", "left")
        .groupBy(F.coalesce("component", "fp").alias("group"))
        .agg(F.min(order).alias("first"))
        .select("first.*")
    )
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        k1.alias("k1"),
        k2.alias("k2"),
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (rows["k1"] == kept["k1"]) & (rows["k2"] == kept["k2"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "k1", "k2"]).select("row.*")
