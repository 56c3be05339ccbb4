"""Near-duplicate vectors by NN-descent: a neighbour graph refined by its own neighbours.

Equal vectors are one vertex. Every vertex keeps a list of its nearest vertices, seeded from
neighbours in the order of random sign codes. In a round, the vertices that share a neighbour are
introduced to each other: each centre gathers those that list it and those it lists, compares
them, and sends each the ones that beat the worst on its list. A list whose entries all pass
the threshold is full and doubles. When little changes, a bounded set of audit vectors is
compared with every vector; while too many of their links are missed, the graph is seeded again from
new codes and refined further.

Links within the threshold make components. What a vertex links with is then counted exactly, in
double precision, over all members of its component in tiles, so lists that stayed full lose
nothing, and pairs are never spelled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.components import components
from netquarry.llm.simhash_gray import runs, whole_groups
from netquarry.llm.staging import stage

THRESHOLD = 0.98
#: The rounds compare 16-bit floats; candidates this far below the threshold are verified.
MARGIN = 0.005
LIST, LONGEST = 10, 80
TABLES, BITS, BESIDE = 4, 20, 5
ROUNDS, SETTLED = 4, 0.01
CROWD = 64
INTRODUCED = 8
AUDIT, LEAST_RECALL, SEEDINGS = 512, 0.98, 4
TILE = 512

VERTEX_DDL = "id long, label int, unit binary, n long"
CODED = pa.schema(
    [("pass", pa.int32()), ("label", pa.int32()), ("code", pa.int64()), ("id", pa.int64()),
     ("half", pa.binary())]
)
CODED_DDL = "pass int, label int, code long, id long, half binary"
LISTS = pa.schema(
    [("id", pa.int64()), ("half", pa.binary()), ("ids", pa.binary()), ("sims", pa.binary()),
     ("size", pa.int32()), ("worst", pa.float32()), ("changed", pa.int32())]
)
LISTS_DDL = (
    "id long, half binary, ids binary, sims binary, size int, worst float, changed int"
)
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, label, unit (little-endian doubles; null where the vector links with nothing)."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("unit", pa.binary())])

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = []
            for label, v in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
                units.append(None if label is None else unit_of(v))
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[1], pa.array(units, pa.binary())], schema=schema
            )

    rows = table.select(
        F.col("vec_id").cast("long"), F.col("label").cast("int"),
        F.col("embedding").cast("array<double>"),
    )
    return rows.mapInArrow(normalise, "vec_id long, label int, unit binary")


def unit_of(v: list | None) -> bytes | None:
    if not v or any(x is None for x in v):
        return None
    x = np.array(v, dtype=np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return (x / np.sqrt(x @ x)).astype("<f8").tobytes()


def matrix(cells, dtype: str) -> np.ndarray:
    cells = list(cells)
    return np.frombuffer(b"".join(cells), dtype=dtype).reshape(len(cells), -1)


def equal_sizes(units: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the rows of each vector length."""
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    for s in np.unique(sizes):
        yield np.flatnonzero(sizes == s)


def coded(vertices: DataFrame, seed: int) -> DataFrame:
    """Each vertex once per table, with a code of the signs of random projections."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch[0].to_numpy(), batch[1].to_numpy()
            units = batch[2].to_numpy(zero_copy_only=False)
            for rows in equal_sizes(units):
                x = matrix(units[rows], "<f8")
                half = [h.tobytes() for h in x.astype("<f2")]
                rng = np.random.default_rng([seed, x.shape[1]])
                for table in range(TABLES):
                    planes = rng.normal(size=(x.shape[1], BITS))
                    code = ((x @ planes) > 0) @ (1 << np.arange(BITS)[::-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), table, dtype=np.int32)),
                            pa.array(labels[rows].astype(np.int32)),
                            pa.array(code.astype(np.int64)),
                            pa.array(ids[rows]),
                            pa.array(half, pa.binary()),
                        ],
                        schema=CODED,
                    )

    return vertices.select("id", "label", "unit").mapInArrow(project, CODED_DDL)


def seeds(vertices: DataFrame, seed: int) -> DataFrame:
    """Lists of the vertices beside each one in the order of its codes."""
    order = ["pass", "label", "code", "id"]
    placed = coded(vertices, seed).repartitionByRange(*order).sortWithinPartitions(*order)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tables, labels = batch[0].to_numpy(), batch[1].to_numpy()
            ids, halves = batch[3].to_numpy(), batch[4].to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for rows in equal_sizes(halves):
                x = matrix(halves[rows], "<f2").astype(np.float32)
                n = len(rows)
                near = np.zeros((n, 2 * BESIDE), dtype=np.int64)
                sims = np.full((n, 2 * BESIDE), -2, dtype=np.float32)
                for d in range(1, min(BESIDE, n - 1) + 1):
                    same = (labels[rows][d:] == labels[rows][:-d]) & (
                        tables[rows][d:] == tables[rows][:-d]
                    )
                    s = np.where(same, np.einsum("ij,ij->i", x[d:], x[:-d]), np.float32(-2))
                    near[d:, d - 1], sims[d:, d - 1] = ids[rows][:-d], s
                    near[:-d, BESIDE + d - 1], sims[:-d, BESIDE + d - 1] = ids[rows][d:], s
                for i, row in enumerate(rows.tolist()):
                    keep = sims[i] > -2
                    out.append(
                        (ids[row], halves[row], near[i][keep].tobytes(), sims[i][keep].tobytes())
                    )
            yield list_batch(out)

    return placed.mapInArrow(beside, LISTS_DDL)


def list_batch(rows: list[tuple], sizes=None, worsts=None, changed=None) -> pa.RecordBatch:
    n = len(rows)
    zeros = np.zeros(n, dtype=np.int32)
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(columns[0], pa.int64()),
            pa.array(columns[1], pa.binary()),
            pa.array(columns[2], pa.binary()),
            pa.array(columns[3], pa.binary()),
            pa.array(zeros if sizes is None else sizes, pa.int32()),
            pa.array(zeros if worsts is None else worsts, pa.float32()),
            pa.array(zeros if changed is None else changed, pa.int32()),
        ],
        schema=LISTS,
    )


def merged(lists: DataFrame, name: str) -> DataFrame:
    """One list per vertex: the best of all its rows. A full list of passing entries doubles."""
    columns = ("id", "half", "ids", "sims", "size", "worst", "changed")
    placed = lists.select(*columns).repartition("id").sortWithinPartitions("id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, 1):
            own, halves, ids, sims, sizes = held[:5]
            bounds = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
            rows, new_sizes, worsts, changes = [], [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                half = next((h for h in halves[a:b] if h is not None), None)
                if half is None:
                    continue  # an introduction to a vertex of another seeding
                size = int(max(sizes[a:b].max(), LIST))
                near = np.frombuffer(b"".join(ids[a:b]), dtype=np.int64)
                close = np.frombuffer(b"".join(sims[a:b]), dtype=np.float32)
                before = ids[a + int(sizes[a:b].argmax())] if sizes[a:b].max() else b""
                other = near != own[a]
                near, close = near[other], close[other]
                order = np.lexsort((near, -close))
                near, close = near[order], close[order]
                _, first = np.unique(near, return_index=True)
                first.sort()
                near, close = near[first], close[first]
                while (
                    size < LONGEST and len(near) >= size and close[size - 1] >= THRESHOLD - MARGIN
                ):
                    size *= 2
                near, close = near[:size], close[:size]
                rows.append((own[a], half, near.tobytes(), close.tobytes()))
                new_sizes.append(size)
                worsts.append(close[-1] if len(close) >= size else -2.0)
                changes.append(
                    int((~np.isin(near, np.frombuffer(before, dtype=np.int64))).sum())
                )
            yield list_batch(rows, new_sizes, worsts, changes)

    return stage(placed.mapInArrow(merge, LISTS_DDL), name)


def introductions(graph: DataFrame, turn: int) -> DataFrame:
    """What each vertex hears from the centres it shares with others."""
    ends = pa.schema([("member", pa.int64()), ("centre", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch[1].to_pylist()
            other = np.frombuffer(b"".join(near), dtype=np.int64)
            own = np.repeat(batch[0].to_numpy(), [len(x) // 8 for x in near])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[other, own]), pa.array(np.r_[own, other])], schema=ends
            )

    met = graph.select("id", "ids").mapInArrow(spread, "member long, centre long")
    met = stage(met.distinct(), "nn-meetings")
    crowded = (
        met.groupBy("centre").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
        .select("centre", F.ceil(F.col("n") / CROWD).alias("parts"))
    )
    part = F.pmod(F.xxhash64("member", F.lit(turn)), F.coalesce("parts", F.lit(1)))
    placed = (
        met.join(crowded, "centre", "left")
        .select("centre", part.alias("part"), F.col("member").alias("id"))
        .join(graph.select("id", "half", "worst"), "id")
        .select("centre", "part", "id", "half", "worst")
        .repartition("centre", "part")
        .sortWithinPartitions("centre", "part")
    )

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for centre, part, ids, halves, worst in whole_groups(batches, 2):
            out: list[tuple] = []
            for a, b in runs([centre, part]):
                for rows in equal_sizes(halves[a:b]):
                    rows = rows + a
                    x = matrix(halves[rows], "<f2").astype(np.float32)
                    sims = x @ x.T
                    np.fill_diagonal(sims, -3)
                    top = min(INTRODUCED, len(rows) - 1)
                    if top < 1:
                        continue
                    best = np.argpartition(-sims, top - 1, axis=1)[:, :top]
                    close = np.take_along_axis(sims, best, axis=1)
                    fresh = close > worst[rows][:, None]
                    known = ids[rows]
                    for i in np.flatnonzero(fresh.any(axis=1)).tolist():
                        keep = fresh[i]
                        out.append(
                            (
                                known[i], None, known[best[i][keep]].tobytes(),
                                close[i][keep].tobytes(),
                            )
                        )
            yield list_batch(out)

    return placed.mapInArrow(introduce, LISTS_DDL)


def refined(vertices: DataFrame, seed: int, before: DataFrame | None) -> DataFrame:
    """The neighbour lists after seeding and rounds of introductions."""
    start = seeds(vertices, seed)
    graph = merged(start if before is None else start.union(before), "nn-lists")
    for turn in range(ROUNDS):
        graph = merged(graph.union(introductions(graph, turn)), "nn-lists")
        done = graph.agg(
            F.sum("changed").alias("changed"), F.count("*").alias("n")
        ).first()
        if (done["changed"] or 0) <= SETTLED * LIST * done["n"]:
            break
    return graph


def verified_links(graph: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """a, b: listed pairs that pass in double precision."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch[1].to_pylist()
            other = np.frombuffer(b"".join(near), dtype=np.int64)
            close = np.frombuffer(b"".join(batch[2].to_pylist()), dtype=np.float32)
            own = np.repeat(batch[0].to_numpy(), [len(x) // 8 for x in near])
            keep = close >= threshold - MARGIN
            a, b = np.minimum(own, other)[keep], np.maximum(own, other)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=PAIRS)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch[2].to_numpy(zero_copy_only=False)
            y = batch[3].to_numpy(zero_copy_only=False)
            keep = np.zeros(len(x), dtype=bool)
            for rows in equal_sizes(x):
                keep[rows] = (
                    np.einsum("ij,ij->i", matrix(x[rows], "<f8"), matrix(y[rows], "<f8"))
                    >= threshold
                )
            yield pa.RecordBatch.from_arrays(
                [batch[0].filter(pa.array(keep)), batch[1].filter(pa.array(keep))], schema=PAIRS
            )

    pairs = graph.select("id", "ids", "sims").mapInArrow(candidates, "a long, b long").distinct()
    left = vertices.select(F.col("id").alias("a"), F.col("unit").alias("x"))
    right = vertices.select(F.col("id").alias("b"), F.col("unit").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stage(joined.mapInArrow(verify, "a long, b long"), "nn-links")


def audit(vertices: DataFrame, threshold: float) -> DataFrame:
    """a, b: all links of a bounded set of vertices, from comparing them with every vertex."""
    asked = (
        vertices.orderBy(F.xxhash64("id")).limit(AUDIT).select("id", "label", "unit").collect()
    )
    queries: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r["label"], len(r["unit"])) for r in asked}:
        own = [r for r in asked if (r["label"], len(r["unit"])) == key]
        queries[key] = (
            np.array([r["id"] for r in own], dtype=np.int64),
            matrix([bytes(r["unit"]) for r in own], "<f8"),
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch[0].to_numpy(), batch[1].to_numpy()
            units = batch[2].to_numpy(zero_copy_only=False)
            out_a, out_b = [ids[:0]], [ids[:0]]
            for (label, size), (names, x) in queries.items():
                rows = np.flatnonzero(labels == label)
                rows = rows[[len(units[r]) == size for r in rows]] if len(rows) else rows
                if not len(rows):
                    continue
                q, v = np.nonzero(x @ matrix(units[rows], "<f8").T >= threshold)
                out_a.append(names[q])
                out_b.append(ids[rows[v]])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            keep = a != b
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[keep]), pa.array(b[keep])], schema=PAIRS
            )

    return stage(
        vertices.select("id", "label", "unit").mapInArrow(compare, "a long, b long"), "nn-audit"
    )


def recall(links: DataFrame, groups: DataFrame) -> float:
    """The share of the audited links whose ends are in one component; the lower one of that over
    all links and the mean over audit vectors, where a small group counts like a dense one."""
    of = groups.select(F.col("id"), F.col("component"))
    row = (
        links.join(of.toDF("a", "x"), "a", "left")
        .join(of.toDF("b", "y"), "b", "left")
        .groupBy("a")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("hit"),
        )
        .agg(
            F.least(F.sum("hit") / F.sum("n"), F.avg(F.col("hit") / F.col("n"))).alias("share")
        )
        .first()
    )
    return 1.0 if row["share"] is None else row["share"]


def counted(vertices: DataFrame, groups: DataFrame, threshold: float, tile: int) -> DataFrame:
    """id, links: for each vertex of a component the number of vectors (copies included) of other
    vertices in it that pass, compared tile by tile."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    own = F.pmod(F.xxhash64("id"), F.col("tiles"))
    dealt = (
        groups.join(sizes, "component")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .select(
            "component",
            F.least("own", "other").alias("one"),
            F.greatest("own", "other").alias("two"),
            F.when(F.col("own") == F.col("other"), 0)
            .when(F.col("own") < F.col("other"), 1)
            .otherwise(2)
            .alias("side"),
            "id",
        )
        .join(vertices.select("id", "unit", "n"), "id")
        .select("component", "one", "two", "side", "id", "n", "unit")
        .repartition("component", "one", "two")
        .sortWithinPartitions("component", "one", "two")
    )
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, 3):
            side, ids, n, units = held[3:]
            out_id, out_n = [ids[:0]], [n[:0]]
            for a, b in runs(held[:3]):
                x, at, copies = matrix(units[a:b], "<f8"), ids[a:b], n[a:b]
                sides = side[a:b]
                if sides[0] == 0:
                    close = x @ x.T >= threshold
                    np.fill_diagonal(close, False)
                    out_id.append(at)
                    out_n.append(close @ copies)
                    continue
                one, two = np.flatnonzero(sides == 1), np.flatnonzero(sides == 2)
                close = x[one] @ x[two].T >= threshold
                out_id += [at[one], at[two]]
                out_n += [close @ copies[two], close.T @ copies[one]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_n))],
                schema=schema,
            )

    return (
        dealt.mapInArrow(count, "id long, links long")
        .groupBy("id")
        .agg(F.sum("links").alias("links"))
    )


def near_vectors(
    table: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, seedings: int = SEEDINGS
) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``table``.

    Vectors are compared only within a label and a length. Null vectors, zero vectors and vectors
    with null or non-finite components, and all without a label, link with nothing. Repeated rows
    are vectors that link with each other. A vector with a null vec_id links like any other, but is
    nobody's component id; null where no other is reachable. Extra columns are ignored. Links are
    found by search: the recall is audited, and below ``LEAST_RECALL`` after all seedings it raises
    rather than returning what it found."""
    rows = stage(vectors(table), "vectors")
    # vertices without an id are numbered above all ids, so that they never name a component
    top = rows.agg(F.max("vec_id")).first()[0] or 0
    key = [F.xxhash64("unit").alias("k1"), F.xxhash64("unit", F.lit(1)).alias("k2")]
    marked = rows.select("vec_id", "label", "unit", *key)
    vertices = stage(
        marked.filter(F.col("unit").isNotNull())
        .groupBy("label", "k1", "k2")
        .agg(
            F.min("vec_id").alias("id"), F.first("unit").alias("unit"), F.count("*").alias("n")
        )
        .withColumn("id", F.coalesce("id", F.lit(top + 1) + F.monotonically_increasing_id())),
        "vertices",
    )
    truth = audit(vertices, threshold)
    graph = None
    for seed in range(seedings):
        graph = refined(vertices, seed, graph)
        links = verified_links(graph, vertices, threshold)
        groups = stage(components(links), "nn-groups")
        share = recall(truth, groups)
        if share >= LEAST_RECALL:
            break
    else:
        raise RuntimeError(f"audited recall is {share:.4f} after {seedings} seedings")
    counts = counted(vertices, groups, threshold, tile)
    of_vertex = stage(
        vertices.select("label", "k1", "k2", "id", "n")
        .join(groups, "id", "left")
        .join(counts, "id", "left")
        .select(
            "label", "k1", "k2",
            F.coalesce("component", "id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        ),
        "nn-result",
    )
    component = F.coalesce("component_id", "vec_id")
    return marked.join(of_vertex, ["label", "k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component <= top, component).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias(
            "kept"
        ),
    )
