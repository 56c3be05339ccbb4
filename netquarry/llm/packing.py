"""Packing documents into fixed windows by minimum bin slack.

Each document's ids (and the end id) are cut into full windows and one remainder. Which remainders
share a window is decided on the *multiset of remaining lengths*, a histogram of fewer than
``window`` entries whatever the corpus: the longest length left opens a window, a subset-sum
dynamic program over bit sets finds the multiset of the other lengths that comes closest to the
capacity, the counts are backtracked from the stored bit sets, and the filling found is repeated as
often as the counts allow. Where even the best filling leaves slack, a piece of the longest length
left is cut to fill it, so at most the last window of the corpus is short.

A fill is applied to documents by rank: the i-th remainder of a length takes the i-th place made
for that length. Ranks come from counts per (written partition, length), so no length, however
common, is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.encoders import byte_level
from netquarry.llm.staging import stage

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int32()),
        ("part", pa.int32()),
        ("rank", pa.int64()),
        ("ids", pa.binary()),
    ]
)
PIECES_DDL = (
    "doc_id long, doc_tokens long, start long, length int, part int, rank long, ids binary"
)
PLACED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
PLACED_DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long"
)


@dataclass(frozen=True)
class Places:
    """Ranks ``[low, high)`` of the remainders of ``total`` ids, their part from ``inner`` on:
    ``length`` ids of the i-th go to window ``sequence + i // each`` at ``offset`` plus the place
    among the ``each`` equal ones, where i = rank - low + skip."""

    total: int
    inner: int
    low: int
    high: int
    length: int
    each: int
    sequence: int
    offset: int
    skip: int


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``capacity``; longer lengths first."""
    reach, mask, seen = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x]), reverse=True):
        left, times = min(counts[length], capacity // length), 1
        while left:
            times = min(times, left)
            seen.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach >> capacity & 1:
            break
    target, used = reach.bit_length() - 1, defaultdict(int)
    for length, times, before in reversed(seen):
        if not before >> target & 1:
            used[length] += times
            target -= length * times
    return dict(used)


def fill_windows(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[Places], int]:
    """Places for every remainder of every length, and the number of windows."""
    counts = {x: n for x, n in histogram.items() if n}
    stock: dict[int, deque] = {x: deque([(x, 0, 0, n)]) for x, n in counts.items()}
    places: list[Places] = []
    sequence = 0

    def take(length: int, each: int, times: int, offset: int, cut: int | None = None) -> None:
        """Use ``each`` parts of ``length`` in each of ``times`` windows; of a part that is cut,
        the first ``cut`` ids, and the rest goes back into the stock."""
        need, skip = each * times, 0
        while need:
            total, inner, low, high = stock[length].popleft()
            n = min(need, high - low)
            places.append(
                Places(total, inner, low, low + n, cut or length, each, sequence, offset, skip)
            )
            if low + n < high:
                stock[length].appendleft((total, inner, low + n, high))
            if cut:
                rest = length - cut
                stock.setdefault(rest, deque()).append((total, inner + cut, low, low + n))
                counts[rest] = counts.get(rest, 0) + n
            skip += n
            need -= n
        counts[length] -= each * times
        if not counts[length]:
            del counts[length]

    while counts:
        seed = max(counts)
        others = dict(counts)
        others[seed] -= 1
        fill = best_fill(others, window - seed)
        fill[seed] = fill.get(seed, 0) + 1
        slack = window - sum(length * n for length, n in fill.items())
        times = min(counts[length] // n for length, n in fill.items())
        longest = None
        if slack:
            longest = max((x for x in counts if counts[x] > fill.get(x, 0)), default=None)
        if longest is not None:
            times = min(
                counts[length] // (n + (length == longest)) for length, n in fill.items()
            )
            times = min(times, counts[longest] // (fill.get(longest, 0) + 1))
        elif slack:
            times = 1
        offset = 0
        for length in sorted(fill, reverse=True):
            take(length, fill[length], times, offset)
            offset += length * fill[length]
        if longest is not None:
            take(longest, 1, times, offset, cut=slack)
        sequence += times
    return places, sequence


def cut_documents(
    docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID
) -> DataFrame:
    """One row per full window of a document and one for its remainder, numbered within the
    written partition and length. ``ids`` are packed 16-bit ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = byte_level(vocabulary)
        part = TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in PIECES]
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 2
                for start in range(0, n, window):
                    piece = ids[2 * start : 2 * (start + window)]
                    length = len(piece) // 2
                    row = (doc_id, n, start, length, part, ranks[length], piece)
                    ranks[length] += 1
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(out, PIECES, strict=True)], schema=PIECES
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES_DDL)


def place_pieces(pieces: DataFrame, places: list[Places]) -> DataFrame:
    """Put each piece (with its global ``place`` among those of its length) where the fill says.
    ``places`` has a bounded size: it depends on the window, not on the corpus."""
    index: dict[tuple[int, int], list[Places]] = defaultdict(list)
    for p in places:
        index[p.total, p.inner].append(p)
    table = {}
    for key, found in index.items():
        found.sort(key=lambda p: p.low)
        table[key] = (np.array([p.low for p in found]), found)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in PLACED]
            for doc_id, n, start, length, place, ids in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                inner = 0
                while inner < length:
                    lows, found = table[length, inner]
                    p = found[int(np.searchsorted(lows, place, side="right")) - 1]
                    i = place - p.low + p.skip
                    piece = wide[inner : inner + p.length]
                    row = (
                        doc_id,
                        start + inner,
                        p.length,
                        zlib.crc32(piece.tobytes()),
                        n,
                        p.sequence + i // p.each,
                        p.offset + i % p.each * p.length,
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    inner += p.length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(out, PLACED, strict=True)], schema=PLACED
            )

    columns = ("doc_id", "doc_tokens", "start", "length", "place", "ids")
    return pieces.select(*columns).mapInArrow(put, PLACED_DDL)


def pack(
    docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: where its ids lie in the document and in which sequence they go.

    Every document has at least the end id, so an empty or null text gives one piece. Repeated
    rows are packed as often as they occur, and a null ``doc_id`` is kept. Extra columns are
    ignored. An empty table gives no rows."""
    pieces = stage(cut_documents(docs, window, vocabulary, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = stage(
        counts.select(
            "part", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
        ),
        "lengths",
    )
    # at most `window` rows, one per length
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    places, _ = fill_windows({r["length"]: r["n"] for r in histogram}, window)
    ranked = pieces.join(counts.select("part", "length", "before"), ["part", "length"])
    return place_pieces(ranked.withColumn("place", F.col("rank") + F.col("before")), places)
