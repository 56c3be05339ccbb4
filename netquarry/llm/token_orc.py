"""Token ids in ORC files, in document order, and the way back.

Documents are range-partitioned and sorted by ``doc_id`` before they are encoded, so a file holds
a run of documents and files follow each other in order. ORC stores the ids with its integer
run-length encoding in stripes that can be read in parallel, keeps minimum and maximum of
``doc_id`` per stripe and row group, and a Bloom filter on it, so a lookup opens few row groups.
Each row also holds its running position inside its file; the position in the whole corpus adds
the sizes of the files before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.llm.encoders import word_end
from netquarry.llm.staging import stage_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WRITER = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
ROWS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("part", pa.int32()),
        ("part_start", pa.int64()),
        ("tokens", pa.list_(pa.int32())),
    ]
)
ROWS_DDL = "doc_id long, part int, part_start long, tokens array<int>"
DIGEST = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("part", pa.int32()),
        ("part_start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
DIGEST_DDL = "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    partitions: int | None = None,
) -> None:
    """Encode every text (null: empty), append ``end_id``, write ORC in ascending ``doc_id``
    (nulls first; rows with the same id in the order of their texts' hashes)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_end(vocabulary)
        part, position = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            rows = [encoder.encode(text or "") + end for text in batch[1].to_pylist()]
            offsets = np.zeros(len(rows) + 1, dtype=np.int64)
            np.cumsum([len(r) // 2 for r in rows], out=offsets[1:])
            ids = np.frombuffer(b"".join(rows), dtype="<u2").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch[0],
                    pa.array(np.full(len(rows), part, dtype=np.int32)),
                    pa.array(position + offsets[:-1]),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ],
                schema=ROWS,
            )
            position += int(offsets[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first()]
    rows = rows.repartitionByRange(partitions, *order) if partitions else (
        rows.repartitionByRange(*order)
    )
    rows = rows.sortWithinPartitions(*order, F.xxhash64("text"))
    rows.mapInArrow(encode, ROWS_DDL).write.options(**WRITER).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, part_start, tokens. A filter on ``doc_id`` reaches the stripe statistics and
    the Bloom filters."""
    return spark.read.schema(ROWS_DDL).orc(path)


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[3]
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy().astype("<u4")
            sums = [
                zlib.crc32(ids[a:b].tobytes())
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch[0],
                    batch[1],
                    batch[2],
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ],
                schema=DIGEST,
            )

    rows = tokens.select("doc_id", "part", "part_start", "tokens").mapInArrow(
        checksum, DIGEST_DDL
    )
    # one row per file
    sizes = tokens.groupBy("part").agg(
        F.max(F.col("part_start") + F.size("tokens")).alias("size")
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    return rows.join(before, "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def store_and_read(
    docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Write the corpus and give each document's digest as read back from the files.

    Null and empty texts are one end id; repeated rows are stored as often as they occur; extra
    columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    path = path or stage_path(spark, "tokens", "orc")
    write_tokens(docs, path, vocabulary)
    return digests(read_tokens(spark, path))
