"""Byte-pair encoding with content-defined chunk reuse, and decoding.

A rolling hash over the characters cuts every text where the hash of the last ``SPAN`` characters
ends in zero bits, so a passage that stands in many documents gives the same chunks in all of
them, wherever it stands. A chunk that occurs twice or more in the corpus is encoded once; its ids
travel to the documents that hold it. The stretches between such chunks are encoded in place. The
joins are then repaired: the characters around a join are encoded again together, and stored ids
are kept only from a place on where both agree exactly; where they do not, the repaired stretch
grows until they do.

Rows are told apart by document id and text, so repeated rows and repeated ids are safe.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.encoders import WHITE_SPACE, ByteLevel, byte_level
from netquarry.llm.staging import stage

VOCABULARY = "byte_bpe_50k.json"
SPAN = 32
MULTIPLIER = 0x9E3779B1
BITS = 10
LEAST, MOST = 64, 8192
#: Rows of a batch that are taken apart at once.
SLICE = 500
#: Where white space follows something else; no token reaches across such a place.
BOUNDARY = re.compile(f"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}])")

ROWS = pa.schema(
    [
        ("doc_id", pa.int64()),
        pa.field("row_key", pa.int64(), nullable=False),
        ("packed", pa.binary()),
    ]
)
ROWS_DDL = "doc_id long, row_key long not null, packed binary"
CHUNKS = pa.schema([("row_key", pa.int64()), ("keys", pa.list_(pa.binary()))])
CHUNKS_DDL = "row_key long, keys array<binary>"
SHARED = pa.schema([("chunk", pa.binary()), ("ids", pa.binary())])
SHARED_DDL = "chunk binary, ids binary"
DIGEST = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
        ("n_reused", pa.int64()),
    ]
)
DIGEST_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_reused long"
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_reused", pa.int64())])
ENCODED_DDL = "doc_id long, ids binary, n_reused long"


def cut_points(text: str) -> list[int]:
    """Ends of the chunks of ``text``. A cut depends on the ``SPAN`` characters before it and, by
    the least and the most length, on the cut before it."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    # sum of code * m^(SPAN - age), mod 2^32, by doubling the span
    rolled, width, power = codes.copy(), 1, MULTIPLIER
    while width < SPAN:
        rolled[width:] = rolled[width:] + rolled[:-width] * np.uint32(power)
        power = power * power & 0xFFFFFFFF
        width *= 2
    mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    found = np.flatnonzero((mixed >> np.uint32(32 - BITS)) == 0) + 1
    ends, last = [], 0
    for end in [*found[found >= SPAN].tolist(), n]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or (end == n and end > last):
            ends.append(end)
            last = end
    return ends


def chunk_texts(text: str) -> list[str]:
    ends = cut_points(text)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_key(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass"))


def stitch(parts: list[tuple[str, bytes]], encode: Callable[[str], bytes]) -> bytes:
    """Ids of the joined text from parts that were encoded one by one."""
    if len(parts) == 1:
        return parts[0][1]
    out: list[bytes] = []
    open_text = ""
    for text, ids in parts:
        bounds = [m.start() for m in BOUNDARY.finditer(text)] if len(text) <= 256 else None
        first, last = 0, -1
        while True:
            a, b = inner_bounds(text, bounds, first, last)
            if a is None:  # nothing of the stored ids can be kept
                open_text += text
                break
            head, tail = encode(text[:a]), encode(text[b:])
            kept = len(ids) - len(head) - len(tail)
            if kept >= 0 and ids.startswith(head) and ids.endswith(tail):
                out.append(encode(open_text + text[:a]) if open_text else head)
                out.append(ids[len(head) : len(ids) - len(tail)])
                open_text = text[b:]
                break
            first, last = first + 1, last - 1
    out.append(encode(open_text))
    return b"".join(out)


def inner_bounds(
    text: str, bounds: list[int] | None, first: int, last: int
) -> tuple[int | None, int | None]:
    """The boundary number ``first`` of the text and number ``last`` from its end, if in order."""
    if bounds is None and first == 0:
        m = BOUNDARY.search(text)
        b = max((text.rfind(c) for c in (" ", "\n")), default=-1)
        if m and b > 0 and not text[b - 1].isspace() and b >= m.start():
            return m.start(), b
    if bounds is None:
        bounds = [m.start() for m in BOUNDARY.finditer(text)]
    if len(bounds) < first + 1 or len(bounds) < -last or bounds[first] > bounds[last]:
        return None, None
    return bounds[first], bounds[last]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row_key; the key is never null, so joins on it add no filter of their own."""
    key: Column = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("row_key"))


def packed_rows(rows: DataFrame) -> DataFrame:
    """doc_id, row_key, packed: the texts as they are shuffled, compressed one by one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                packed = [compress((t or "").encode()) for t in part[2].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part[0], part[1], pa.array(packed, pa.binary())], schema=ROWS
                )

    return rows.select("doc_id", "row_key", "text").mapInArrow(pack, ROWS_DDL)


def corpus_chunks(rows: DataFrame) -> DataFrame:
    """row_key, keys: the chunk keys of each text, in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keys = [
                    [chunk_key(c) for c in chunk_texts(t)] if t else []
                    for t in part[1].to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [part[0], pa.array(keys, pa.list_(pa.binary()))], schema=CHUNKS
                )

    return rows.select("row_key", "text").mapInArrow(cut, CHUNKS_DDL)


def shared_ids(rows: DataFrame, chunks: DataFrame, vocabulary: str) -> DataFrame:
    """chunk, ids: each chunk that occurs twice or more, encoded once, in one of its documents."""
    found = chunks.select("row_key", F.explode("keys").alias("chunk"))
    shared = found.groupBy("chunk").agg(F.count("*").alias("n"), F.min("row_key").alias("row_key"))
    wanted = (
        shared.filter("n > 1").groupBy("row_key").agg(F.collect_list("chunk").alias("wanted"))
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(vocabulary)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keys, ids = [], []
                for packed, wanted in zip(part[1].to_pylist(), part[2].to_pylist(), strict=True):
                    left = set(wanted)
                    for chunk in chunk_texts(unpack(packed).decode() if packed else ""):
                        key = chunk_key(chunk)
                        if key in left:
                            left.discard(key)
                            keys.append(key)
                            ids.append(encoder.encode(chunk))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], schema=SHARED
                )

    # the same columns and no filter, so that the exchange of the texts is the one that
    # with_shared() needs, and Spark runs it once
    held = rows.join(wanted, "row_key", "right").select("doc_id", "packed", "wanted")
    # a repeated row would encode its chunks twice
    return held.mapInArrow(encode, SHARED_DDL).dropDuplicates(["chunk"])


def with_shared(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, packed, keys, ids: each text, and the keys and ids of the shared chunks in it."""
    texts = keyed(docs)
    chunks = stage(corpus_chunks(texts), "chunks")
    rows = packed_rows(texts)
    ids = shared_ids(rows, chunks, vocabulary)
    places = chunks.select("row_key", F.explode(F.array_distinct("keys")).alias("chunk"))
    stored = (
        places.join(ids, "chunk")
        .groupBy("row_key")
        .agg(F.collect_list(F.struct("chunk", "ids")).alias("stored"))
    )
    return rows.join(stored, "row_key", "left").select(
        "doc_id", "packed", "stored.chunk", "stored.ids"
    )


def encode_text(text: str, stored: dict[bytes, bytes], encode: Callable[[str], bytes]):
    """Packed ids of a text and the number of chunks that were reused."""
    if not stored:
        return encode(text), 0
    parts: list[tuple[str, bytes]] = []
    plain: list[str] = []
    reused = 0
    for chunk in chunk_texts(text):
        ids = stored.get(chunk_key(chunk))
        if ids is None:
            plain.append(chunk)
            continue
        if plain:
            joined = "".join(plain)
            parts.append((joined, encode(joined)))
            plain = []
        parts.append((chunk, ids))
        reused += 1
    if plain:
        joined = "".join(plain)
        parts.append((joined, encode(joined)))
    return stitch(parts, encode), reused


def encoded_parts(
    batches: Iterator[pa.RecordBatch], encoder: ByteLevel
) -> Iterator[tuple[pa.Array, list[bytes], list[int]]]:
    """Ids of documents, their packed token ids and the numbers of chunks reused, from the rows of
    :func:`with_shared`."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            found = [
                encode_text(
                    unpack(packed).decode(), dict(zip(keys or (), ids or (), strict=True)),
                    encoder.encode,
                )
                for packed, keys, ids in zip(*(part[i].to_pylist() for i in (1, 2, 3)), strict=True)
            ]
            yield part[0], [ids for ids, _ in found], [n for _, n in found]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (packed 16-bit), n_reused. Null and empty texts have no ids; extra columns are
    ignored; repeated rows are encoded as often as they occur."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, ids, reused in encoded_parts(batches, byte_level(vocabulary)):
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(ids, pa.binary()), pa.array(reused, pa.int64())], schema=ENCODED
            )

    return with_shared(docs, vocabulary).mapInArrow(encode, ENCODED_DDL)


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text from doc_id, ids (packed 16-bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(vocabulary)
        for batch in batches:
            texts = [
                encoder.decode(np.frombuffer(ids or b"", dtype="<u2"))
                for ids in batch[1].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(texts, pa.string())], schema=schema
            )

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digest of each document's ids and of the text decoded from them, in the task that encodes
    it."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(vocabulary)
        listed = np.array([str(i) for i in range(65536)], dtype=object)
        for names, packed, reused in encoded_parts(batches, encoder):
            sizes, ids_sha, text_sha = [], [], []
            for one in packed:
                ids = np.frombuffer(one, dtype="<u2")
                sizes.append(len(ids))
                joined = ",".join(listed[ids].tolist())
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    names,
                    pa.array(sizes, pa.int64()),
                    pa.array(ids_sha, pa.string()),
                    pa.array(text_sha, pa.string()),
                    pa.array(reused, pa.int64()),
                ],
                schema=DIGEST,
            )

    return with_shared(docs, vocabulary).mapInArrow(digest, DIGEST_DDL)
