"""Quality by repetition: how much of a text stands in n-grams and lines that occur before.

Words get numbers, and rolling hashes of several n-gram lengths are formed from them in numpy, each
length from the one before. A hash found twice marks all its places; the characters of the words
marked, over the characters of all words, are the coverage at that length. Repeated lines are
measured the same way. A text is rejected where a coverage passes its limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white space that separates words, and the symbols counted.
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: n-gram length -> largest share of a text's word characters inside n-grams that occur twice
LIMITS = {3: 0.50, 5: 0.45, 8: 0.40, 10: 0.35}
LINE_LIMIT = 0.50
FACTOR = np.uint64(0x9E3779B97F4A7C15)
EXACT_BITS = 21

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
    *(f"dup{n}_chars" for n in LIMITS),
)
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
DDL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def mixed(numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word number."""
    x = (numbers.astype(np.uint64) + np.uint64(1)) * FACTOR
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(keys: np.ndarray, n: int, size: int) -> np.ndarray | None:
    """Which of ``size`` words lie in an n-gram whose key occurs twice; None if none does."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return None
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(size + 1, dtype=np.int64)
    edges[: len(keys)] += twice
    edges[n:] -= twice[: size + 1 - n]
    return np.cumsum(edges[:-1]) > 0


def exact_triples(numbers: np.ndarray, distinct: int) -> np.ndarray:
    """A key for each three words in a row, equal only where all three are."""
    if distinct >> EXACT_BITS == 0:
        wide = numbers.astype(np.int64)
        return wide[:-2] << (2 * EXACT_BITS) | wide[1:-1] << EXACT_BITS | wide[2:]
    rows = np.stack([numbers[:-2], numbers[1:-1], numbers[2:]], axis=1)
    return np.unique(rows, axis=0, return_inverse=True)[1].ravel()


def measure(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = WORD.findall(text)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(map(len, WORD.findall(line)))
        elif line.strip(BLANKS):
            seen.add(line)
    numbers_of: dict[str, int] = {}
    numbers = np.fromiter(
        (numbers_of.setdefault(w, len(numbers_of)) for w in words),
        dtype=np.int64,
        count=len(words),
    )
    size, repeated = len(words), 0
    dup_chars = dict.fromkeys(LIMITS, 0)
    if size > 2:
        mark = covered(exact_triples(numbers, len(numbers_of)), 3, size)
        if mark is not None:
            repeated = int(mark.sum())
            values = mixed(numbers)
            rolled = values
            for n in range(2, min(size, max(LIMITS)) + 1):
                rolled = rolled[:-1] * FACTOR + values[n - 1 :]
                if n in LIMITS:
                    mark = covered(rolled, n, size)
                    if mark is None:
                        break  # no longer n-gram can occur twice either
                    dup_chars[n] = int(lengths[mark].sum())
    symbols = sum(text.count(c) for c in SYMBOLS)
    return (
        size, int(lengths.sum()), symbols, dup_lines, repeated, dup_line_chars, *dup_chars.values()
    )


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept. Null and empty texts have no words and fail the base
    rule; repeated rows are judged one by one; extra columns are ignored."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "") for t in batch[1].to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch[0], *(pa.array(c, pa.int64()) for c in columns)], schema=SCHEMA
            )

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        judge, DDL
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    passes = F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, limit in LIMITS.items():
        passes &= F.col(f"dup{n}_chars") <= limit * F.col("word_chars")
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & passes)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, judged where they lie: nothing is shuffled."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [accepted(measure(t or "")) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def accepted(counts: tuple[int, ...]) -> bool:
    """The verdict of :func:`repetition` on one text's counts."""
    c = dict(zip(COUNTS, counts, strict=True))
    if c["n_words"] < LEAST_WORDS or 100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"]:
        return False
    return c["dup_line_chars"] <= LINE_LIMIT * c["word_chars"] and all(
        c[f"dup{n}_chars"] <= limit * c["word_chars"] for n, limit in LIMITS.items()
    )
