"""Toxicity: character n-grams of words as a bag of embeddings, averaged into a linear softmax.

Every word is its n-grams between ``<`` and ``>``, hashed to rows of an embedding table, so a
misspelling that was never seen shares most rows with the word it stands for. A document is the
mean of the rows of all its words; embeddings and the softmax on top are trained jointly in
numpy. The scoring pass uses that the model is linear in the rows: a row counts with one
number, a word with the sum of its rows and their count, and words are kept in a bounded cache.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.encoders import Memo

FOLDS = 5
BUCKETS = 1 << 14
WIDTH = 8
GRAMS = (3, 4, 5)
#: Bound of the training sample: labelled documents of class 0 and of class 1, those with the
#: lowest hash among the ones of at most so many characters.
SAMPLE = (3000, 1500)
TRAIN_CHARS = 20_000
STEPS = 350
BATCH = 128
RATE = 0.03
#: Weight decay with a full sample; a smaller one needs more, up to four times this.
DECAY = 0.5
LEAST_TEXTS = 3
#: How much the mean is scaled before the softmax: it is over many rows of which few tell.
SCALE = 30.0
WORD = re.compile(r"[^\W_]+")

SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def rows_of(word: str) -> list[int]:
    """The table rows of a lower-case word."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)} or {marked}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Model:
    """What scoring needs: a number for each table row, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, total: float, n: float) -> float:
        """Probability of class 1 from the sum over the rows of a text and their number."""
        if not n:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(total / n + self.bias, -500, 500))))


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its table rows and their shares of all its rows."""
    known = Memo(lambda w: np.array(rows_of(w), dtype=np.int64))
    out = []
    for text in texts:
        rows = [known[w] for w in words_of(text)]
        if not rows:
            out.append((np.zeros(0, dtype=np.int64), np.zeros(0)))
            continue
        found, n = np.unique(np.concatenate(rows), return_counts=True)
        out.append((found, (n / n.sum()).astype(np.float32)))
    return out


def rarity(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How much each table row counts: 3 where few texts of the sample have it, 0 where all do or
    fewer than ``LEAST_TEXTS``."""
    texts = np.zeros(BUCKETS)
    for rows, _ in found:
        texts[rows] += 1
    n = max(2, len(found))
    share = np.maximum(texts, 1) / n
    return np.where(texts < LEAST_TEXTS, 0.0, 3.0 * -np.log(share) / np.log(n))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Adam with weight decay on the cross-entropy of the softmax. Where class 1 is rarer than half
    of class 0, its documents weigh as if it were not."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        sure = 40.0 if labels and labels[0] == 1 else -40.0
        return Model(np.zeros(BUCKETS), sure)
    weight = np.ones(len(y), dtype=np.float32)
    weight[y == 1] = max(1.0, (y == 0).sum() / (2 * (y == 1).sum()))
    decay = DECAY * min(4.0, max(1.0, sum(SAMPLE) / len(y)) ** 0.5)
    found = bags(texts)
    rare = rarity(found)
    used = np.unique(np.concatenate([rows for rows, _ in found]))
    place = np.zeros(BUCKETS, dtype=np.int64)
    place[used] = np.arange(len(used))
    parameters = [
        rng.normal(0, 0.1, (len(used), WIDTH)).astype(np.float32),
        rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32),
        np.zeros(2, dtype=np.float32),
    ]
    means = [np.zeros_like(p) for p in parameters]
    squares = [np.zeros_like(p) for p in parameters]
    order = np.zeros(0, dtype=np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(y))])
        chosen, order = order[:BATCH], order[BATCH:]
        rate = RATE * (1 - (step - 1) / STEPS)
        x = np.zeros((len(chosen), len(used)), dtype=np.float32)
        for i, k in enumerate(chosen):
            rows, share = found[k]
            x[i, place[rows]] = share * rare[rows]
        table, top, bias = parameters
        hidden = SCALE * (x @ table)
        logits = hidden @ top + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(chosen)), y[chosen]] -= 1
        p *= (weight[chosen] / weight[chosen].sum())[:, None]
        gradients = [SCALE * (x.T @ (p @ top.T)), hidden.T @ p, p.sum(axis=0)]
        for k, g in enumerate(gradients):
            means[k] += 0.1 * (g - means[k])
            squares[k] += 0.001 * (g * g - squares[k])
            change = (means[k] / (1 - 0.9**step)) / (
                np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8
            )
            parameters[k] -= rate * (change + (decay * parameters[k] if k < 2 else 0))
    table, top, bias = (p.astype(np.float64) for p in parameters)
    weights = np.zeros(BUCKETS)
    weights[used] = SCALE * rare[used] * (table @ (top[:, 1] - top[:, 0]))
    return Model(weights, float(bias[1] - bias[0]))


def fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled documents outside fold 0, the same on every run."""
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & (fold("doc_id", FOLDS) != 0))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
        .dropDuplicates(["doc_id"])
    )
    texts = docs.filter(F.length("text") <= TRAIN_CHARS).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    rows: list = []
    for label, bound in enumerate(SAMPLE):
        # the ids are chosen first, so that only their texts are fetched
        chosen = (
            known.filter(F.col("label") == label)
            .join(texts.select("doc_id"), "doc_id", "left_semi")
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(bound)
        )
        rows += (
            texts.join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "text", "label")
            .collect()
        )
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["label"] for r in rows]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row; whole texts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights

        def summed(word: str) -> complex:
            rows = rows_of(word)
            return complex(sum(weights[r] for r in rows), len(rows))

        # a complex number carries the sum and the number of rows, and adds both at once
        known = Memo(summed)
        for batch in batches:
            scores = []
            for text in batch[1].to_pylist():
                total = sum(map(known.__getitem__, words_of(text or "")), 0j)
                scores.append(model.score(total.real, total.imag))
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(scores, pa.float64())], schema=SCORES
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``.

    Texts without a word (null and empty ones too) score 0. Without labels of both classes the
    score is that of the only class, or 0. Repeated rows are scored alike; a null doc_id is kept
    and is not held out; extra columns are ignored."""
    model = train(*training_sample(docs, labels))
    return score_documents(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
