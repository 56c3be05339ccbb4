"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word, with a blank on either side, in both directions, and gives
every position a distribution over the languages. It is trained in numpy by backpropagation
through time, with the document's language as the label of every position. A document's languages
are pooled over the positions of all its words: the mean of the positions' log-probabilities,
normalised. A word's share of that sum does not depend on its neighbours, so each distinct word is
read once per worker and kept in a bounded cache. Long words are read in pieces, to the end.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.toxicity import fold

FOLDS = 3
HELD_OUT = 1
HIDDEN = 16
#: Bound of the training sample: documents of each language, those with the lowest hash among the
#: ones of at most so many characters, and words drawn from them.
DOCS_PER_LANGUAGE = 300
TRAIN_CHARS = 20_000
WORDS_PER_LANGUAGE = 20_000
BATCH = 128
RATE = 0.01
PIECE = 64
CACHE_WORDS = 500_000
READ_AT_ONCE = 4096
LETTERS = re.compile(r"[^\W\d_]+")
NO_LANGUAGE = "und"

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]
)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def pieces_of(word: str) -> list[bytes]:
    """A word's bytes between blanks, in pieces of at most ``PIECE``."""
    data = b" " + word.encode("utf-8", "surrogatepass") + b" "
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def gru(x: np.ndarray, table: np.ndarray, u: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (batch, time, hidden) of one direction; ``trace`` gathers what the way back needs."""
    batch, time = x.shape
    h = u.shape[0]
    state = np.zeros((batch, h), dtype=table.dtype)
    states = np.empty((batch, time, h), dtype=table.dtype)
    for t in range(time):
        a, g = table[x[:, t]], state @ u
        gates = sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
        if trace is not None:
            trace.append((state, z, r, new, g[:, 2 * h :]))
        state = new + z * (state - new)
        states[:, t] = state
    return states


def gru_back(
    x: np.ndarray, u: np.ndarray, trace: list, d_states: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and u from those of the states."""
    d_table = np.zeros((256, u.shape[1]), dtype=u.dtype)
    d_u = np.zeros_like(u)
    d_next = np.zeros_like(trace[0][0])
    for t in range(len(trace) - 1, -1, -1):
        before, z, r, new, g_new = trace[t]
        d = d_states[:, t] + d_next
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (before - new) * z * (1 - z)
        d_r = d_new * g_new * r * (1 - r)
        np.add.at(d_table, x[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
        d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_u += before.T @ d_g
        d_next = d * z + d_g @ u.T
    return d_table, d_u


@dataclass
class Network:
    """Byte tables and recurrences of both directions, and the output layer."""

    languages: list[str]
    parameters: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        one = [draw(256, 3 * hidden, scale=0.3), draw(hidden, 3 * hidden, scale=hidden**-0.5)]
        two = [draw(256, 3 * hidden, scale=0.3), draw(hidden, 3 * hidden, scale=hidden**-0.5)]
        top = [draw(2 * hidden, len(languages), scale=0.2), draw(len(languages), scale=0.0)]
        return cls(languages, [*one, *two, *top])

    def positions(self, x: np.ndarray, traces: tuple[list, list] | None = None):
        """Log-probabilities (batch, time, language) and the joined states."""
        table_f, u_f, table_b, u_b, top, bias = self.parameters
        ahead, behind = traces or (None, None)
        states = np.concatenate(
            [
                gru(x, table_f, u_f, ahead),
                gru(x[:, ::-1], table_b, u_b, behind)[:, ::-1],
            ],
            axis=2,
        )
        logits = states @ top + bias
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), states

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        traces: tuple[list, list] = ([], [])
        logs, states = self.positions(x, traces)
        _, u_f, _, u_b, top, _ = self.parameters
        d = np.exp(logs)
        d[np.arange(len(y)), :, y] -= 1
        d /= d.shape[0] * d.shape[1]
        flat = d.reshape(-1, d.shape[2])
        d_states = d @ top.T
        h = u_f.shape[0]
        forward = gru_back(x, u_f, traces[0], d_states[:, :, :h])
        backward = gru_back(x[:, ::-1], u_b, traces[1], d_states[:, ::-1, h:])
        return [
            *forward,
            *backward,
            states.reshape(-1, states.shape[2]).T @ flat,
            flat.sum(axis=0),
        ]

    def read(self, pieces: list[bytes]) -> np.ndarray:
        """For each piece the sum of its positions' log-probabilities."""
        out = np.empty((len(pieces), len(self.languages)), dtype=np.float64)
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, p in enumerate(pieces):
            by_length[len(p)].append(i)
        for length, found in by_length.items():
            for at in range(0, len(found), READ_AT_ONCE):
                part = found[at : at + READ_AT_ONCE]
                x = np.frombuffer(b"".join(pieces[i] for i in part), dtype=np.uint8)
                logs, _ = self.positions(x.reshape(-1, length))
                out[part] = logs.sum(axis=1, dtype=np.float64)
        return out


def train(texts: list[str], languages: list[str], seed: int = 5) -> Network | None:
    """One pass of Adam over words drawn evenly from the languages; None without any."""
    known = sorted(set(languages))
    if not known:
        return None
    net = Network.fresh(known)
    if len(known) == 1:
        return net
    rng = np.random.default_rng(seed)
    by_length: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
    for number, language in enumerate(known):
        words = [
            w for t, own in zip(texts, languages, strict=True) if own == language
            for w in words_of(t)
        ]
        if not words:
            continue
        for i in rng.integers(0, len(words), WORDS_PER_LANGUAGE):
            for p in pieces_of(words[i]):
                by_length[len(p)].append((p, number))
    batches = []
    for found in by_length.values():
        order = rng.permutation(len(found))
        batches += [
            [found[i] for i in order[at : at + BATCH]] for at in range(0, len(order), BATCH)
        ]
    means = [np.zeros_like(p) for p in net.parameters]
    squares = [np.zeros_like(p) for p in net.parameters]
    for step, which in enumerate(rng.permutation(len(batches)), 1):
        batch = batches[which]
        x = np.frombuffer(b"".join(p for p, _ in batch), dtype=np.uint8).reshape(len(batch), -1)
        rate = RATE * (1 - (step - 1) / len(batches))
        found = net.gradients(x, np.array([y for _, y in batch]))
        size = np.sqrt(sum(float((g * g).sum()) for g in found))
        shrink = min(1.0, 1.0 / (size + 1e-9))
        for k, g in enumerate(found):
            g = g * shrink
            means[k] += 0.1 * (g - means[k])
            squares[k] += 0.01 * (g * g - squares[k])
            net.parameters[k] -= (
                rate
                * (means[k] / (1 - 0.9**step))
                / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-8)
            ).astype(np.float32)
    return net


class Reader:
    """Pools words into documents, with a bounded cache of the words read."""

    def __init__(self, net: Network, bound: int = CACHE_WORDS):
        self.net, self.bound = net, bound
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = np.zeros((0, len(self.net.languages) + 1))

    def learn(self, words: set[str]) -> None:
        """Read the words that are not known yet; the last column counts positions."""
        new = [w for w in words if w not in self.place]
        if not new:
            return
        # signs that only look like letters to the pattern count for nothing
        split = [pieces_of(w) if any(c.isalpha() for c in w) else [] for w in new]
        owner = np.repeat(np.arange(len(new)), [len(s) for s in split])
        flat = [p for s in split for p in s]
        rows = np.zeros((len(new), self.sums.shape[1]))
        if flat:
            np.add.at(rows[:, :-1], owner, self.net.read(flat))
            np.add.at(rows[:, -1], owner, [len(p) for p in flat])
        start = len(self.place)
        self.place.update(zip(new, range(start, start + len(new)), strict=True))
        self.sums = np.concatenate([self.sums, rows])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [words_of(t or "") for t in texts]
        wanted = set().union(*found) if found else set()
        if len(self.place) + len(wanted) > self.bound:
            self.forget()
        self.learn(wanted)
        names, scores = [], []
        for words in found:
            total = self.sums[list(map(self.place.__getitem__, words))].sum(axis=0)
            if not len(words) or not total[-1]:
                names.append(NO_LANGUAGE)
                scores.append(0.0)
                continue
            mean = total[:-1] / total[-1]
            p = np.exp(mean - mean.max())
            p /= p.sum()
            best = int(p.argmax())
            names.append(self.net.languages[best])
            scores.append(float(p[best]))
        return names, scores


def training_sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """A bounded sample of documents of each language outside the held-out fold."""
    known = docs.filter(
        F.col("lang").isNotNull()
        & F.col("doc_id").isNotNull()
        & (fold("doc_id", FOLDS) != HELD_OUT)
        & (F.length("text") <= TRAIN_CHARS)
    )
    first = Window.partitionBy("lang").orderBy("hash", "doc_id")
    # ids only: the window keeps the few lowest of each language before anything is shuffled
    chosen = (
        known.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("long")).alias("hash"))
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= DOCS_PER_LANGUAGE)
        .select("doc_id", "lang")
        .distinct()
    )
    rows = known.select("doc_id", "text", "lang").join(chosen, ["doc_id", "lang"]).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def predict_documents(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score for every row; whole texts."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                if reader is None:
                    names, scores = [NO_LANGUAGE] * part.num_rows, [0.0] * part.num_rows
                else:
                    names, scores = reader.predict(part[1].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part[0], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    schema=SCHEMA,
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per row of ``docs``.

    ``und`` with score 0 where the text is null, empty or without a letter, and for every text if no
    row tells a language. Repeated rows get the same answer; a null doc_id is kept and is not held
    out; extra columns are ignored."""
    net = train(*training_sample(docs))
    return predict_documents(docs, net).select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
