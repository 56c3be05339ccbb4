"""Collocations: phrases whose words occur together more often than their parts suggest.

A word's suffix is the word and up to four words after it in its piece. Suffixes are sorted by a
multikey three-way quicksort: a partition is split by a pivot word at its depth into smaller, equal
and larger; the equal part goes on at the next depth, and its size is the count of the phrase
spelled so far. A part that holds fewer suffixes than the least count is abandoned at once.

So that a partition is whole in one task, suffixes are first routed by their leading words: by the
first one; by two where the first is so frequent that its suffixes would not fit a task; by three
where the first two are, and such a pair is then added up over the routes. Before they travel, the suffixes
of a few million words are put in order in their own task, and equal ones become one with a count,
so a passage that many documents share costs one suffix a batch. They travel as compressed columns
of word numbers beside the words.

Counts of phrases that are parts of others come from the same result; every score is exact in
128-bit decimals.

Defined cases: a null or empty text has no words; a null language counts as ``und``, together with
documents of that language; repeated rows count each time; ids are not read; other columns are
ignored; an empty table has no rows. Phrases tied at the last rank are cut by their order, which is
total.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.staging import stage

#: What ends a piece, and what separates words in it.
ENDS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"
#: Words in a phrase, least count, rows a language.
LONGEST, LEAST, MOST = 5, 100, 2000
#: Characters put in order at once before they travel, and suffixes meant for one route.
BATCH_CHARS, ROUTE_SUFFIXES = 12_000_000, 2_000_000
#: The lists of words and pairs that are too frequent for one route cannot be longer than this
#: (8 bytes each). A batch reports its pairs with at least 1 / PAIR_SHARE of its words, so a pair
#: that no list has holds less than a route's limit and that share of all words.
HEAVY_MOST, PAIR_SHARE = 1 << 22, 65_536
#: Routes share shuffle partitions beyond this many; a task then takes them one after another.
MOST_PARTS = 1 << 17

TABLE = bytes(
    10 if chr(b) in ENDS else 32 if chr(b) in BLANKS else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)
PACKED = pa.schema(
    [("route", pa.int64()), ("lang", pa.string()), ("n", pa.int32()), ("words", pa.binary()),
     ("columns", pa.binary())]
)
PACKED_DDL = "route long, lang string, n int, words binary, columns binary"
COUNTED = pa.schema(
    [("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())]
)
COUNTED_DDL = "lang string, phrase string, k int, f long"


def counted(lang: str, phrases: list[str], k: int, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(phrases), pa.string()),
            pa.array(phrases, pa.string()),
            pa.array(np.full(len(phrases), k, dtype=np.int32)),
            pa.array(f.astype(np.int64)),
        ],
        schema=COUNTED,
    )


@dataclass(frozen=True)
class Words:
    """The words of a batch: numbers from 1, in order, and 0 at the end of each piece."""

    names: list[bytes]
    numbers: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Lower-cased words of texts. Every change is byte for byte, so the offsets stay."""
    texts = texts.cast(pa.large_string())
    offsets, data = texts.buffers()[1], texts.buffers()[2]
    plain = pa.py_buffer(data.to_pybytes().translate(TABLE)) if data is not None else None
    lowered = pa.Array.from_buffers(
        pa.large_string(), len(texts), [None, offsets, plain], 0, texts.offset
    )
    end, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
    ended = pc.binary_join_element_wise(lowered, end, nothing)
    spaced = pc.replace_substring(ended, "\n", " \n ")
    coded = pc.split_pattern(spaced, " ").flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy()
    to = np.zeros(len(names), dtype=np.int32)
    kept: list[bytes] = []
    empty = np.zeros(len(names), dtype=bool)
    for k, name in enumerate(names):
        if name == "":
            empty[k] = True
        elif name != "\n":
            kept.append(name.encode())
            to[k] = len(kept)
    return Words(kept, to[codes[~empty[codes]]])


def batches_of(
    rows: Iterator[pa.RecordBatch], most: int
) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of about ``most`` bytes; a longer text is a batch of its own."""
    waiting: dict[str, list[pa.Array]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    for batch in rows:
        langs = batch[0].to_numpy(zero_copy_only=False)
        lengths = pc.binary_length(batch[1]).to_numpy(zero_copy_only=False).astype(np.int64)
        for lang in dict.fromkeys(langs):
            at = np.flatnonzero(langs == lang)
            # cut where the running size passes a multiple of the limit
            slot = (sizes[lang] + np.cumsum(lengths[at])) // most
            for s in np.unique(slot):
                part = at[slot == s]
                if s > 0 and waiting[lang]:
                    yield lang, pa.concat_arrays(waiting.pop(lang))
                    sizes[lang] = 0
                waiting[lang].append(batch[1].take(pa.array(part)))
                sizes[lang] += int(lengths[part].sum())
        # a task may hold many languages: the largest go first when all together are too much
        while sum(sizes.values()) > 2 * most:
            lang = max(sizes, key=lambda name: sizes[name])
            sizes.pop(lang)
            yield lang, pa.concat_arrays(waiting.pop(lang))
    for lang, parts in waiting.items():
        if parts:
            yield lang, pa.concat_arrays(parts)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )


def word_counts(docs: DataFrame, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """lang, phrase, k, f: every word (k = 1), and the pairs frequent in some batch (k = 2), each
    with its count in those batches."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in batches_of(rows, batch_chars):
            words = words_of(texts)
            f = np.bincount(words.numbers, minlength=len(words.names) + 1)[1:]
            names = [w.decode() for w in words.names]
            yield counted(lang, names, 1, f)
            ahead, after = words.numbers[:-1].astype(np.int64), words.numbers[1:].astype(np.int64)
            pairs = np.sort((ahead << 32 | after)[(ahead > 0) & (after > 0)])
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]) if len(pairs) else [])
            f = np.diff(np.append(first, len(pairs)))
            often = f >= max(2, len(words.numbers) // PAIR_SHARE)
            spelled = [
                f"{names[(p >> 32) - 1]} {names[(p & 0xFFFFFFFF) - 1]}"
                for p in pairs[first[often]].tolist()
            ]
            yield counted(lang, spelled, 2, f[often])

    found = texts_of(docs).mapInArrow(count, COUNTED_DDL)
    return found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def key_of(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\x00" + word)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) + second)


@dataclass(frozen=True)
class Frequent:
    """Keys of the words, and of the pairs, whose suffixes go to several routes. All tasks route by
    the same lists; a word or pair whose key collides is routed like a frequent one."""

    words: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def of(rows: list) -> Frequent:
        words = {key_of(r.lang, r.phrase.encode()) for r in rows if r.k == 1}
        pairs = []
        for r in rows:
            if r.k == 2:
                a, b = (
                    np.array([key_of(r.lang, w.encode())], np.uint64) for w in r.phrase.split(" ")
                )
                pairs.append(pair_keys(a, b)[0])
        return Frequent(np.array(sorted(words), np.uint64), np.array(sorted(pairs), np.uint64))

    def spread_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which suffixes are routed by three words, given the keys of the first two."""
        far = np.isin(first, self.words)
        far[far] = np.isin(pair_keys(first[far], second[far]), self.pairs)
        return far


@dataclass(frozen=True)
class Suffixes:
    """Where suffixes of two or more words start, how many words each has, and the words."""

    numbers: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def column(self, k: int) -> np.ndarray:
        return np.where(self.sizes > k, self.numbers[self.starts + k], 0)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The words of some suffixes, a row each; 0 beyond the piece."""
        windows = np.lib.stride_tricks.sliding_window_view(self.numbers, LONGEST)
        found = windows[self.starts[at]]
        sizes = self.sizes[at]
        for k in range(2, LONGEST):
            found[sizes <= k, k] = 0
        return found


def suffixes(numbers: np.ndarray) -> Suffixes:
    padded = np.append(numbers, np.zeros(LONGEST, dtype=numbers.dtype))
    sizes = np.zeros(len(numbers), dtype=np.int8)
    going = np.ones(len(numbers), dtype=bool)
    for k in range(LONGEST):
        going &= padded[k : k + len(numbers)] > 0
        sizes += going
    starts = np.flatnonzero(sizes >= 2)
    return Suffixes(padded, starts, sizes[starts])


def combined(route: np.ndarray, found: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(routes, rows, counts): equal suffixes as one, in the order of routes.

    Sorted are 64-bit numbers of route, hash and place, so that equal suffixes lie side by side.
    Neighbours become one only if all their words agree; should a hash keep equal ones apart, they
    travel as two, each with its count."""
    size = len(found.starts)
    place_bits = max(size - 1, 1).bit_length()
    route_bits = max(int(route.max()), 1).bit_length()
    hashed = np.zeros(size, dtype=np.uint64)
    for k in range(LONGEST):
        hashed = mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + found.column(k).astype(np.uint64))
    key = route.astype(np.uint64) << np.uint64(64 - route_bits)
    key |= (hashed >> np.uint64(route_bits + place_bits)) << np.uint64(place_bits)
    key |= np.arange(size, dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    like = np.append(False, (key[1:] >> np.uint64(place_bits)) == (key[:-1] >> np.uint64(place_bits)))
    at = np.flatnonzero(like)
    like[at] = (found.rows(order[at]) == found.rows(order[at - 1])).all(axis=1)
    first = np.flatnonzero(~like)
    counts = np.diff(np.append(first, size))
    picked = order[first]
    return route[picked], found.rows(picked), counts


def renumbered(part: np.ndarray, words: int, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words used, 0 first, ``part`` as places among them)."""
    if part.size < words // 4:
        used, local = np.unique(np.append(part.ravel(), 0), return_inverse=True)
        return used, local[:-1].reshape(part.shape)
    seen = np.zeros(words + 1, dtype=bool)
    seen[part] = True
    seen[0] = True
    used = np.flatnonzero(seen)
    scratch[used] = np.arange(len(used))
    return used, scratch[part]


def packed_suffixes(
    docs: DataFrame, routes: int, frequent: Frequent, batch_chars: int = BATCH_CHARS
) -> DataFrame:
    """route, lang, n, words, columns: compressed runs of suffixes with counts."""
    codec = "zstd"

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in batches_of(rows, batch_chars):
            words = words_of(texts)
            if not words.names:
                continue
            keys = np.array([0] + [key_of(lang, w) for w in words.names], dtype=np.uint64)
            found = suffixes(words.numbers)
            if not len(found.starts):
                continue
            first, second = keys[found.column(0)], keys[found.column(1)]
            route = mixed(first)
            far = np.flatnonzero(np.isin(first, frequent.words))
            route[far] = pair_keys(first[far], second[far])
            far = far[frequent.spread_pairs(first[far], second[far])]
            route[far] = mixed(route[far] + keys[found.column(2)[far]])
            spread = np.zeros(len(route), dtype=np.uint64)
            spread[far] = 1
            route = route % np.uint64(routes) << np.uint64(1) | spread
            route, rows_, counts = combined(route, found)
            counts = counts << 1 | (route & np.uint64(1)).astype(np.int64)
            route >>= np.uint64(1)
            starts = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
            scratch = np.zeros(len(words.names) + 1, dtype=np.int32)
            out: list[tuple] = []
            for a, b in zip(starts, np.append(starts[1:], len(route)), strict=True):
                used, local = renumbered(rows_[a:b].T, len(words.names), scratch)
                names = b"\n".join([words.names[u - 1] for u in used[1:].tolist()])
                body = np.vstack([local, counts[a:b][None]]).astype("<u4").tobytes()
                size = len(names).to_bytes(4, "little")
                names = size + pa.compress(names, codec, asbytes=True)
                body = pa.compress(body, codec, asbytes=True)
                out.append((int(route[a]), lang, int(b - a), names, body))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], PACKED.field(k).type) for k in range(len(PACKED))],
                schema=PACKED,
            )

    return texts_of(docs).mapInArrow(pack, PACKED_DDL)


def unpacked(n: int, words: bytes, columns: bytes) -> tuple[pa.Array, np.ndarray]:
    """(words, columns of a block; the last holds twice the count, plus one if spread)."""
    size = int.from_bytes(words[:4], "little")
    names = pa.decompress(words[4:], size, "zstd", asbytes=True)
    names = pc.split_pattern(pa.array([names], pa.large_binary()).cast(pa.large_string()), "\n")
    body = pa.decompress(columns, 4 * (LONGEST + 1) * n, "zstd", asbytes=True)
    return names.flatten(), np.frombuffer(body, dtype="<u4").reshape(LONGEST + 1, n)


def quicksort_counts(
    columns: np.ndarray, weights: np.ndarray, least: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, a suffix of each phrase, counts) of phrases of two or more words.

    All open partitions are split in one sweep of their pointers: each takes a pivot word from its
    own pointers, which are then dealt into smaller, equal and larger. Equal parts go one word deeper; parts below ``least`` are abandoned. Sweeps end when no
    partition is open."""
    if weights.sum() < least:
        return
    # what is moved: pointers, the word of each at its partition's depth, and its weight
    pointers, words, loads = np.arange(columns.shape[1]), columns[0], weights
    starts = np.zeros(1, dtype=np.int64)
    depths = np.zeros(1, dtype=np.int64)
    while len(starts):
        ends = np.append(starts[1:], len(pointers))
        sizes = ends - starts
        # a pivot: the middle one of the words at the start, the middle and the end
        a, b, c = words[starts], words[starts + sizes // 2], words[ends - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        against = np.repeat(pivot, sizes)
        part = np.repeat(np.arange(len(starts)) * 3 + 1, sizes)
        part += words > against
        part -= words < against
        totals = np.bincount(part, weights=loads, minlength=3 * len(starts))
        equal = np.zeros(3 * len(starts), dtype=bool)
        equal[1::3] = True
        depth_of = np.repeat(depths, 3) + equal
        open_ = totals >= least
        # a suffix that ends here spells nothing longer
        open_[1::3] &= pivot > 0
        counts = np.bincount(part, minlength=3 * len(starts)) * open_
        first = np.cumsum(counts) - counts
        # deal what stays open into its parts, in the order it has
        moved = np.empty(int(counts.sum()), dtype=np.int64)
        for s in range(3):
            going = np.zeros(3 * len(starts), dtype=bool)
            going[s::3] = open_[s::3]
            at = np.flatnonzero(going[part])
            own = counts[s::3]
            shift = first[s::3] - (np.cumsum(own) - own)
            moved[np.repeat(shift, own) + np.arange(len(at))] = at
        pointers, words, loads = pointers[moved], words[moved], loads[moved]
        spelled = np.flatnonzero(open_ & equal & (depth_of >= 2))
        for k in np.unique(depth_of[spelled]):
            rows = spelled[depth_of[spelled] == k]
            yield int(k), pointers[first[rows]], np.rint(totals[rows]).astype(np.int64)
        ended = open_ & (depth_of == columns.shape[0])
        if ended.any():
            on = np.repeat(~ended, counts)
            pointers, words, loads = pointers[on], words[on], loads[on]
            open_ &= ~ended
        counts, depths, deeper = counts[open_], depth_of[open_], equal[open_]
        starts = np.cumsum(counts) - counts
        at = np.flatnonzero(np.repeat(deeper, counts))
        if len(at):
            words = words.copy()
            words[at] = columns[np.repeat(depths[deeper], counts[deeper]), pointers[at]]


def phrases_of_route(
    parts: list[tuple[int, bytes, bytes]], lang: str, least: int
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of one route and language."""
    read = [unpacked(*part) for part in parts]
    coded = pa.concat_arrays([names for names, _ in read]).dictionary_encode()
    names = [b"", *(name.encode() for name in coded.dictionary.to_pylist())]
    numbers = coded.indices.to_numpy() + 1
    blocks, at = [], 0
    for own, body in read:
        to = np.append(0, numbers[at : at + len(own)]).astype(np.int32)
        at += len(own)
        blocks.append(np.vstack([to[body[:LONGEST]], body[LONGEST:].astype(np.int32)]))
    del read, coded, numbers
    table = np.hstack(blocks)
    columns, weights = table[:LONGEST], table[LONGEST].astype(np.int64) >> 1
    spread = (table[LONGEST] & 1).astype(bool)

    def rows(k: int, at: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        spelled = [b" ".join([names[w] for w in columns[:k, p]]).decode() for p in at]
        return counted(lang, spelled, k, f)

    for k, at, f in quicksort_counts(columns, weights, least):
        if k == 2:  # the pairs that other routes have too are counted below, whatever their size
            at, f = at[~spread[at]], f[~spread[at]]
        if len(at):
            yield rows(k, at, f)
    far = np.flatnonzero(spread)
    if len(far):
        pairs = columns[0, far].astype(np.int64) << 32 | columns[1, far]
        _, first, inverse = np.unique(pairs, return_index=True, return_inverse=True)
        f = np.rint(np.bincount(inverse, weights=weights[far])).astype(np.int64)
        yield rows(2, far[first], f)


def phrase_counts(
    docs: DataFrame,
    words: DataFrame,
    least: int = LEAST,
    route_suffixes: int = ROUTE_SUFFIXES,
    batch_chars: int = BATCH_CHARS,
) -> DataFrame:
    """lang, phrase, k, f of all phrases of 2 to 5 words with ``f >= least``."""
    spark = docs.sparkSession
    total = words.filter("k = 1").agg(F.sum("f")).first()[0] or 0
    # no more than HEAVY_MOST words, or pairs, can have this share of all words
    bound = max(route_suffixes // 4, total // HEAVY_MOST) + 1
    frequent = Frequent.of(words.filter(F.col("f") >= bound).select("lang", "phrase", "k").collect())
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    routes = max(dealt, -(-total // route_suffixes))
    packed = packed_suffixes(docs, routes, frequent, batch_chars)
    parts = min(routes, MOST_PARTS)
    placed = packed.repartitionById(parts, (F.col("route") % parts).cast("int"))
    placed = placed.sortWithinPartitions("route", "lang")

    def mine(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in rows:
            columns = [column.to_pylist() for column in batch.columns]
            for route, lang, n, names, body in zip(*columns, strict=True):
                if current is not None and current != (route, lang):
                    yield from phrases_of_route(parts, current[1], least)
                    parts = []
                current = (route, lang)
                parts.append((n, names, body))
        if parts:
            yield from phrases_of_route(parts, current[1], least)

    found = placed.mapInArrow(mine, COUNTED_DDL)
    return (
        found.groupBy("lang", "phrase", "k")
        .agg(F.sum("f").alias("f"))
        .filter(F.col("f") >= least)
    )


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score: the lowest score over the cuts of each phrase."""
    words = F.split("phrase", " ")
    candidates = counts.filter("k >= 2").withColumnRenamed("f", "a")
    cuts = candidates.select(
        "lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    ).select(
        "*",
        F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias(
            "right"
        ),
    )
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    met = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals, "lang")
    exact = [F.col(c).cast("decimal(18,0)").alias(c) for c in ("a", "n", "l", "r")]
    a, n, left, right = exact
    with_score = met.withColumn("above", a * n * F.lit(1000).cast("decimal(4,0)")).withColumn(
        "below", left * right
    )
    with_score = with_score.withColumn("score", F.expr("above div below"))
    best = Window.partitionBy("lang", "phrase").orderBy("score", "cut")
    return (
        with_score.withColumn("place", F.row_number().over(best))
        .filter("place = 1")
        .select("lang", "phrase", "k", "a", "l", "r", "n", "score")
    )


def covered(counts: DataFrame) -> DataFrame:
    """lang, phrase, longest: the largest count of a phrase with one more word around it.

    That is enough: a longer phrase around this one that is as frequent has one of each length
    between, as frequent again, since counts never rise with length."""
    words = F.split("phrase", " ")
    longer = counts.filter("k >= 3")
    size = F.col("k") - 1
    parts = F.array(
        F.array_join(F.slice(words, F.lit(1), size), " "),
        F.array_join(F.slice(words, F.lit(2), size), " "),
    )
    return (
        longer.select("lang", "f", F.explode(parts).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longest"))
    )


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    most: int = MOST,
    route_suffixes: int = ROUTE_SUFFIXES,
    batch_chars: int = BATCH_CHARS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases."""
    words = stage(word_counts(docs, batch_chars), "phrase-words")
    single = words.filter("k = 1")
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    found = phrase_counts(docs, words, least, route_suffixes, batch_chars)
    counts = stage(single.filter(F.col("f") >= least).unionByName(found), "phrase-counts")
    kept = (
        scored(counts, totals)
        .join(covered(counts), ["lang", "phrase"], "left")
        .filter(F.col("longest").isNull() | (F.col("longest") < F.col("a")))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= most)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
