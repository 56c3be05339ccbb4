"""Line groups, SimHash, vectors and components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netquarry.llm import line_dedup, nn_descent, simhash_gray
from netquarry.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    links += [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2060)]
    links += [(5, 5), (None, 3), (None, None)]
    union = Union()
    for a, b in links:
        if a is not None and b is not None and a != b:
            union.join(a, b)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {x: union.find(x) for x in list(union.parent)}
    assert len(got) == len(union.parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(7)
    rows, number = [], 0
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(1, 300))]
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = "Other"
            rows.append((number, " ".join(words), "x", number))
            number += 1
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, " \n", "x", 1), rows[3]]
    rows += [(None, "quite alone here", "x", 1), (903, "É É É É É", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, id long")


def test_simhash_groups(near):
    rows = [(r.doc_id, fingerprint(r.text or "")) for r in near.collect()]
    union = Union()
    for a, x in rows:
        if a is None:
            continue
        union.find(a)
        for b, y in rows:
            if b is not None and (x ^ y).bit_count() <= 4:
                union.join(a, b)
    for r in simhash_gray.near_duplicates(near).collect():
        assert (r.doc_id, int(r.fingerprint, 16)) in rows
        assert r.component_id == (None if r.doc_id is None else union.find(r.doc_id))
    kept = [r.doc_id for r in simhash_gray.representatives(near).collect()]
    roots = {union.find(a) for a, _ in rows if a is not None}
    assert sorted(k for k in kept if k is not None) == sorted(roots) and None in kept
    assert simhash_gray.near_duplicates(near.filter("doc_id < 0")).count() == 0


def test_representatives_tell_texts_of_one_id_apart(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [
        (5, one, 1), (5, two, 2), (5, one, 1), (7, one, 3), (None, two, 4), (None, "by itself", 5),
        (None, "by itself", 5), (9, None, 6), (8, "", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id long").withColumn("a.b", F.lit(1))
    kept = simhash_gray.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.kept_id for r in kept.collect()) == [1, 2, 5, 7]
    assert simhash_gray.representatives(docs.filter("doc_id < 0")).count() == 0


def test_gray_index_and_tiles(spark):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for _ in range(3):
        flips = np.uint64(1) << rng.integers(0, 64, (len(codes), 2)).astype(np.uint64)
        codes = np.unique(np.concatenate([codes, codes ^ flips[:, 0], codes ^ flips.sum(axis=1)]))
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    close = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    got = set()
    for a, b in simhash_gray.linked(codes, None, 4):
        got |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1))), strict=True))
    union = Union()
    for a, b in got:
        union.join(a, b)
    rows = [(int(c), i) for i, c in enumerate(codes.view(np.int64))]
    table = spark.createDataFrame(rows, "fp long, id long").cache()
    for tile in (7, 2048):  # many tiles to a group, and one
        found = Union()
        for r in simhash_gray.fingerprint_links(table, 4, tile).collect():
            found.join(r.a, r.b)
        assert {x: found.find(x) for x in found.parent} == {x: union.find(x) for x in union.parent}


def test_agreeing_masks_cover_every_pair():
    rng = random.Random(5)
    for n in (10, 10**6, 10**9):
        masks = simhash_gray.agreeing(n, 4)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows, number = [], 0
    for label in (0, 1):
        for _ in range(60):
            base = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 6))):
                v = base + rng.normal(size=16) * 0.08
                rows.append((number, [float(x) for x in v], label, 1))
                number += 1
    centre = rng.normal(size=16)
    for _ in range(150):  # more than a list holds
        v = centre + rng.normal(size=16) * 0.03
        rows.append((number, [float(x) for x in v], 0, 1))
        number += 1
    rows += [(number + i, rows[0][1], 0, 1) for i in range(4)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows += [(5000 + i, v, 0, 1) for i, v in enumerate(odd)]
    rows += [(6000, rows[0][1], None, 1), (6001, rows[0][1], None, 1), rows[7]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n int")


def test_vectors(vectors):
    rows = vectors.collect()

    def unit(r):
        v = r.embedding
        if r.label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            return None
        return np.array(v) / np.linalg.norm(v) if any(v) else None

    units = [unit(r) for r in rows]
    links, union = defaultdict(int), Union()
    for i, a in enumerate(rows):
        union.find(a.vec_id)
        for j, b in enumerate(rows):
            x, y = units[i], units[j]
            if i == j or a.label != b.label or x is None or y is None or len(x) != len(y):
                continue
            if x @ y >= 0.98:
                links[i] += 1
                union.join(a.vec_id, b.vec_id)
    want = sorted((r.vec_id, links[i], union.find(r.vec_id)) for i, r in enumerate(rows))
    got = nn_descent.near_vectors(vectors, tile=64).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert nn_descent.near_vectors(vectors.filter("vec_id < 0")).count() == 0


def test_vectors_without_an_id_link(spark):
    x, y, z = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5], [-1.0, 0.0, 4.0]
    rows = [(-4, x, 1), (None, x, 1), (None, [1.0, 2.0, 3.01], 1), (None, y, 1), (None, y, 1), (-2, z, 1), (None, z, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = nn_descent.near_vectors(table).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (-4, 2, -4, True), (-2, 0, -2, True), (0, 0, 0, True), (0, 1, 0, True), (0, 1, 0, True),
        (0, 2, -4, True), (0, 2, -4, True),
    ]


def test_an_audit_below_the_least_recall_raises(vectors, monkeypatch):
    monkeypatch.setattr(nn_descent, "recall", lambda links, groups: 0.9)
    with pytest.raises(RuntimeError, match="recall"):
        nn_descent.near_vectors(vectors.limit(20), seedings=1)


def test_recall_counts_small_groups_like_dense_ones(spark):
    dense = [(1, k) for k in range(100, 199)]
    links = spark.createDataFrame([*dense, (2, 3)], "a long, b long")
    groups = spark.createDataFrame([(1, 1), *((k, 1) for _, k in dense)], "id long, component long")
    assert nn_descent.recall(links, groups) == 0.5
    assert nn_descent.recall(links.limit(0), groups) == 1.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_groups(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(12)]
    texts = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(base).split()
            if rng.random() < 0.6:
                words[rng.randrange(40)] = rng.choice(WORDS)
            line = " ".join(words)
            lines.append(line.upper() + " " if rng.random() < 0.2 else line)
        texts.append("\n".join(lines + [""] * (i % 2)))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(50, None, "x"), (51, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")

    found = line_dedup.fingerprinted(docs).collect()
    lines = {(r.doc_id, r.line_no): r.fp for r in found}
    norm = {
        (d, n): line.lower().strip()
        for d, t in enumerate(texts)
        for n, line in enumerate(t.split("\n"))
        if line
    }
    assert set(lines) == set(norm)
    union = Union()
    for a in lines:
        union.find(a)
        for b in lines:
            longer = max(len(norm[a]), len(norm[b]))
            near = ((lines[a] ^ lines[b]) & (2**64 - 1)).bit_count() <= line_dedup.RADIUS
            if a < b and near and distance(norm[a], norm[b]) <= int(0.2 * longer):
                union.join(a, b)
    got = line_dedup.occurrences(docs).collect()
    want = {a: union.find(a) for a in lines}
    assert {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in got} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc, r.class_line)) for r in got)
    assert len(set(want.values())) < len(set(norm.values()))

    kept = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    assert line_dedup.deduplicated(docs).columns == docs.columns
    for d, t in enumerate(texts):
        stay = [
            line for n, line in enumerate(t.split("\n")) if not line or want[d, n] == (d, n)
        ]
        assert kept[d] == "\n".join(stay)
    assert kept[50] is None and kept[51] == ""
    assert line_dedup.occurrences(docs.filter("doc_id < 0")).count() == 0


def test_long_lines_use_wide_counters(spark):
    text = "apple a berry c citron " * 10000
    docs = spark.createDataFrame([(1, text), (2, "apple a berry c citron " * 10)], "doc_id long, text string")
    rows = {r.doc_id: r.fp for r in line_dedup.fingerprinted(docs).collect()}
    assert rows[1] == rows[2]


def test_line_recall_against_edit_similarity_alone(spark):
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 12)))
    kinds, lines = [], []
    for n in (1, 6, 8, 10, 20, 30, 40):
        for kind in ("typo", "word", "typos"):
            for _ in range(25):
                words = [word() for _ in range(n)]
                if n == 1:  # one token
                    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(30, 300)))]
                line = " ".join(words)
                if kind == "word" and n > 1:
                    words[rng.randrange(n)] = word()
                    other = " ".join(words)
                else:
                    other = list(line)
                    for _ in range(1 if kind == "typo" else max(2, len(line) // 40)):
                        other[rng.randrange(len(other))] = rng.choice(letters)
                    other = "".join(other)
                if line != other and distance(line, other) <= len(line) // 5:
                    kinds.append((n, kind))
                    lines += [line, other]
    rows = [(i, line) for i, line in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.doc_id: r.class_doc for r in line_dedup.occurrences(docs).collect()}
    found = defaultdict(list)
    for i, kind in enumerate(kinds):
        assert first[2 * i] == 2 * i and first[2 * i + 1] in (2 * i, 2 * i + 1)
        found[kind].append(first[2 * i + 1] == 2 * i)
    shares = {k: sum(v) / len(v) for k, v in found.items()}
    print("recall", sum(map(sum, found.values())), len(kinds), shares)
    # several typos in a long line are the hardest: most of its word pairs change (see README)
    assert sum(map(sum, found.values())) >= 0.95 * len(kinds), shares
    assert min(v for (_, kind), v in shares.items() if kind != "typos") >= 0.8, shares


def test_allowed_edits_are_whole_fifths(spark):
    docs = spark.createDataFrame([(1, "abcde" * 7), (2, "abcde" * 6 + "abcxx")], "doc_id long, text string")
    sizes = docs.select(line_dedup.edits(F.length("text")).alias("n")).collect()
    assert [r.n for r in sizes] == [7, 7]


def test_no_word_of_a_line_is_left_out_of_its_hash(spark):
    long = " ".join(f"extraordinary{i}" for i in range(3))
    texts = [long + " " + " ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = (r.fp for r in line_dedup.fingerprinted(docs).collect())
    assert ((a ^ b) & (2**64 - 1)).bit_count() > 10
