"""Projection search, Merkle manifest and phrase mining against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from netquarry.llm import merkle_manifest, phrase_mining, projection_search

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "tree string, place long, n long, path string, k int"
)
EXTRA = ("t", 7, 8, "p", 9)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ------------------------------------------------------------------ nearest neighbours


def brute(rows, k=10, step=100):
    """(query id, query vector) -> ids and distances, by all distances."""
    good = {}
    for vec_id, v in rows:
        if vec_id is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        if any(x != 0 for x in v):
            good[vec_id, tuple(np.float32(x) for x in v)] = np.array(v, dtype=np.float32)
    out = {}
    for (q, key), x in good.items():
        if q % step:
            continue
        near = []
        for (vec_id, other), y in good.items():
            if (vec_id, other) != (q, key) and len(other) == len(key):
                d = y.astype(np.float64) - x.astype(np.float64)
                near.append((float(np.sqrt((d * d).sum())), vec_id))
        out[q, key] = sorted(near)[:k]
    return out


def searched(spark, rows, **options):
    table = spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, leaf int, rank string"
    )
    got = defaultdict(list)
    for r in projection_search.neighbours(table, **options).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(found) for q, found in got.items()}


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    rows = [
        (i, [float(x) for x in centres[i % 12] + 0.4 * rng.normal(size=24)]) for i in range(3000)
    ]
    want = brute(rows)
    got = searched(spark, rows, leaf=200, block=64, part=150)
    hits = total = 0
    for (q, _), near in want.items():
        found = got[q]
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [s for _, _, s in found] == sorted(s for _, _, s in found)
        exact = {v: d for d, v in near}
        for _, v, s in found:
            assert v != q
            if v in exact:
                assert s == pytest.approx(exact[v], abs=1e-12)
        hits += len({v for _, v, _ in found} & set(exact))
        total += len(near)
    assert hits / total >= 0.9


def test_search_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(6)
    same = [float(x) for x in rng.normal(size=8)]
    rows = [(i, same) for i in range(300)]  # a third of the rows are one vector
    rows += [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300, 900)]
    rows += [(100, same), (300, rows[300][1])]  # repeated rows
    rows += [(200, [1.0] * 8)]  # an id with a second vector
    rows += [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [float("nan")] * 8)]
    rows += [(1400, [None] + [1.0] * 7), (1500, [float("inf")] * 8), (None, same), (None, None)]
    rows += [(1600, [1.0, 2.0]), (1601, [1.0, 2.5]), (1700, [1.0, 2.0, 3.0])]  # other lengths
    got = searched(spark, rows, leaf=100, block=32, part=64)
    assert set(got) == {*range(0, 900, 100), 1600}
    # equal distances go by id, wherever the copies lie
    assert [(v, s) for _, v, s in got[0]] == [(i, 0.0) for i in range(1, 11)]
    assert [(v, s) for _, v, s in got[100]] == [(i, 0.0) for i in range(10)]
    assert len(got[200]) == 20 and len(got[300]) == 10
    assert [(r, v) for r, v, _ in got[1600]] == [(1, 1601)]
    assert searched(spark, []) == {}
    assert searched(spark, [(0, [1.0, 0.0])]) == {}
    few = searched(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [(r, v) for r, v, _ in few[0]] == [(1, 2), (2, 1)]


def test_chi_square_law():
    rng = np.random.default_rng(1)
    x = rng.chisquare(8, 200_000)
    for p in (0.5, 0.9, 0.96):
        assert (x <= projection_search.chi_square_at(p, 8)).mean() == pytest.approx(p, abs=0.005)
    # squared projected distances over squared distances follow the same law
    planes = np.stack([np.random.default_rng(s).normal(size=(16, 8)) for s in range(4000)])
    v = rng.normal(size=16)
    ratio = ((v @ planes) ** 2).sum(axis=1) / (v @ v)
    assert (ratio <= projection_search.chi_square_at(0.9, 8)).mean() == pytest.approx(0.9, abs=0.02)


def test_tree_cells_hold_their_points():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(4000, 8))
    points[:1500] = points[0]
    tree = projection_search.fitted(points, 400_000, leaf=4000, part=20_000)
    leaf = tree.leaves(points)
    assert (points >= tree.low[leaf]).all() and (points <= tree.high[leaf]).all()
    assert tree.parts[leaf[0]] >= 150_000 // 20_000
    for p in points[::200]:
        gaps = np.maximum(np.maximum(tree.low - p, p - tree.high), 0)
        near = np.flatnonzero((gaps**2).sum(axis=1) <= 0.5)
        assert set(near) == set(tree.within(p, 0.5))
        d = ((points - p) ** 2).sum(axis=1)
        assert set(leaf[d <= 0.5]) <= set(near)


# ------------------------------------------------------------------ manifest


def sha(content):
    return hashlib.sha256(content.encode()).hexdigest()


def leaf_of(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def grow(digests):
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, place in enumerate(at):
            base = place // 8 * 8
            run = level[base : base + 8]
            proofs[i].append((run[: place - base], run[place - base + 1 :]))
            at[i] = place // 8
        level = [sha("".join(level[b : b + 8])) for b in range(0, len(level), 8)]
    return level[0], proofs


def manifest_of(rows):
    trees = defaultdict(list)
    for row in rows:
        low = None if row[1] is None else lowered(row[1])
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        own = leaf_of(row, row[1])
        trees[row[2]].append((row[0], own, leaf_of(row, low) if tampered else own))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        built[lang] = grow([t[1] for t in trees[lang]])
    if not langs:
        return []
    root, top = grow([built[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, top, strict=True):
        for (doc_id, own, folded), below in zip(trees[lang], built[lang][1], strict=True):
            path = below + above
            for before, after in path:
                folded = sha("".join(before) + folded + "".join(after))
            proof = sha("".join("".join(b) + "".join(a) for b, a in path))
            out.append((doc_id, own, built[lang][0], root, proof, folded, folded == root))
    return out


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)
    return [tuple(r) for r in merkle_manifest.manifest(docs).collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_manifest(spark):
    rng = random.Random(3)
    rows = []
    for i in range(700):
        lang = rng.choices(["en", "de", None, "", "fr", "é"], [6, 2, 1, 1, 1, 1])[0]
        text = rng.choice(["Some Text %d" % i, "plain", "", None, "Ünï Códe " * 50])
        rows.append((i, text, lang, rng.choice(["a", None]), rng.choice([i, None])))
    rows += rows[:5]  # repeated rows
    rows += [(3, "Other", rows[3][2], "a", 1), (None, "No Id", "en", None, None), (None, None, None, None, None)]
    rows += [(9000, "Lone", "zz", "s", 4), (9001, "X" * 300_000, "en", "s", 300_000), (-5, "Minus", "en", "s", 5)]
    got = manifest(spark, rows)
    assert order(got) == order(manifest_of(rows))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("size", [0, 1, 9, 65])
def test_manifest_of_one_language(spark, size):
    rows = [(i, f"Doc {i}", "en", "s", i) for i in range(size)]
    assert order(manifest(spark, rows)) == order(manifest_of(rows))


# ------------------------------------------------------------------ phrases


def phrases_of(rows, least, most):
    f, n = Counter(), Counter()
    for row in rows:
        lang = row[2] or "und" if row[2] is None else row[2]
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(row[1] or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    wanted = {x: c for x, c in f.items() if c >= least and len(x[1]) >= 2}
    gone = set()
    for (lang, words), c in wanted.items():
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                if b - a < len(words) and 100 * c >= 100 * f[lang, words[a:b]]:
                    gone.add((lang, words[a:b]))
    ranked = defaultdict(list)
    for (lang, words), a in wanted.items():
        if (lang, words) in gone:
            continue
        score, k = min(
            (1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k)
            for k in range(1, len(words))
        )
        ranked[lang].append(
            (" ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score)
        )
    out = []
    for lang, found in ranked.items():
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(found[:most])]
    return out


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)
    return [tuple(r) for r in phrase_mining.collocations(docs, **options).collect()]


def test_phrases(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["É", "Zwölf", " x", "a\x00b", "a_b"]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choice(["hot pair", rng.choice(words), rng.choice(words).upper()]))
            parts.append(rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ! ", "\x0b"]))
        rows.append((i, "".join(parts), rng.choice(["en", "de", None, "und", ""]), None, None))
    shared = "One Passage of seven words stands everywhere."
    rows += [(i, shared, "en", "s", 1) for i in range(150)]
    rows += [(1, None, "en", None, None), (2, "", "en", None, None), (None, "..,;", None, None, None)]
    rows.append((3, "same same " * 20_000, "fr", "s", 1))  # a long text of one word
    want = phrases_of(rows, 10, 2000)
    assert len(want) > 50
    assert sorted(mined(spark, rows, least=10)) == sorted(want)
    # many routes, many batches, frequent first words over many routes
    small = {"least": 10, "route_suffixes": 400, "batch_chars": 2000}
    assert sorted(mined(spark, rows, **small)) == sorted(want)
    assert sorted(mined(spark, rows, least=10, most=7)) == sorted(phrases_of(rows, 10, 7))


def test_phrases_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, None, None, None, None), (2, " . ", "en", None, None)], least=1) == []
    assert mined(spark, [(1, "a b", "en", None, None)], least=1) == [
        ("en", 1, "a b", 1, 1, 1, 2, 2000)
    ]
