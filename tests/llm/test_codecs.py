"""Encoders, chunk reuse, ORC files and packing against the tokenizers library and plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import chunk_codec, packing, token_orc
from netquarry.llm.encoders import ByteLevel, Reference, WordEnd, resolve
from netquarry.llm.staging import stage_path

TRICKY = list("ab'sS t\n\r\t!.,0é1ßıİΣ中\x1c\x85\xa0—A") + [
    "<|endoftext|>", "'ll", "'re", "  ", " \n", "Ünï", "̀", "​", "word", "ĳ",
]
DDL = "doc_id long, text string, lang string, source string, n_chars long, ids string, part int"


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(TRICKY) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Ordinary rows, rows with nulls and ties, and columns whose names clash with the operators'."""
    shared = "a passage that stands in several documents, word for word. " * 40
    texts = [
        None, "", " ", "x", shared, shared, "before " + shared + " after", "q" * 20000,
        "long " * 9000, *random_texts(60),
    ]
    rows = [(i, t, None, None, None, "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL)


@pytest.mark.parametrize(
    ("kind", "name"), [(ByteLevel, "byte_bpe_50k.json"), (WordEnd, "word_bpe_49k.json")]
)
def test_encoders_match_the_library(kind, name):
    encoder = kind(resolve(name))
    for text in [*random_texts(4000), "", "<|endoftext|>"]:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == encoder.ids(text), text


def test_known_pieces_are_merged_once():
    encoder, seen = WordEnd(resolve("word_bpe_49k.json")), []
    merge = encoder.merger._encode_single_piece
    encoder.merger._encode_single_piece = lambda piece: seen.append(piece) or merge(piece)
    text = "Straße straße. STRASSE ab1 ab2 ab12, l'été it's ŉı İx \u01c5 <|endoftext|>ab ª½ ab\u0301"
    ids = np.frombuffer(encoder.encode(text), dtype="<u2").tolist()
    assert ids == encoder.ids(text)
    assert len(seen) == len(set(seen)) and b"ab\xff" in seen


def test_chunks_move_with_their_text():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(20000))
    a, b = chunk_codec.chunk_texts(base), chunk_codec.chunk_texts("some other start. " + base)
    assert "".join(a) == base
    assert len(set(a) & set(b)) >= len(a) - 2
    assert max(map(len, chunk_codec.chunk_texts("z" * 50000))) <= chunk_codec.MOST


def test_stitch_is_exact():
    encoder = ByteLevel(resolve("byte_bpe_50k.json"))
    rng = random.Random(5)
    for text in random_texts(2000, seed=9):
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(4))
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        got = chunk_codec.stitch([(p, encoder.encode(p)) for p in parts], encoder.encode)
        whole = text.split("<|endoftext|>")
        if len(whole) == 1:
            assert got == encoder.encode(text), parts


def test_round_trip(corpus):
    ref = Reference(resolve("byte_bpe_50k.json"))
    want = []
    for r in corpus.collect():
        ids, text = ref.ids(r.text or ""), r.text or ""
        listed = ",".join(map(str, ids))
        want.append(
            (str(r.doc_id), len(ids), hashlib.sha256(listed.encode()).hexdigest(),
             hashlib.sha256(text.encode()).hexdigest())
        )
    got = chunk_codec.round_trip(corpus).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == sorted(want)
    assert sum(r.n_reused for r in got) > 0
    assert chunk_codec.round_trip(corpus.filter("doc_id < 0")).count() == 0


def test_decode(corpus):
    back = chunk_codec.decode_documents(chunk_codec.encode_documents(corpus))
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted(
        (str(r.doc_id), r.text or "") for r in corpus.collect()
    )


def test_orc_digests(spark, corpus):
    ref = Reference(resolve("word_bpe_49k.json"))
    path = stage_path(spark, "test", "orc")
    got = token_orc.store_and_read(corpus, path).collect()
    texts = defaultdict(list)
    for r in corpus.collect():
        texts[r.doc_id].append(r.text or "")
    position = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = np.array(ref.ids(texts[r.doc_id].pop()) + [1], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (position, len(ids), zlib.crc32(ids.tobytes()))
        position += len(ids)
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert known[1:] == sorted(known[1:]) and known[0] is None
    one = token_orc.read_tokens(spark, path).filter(F.col("doc_id") == 8)
    assert len(one.collect()) == 1
    assert "EqualTo(doc_id,8)" in one._jdf.queryExecution().toString()
    assert token_orc.store_and_read(corpus.filter("doc_id < 0")).count() == 0


def check_fill(histogram, window):
    places, windows = packing.fill_windows(dict(histogram), window)
    held = defaultdict(list)
    for p in places:
        for rank in range(p.low, p.high):
            i = rank - p.low + p.skip
            held[p.sequence + i // p.each].append((p.offset + i % p.each * p.length, p.length))
    assert sorted(held) == list(range(windows))
    assert sum(n for v in held.values() for _, n in v) == sum(k * v for k, v in histogram.items())
    for v in held.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= window
    return sum(window - sum(n for _, n in v) for v in held.values())


def test_fill_leaves_at_most_one_window_short():
    rng = random.Random(2)
    for _ in range(60):
        window = rng.choice([16, 64, 2048])
        n = rng.randrange(1, 12)
        histogram = {rng.randrange(1, window): rng.randrange(1, 300) for _ in range(n)}
        assert check_fill(histogram, window) < window
    assert packing.fill_windows({}, 2048) == ([], 0)


def test_best_fill_is_the_best():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        capacity = rng.randrange(1, 60)
        sums = {0}
        for length, n in counts.items():
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= capacity}
        fill = packing.best_fill(counts, capacity)
        assert sum(k * v for k, v in fill.items()) == max(sums)
        assert all(counts[k] >= v for k, v in fill.items())


def test_pack(corpus):
    ref = Reference(resolve("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in corpus.collect()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack(corpus).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, found in pieces.items():
        ids = np.array(ref.ids(texts[doc_id]) + [1], dtype="<u4")
        assert sum(r.length for r in found) == len(ids) * (2 if doc_id == 4 else 1)
        for r in found:
            own = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids)
    for found in windows.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    assert packing.pack(corpus.filter("doc_id < 0")).count() == 0
