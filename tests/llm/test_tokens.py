import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from warpspark.llm import bpe, packing, token_counts

PATH = bpe.default_vocabulary()
SAMPLES = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "don't", "é", "日本", "ñ", "’", "1", "123", "$", "!!", "<|endoftext|>", "🙂", "\r\n", "\x1c", "²", "ab" * 30, "_", "foo.", "bar,"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def mixed(n, seed):
    rng = random.Random(seed)
    words = lambda: "".join(rng.choice("abcdefghéñ") for _ in range(rng.randint(1, 14)))
    return ["".join(rng.choice(SAMPLES) if rng.random() < 0.5 else rng.choice([" ", "\n", ""]) + words() for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("make", [bpe.encoder, bpe.ranked_encoder])
def test_ids_are_the_merges(reference, make):
    enc = make(PATH)
    texts = mixed(3000, 1) + ["", "x" * 5000, "word " * 3000]
    for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(enc.encode(text.encode()), "<u4")
        assert ids.tolist() == want.ids, text
        assert enc.vocabulary.decode(ids).decode() == text


def test_caches_stay_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    enc = bpe.Encoder(PATH)
    text = " ".join(f"w{i}x" for i in range(500))
    assert np.frombuffer(enc.encode(text.encode()), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
    assert len(enc.words) <= 50 and len(enc.words.older) <= 50


CASES = [(0, "Hello there.\nSecond line"), (1, None), (2, ""), (3, "Hello there.\nSecond line"), (4, "é " * 20000), (5, "<|endoftext|> x\n\n y ")]


def test_codec_query(docs, reference):
    got = {r["doc_id"]: r for r in bpe.digest_documents(docs(CASES)).collect()}
    for i, text in CASES:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        back = reference.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    full = {r["doc_id"]: r for r in bpe.encode_documents(docs(CASES[:3])).collect()}
    assert full[0]["decoded"] == CASES[0][1] and full[1]["ids"] == []
    assert bpe.digest_documents(docs([])).count() == 0


def test_token_counts(docs, reference):
    rows = token_counts.count_tokens(docs(CASES)).collect()
    for i, text in CASES:
        text = text or ""
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["section"])
        enc = reference.encode(text, add_special_tokens=False)
        starts = [0] + [k + 1 for k, c in enumerate(text) if c == "\n"]
        assert [r["start"] for r in mine] == starts and mine[-1]["end"] == len(text)
        want = [0] * len(starts)
        for a, _ in enc.offsets:
            want[sum(s <= a for s in starts) - 1] += 1
        assert [r["n_tokens"] for r in mine] == want and all(r["doc_tokens"] == len(enc.ids) for r in mine)
    assert token_counts.count_tokens(docs([])).count() == 0


def test_token_counts_of_given_sections(spark):
    df = spark.createDataFrame([(0, "ñandú corre mucho", [0, 3, 99, None, 6]), (1, None, None)], "doc_id long, text string, cuts array<int>")
    rows = token_counts.count_tokens(df, sections="cuts").orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in rows] == [(0, 0, 3), (0, 3, 6), (0, 6, 17), (1, 0, 0)]
    assert sum(r["n_tokens"] for r in rows[:3]) == rows[0]["doc_tokens"]


def test_repeated_and_nameless_rows_are_encoded_each(docs):
    rows = docs([(7, "same text"), (7, "same text"), (7, "other"), (None, "no name"), (None, None)])
    assert bpe.digest_documents(rows).count() == 5
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.count_tokens(rows).collect()) == [(0, 0), (0, 2), (7, 1), (7, 2), (7, 2)]
    packed = packing.pack_documents(rows).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in packed) == [(0, 1), (0, 3), (7, 2), (7, 3), (7, 3)]
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == 5


def test_packing(docs, reference):
    cases = CASES + [(10 + i, "word " * (7 * i % 300)) for i in range(400)]
    rows = [r.asDict() for r in packing.pack_documents(docs(cases)).collect()]
    for i, text in cases:
        ids = np.array(reference.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in mine:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(windows) <= total / 1024 * 1.01 + 8  # at most a partly filled window for each of the few tasks
    assert packing.pack_documents(docs([])).count() == 0


def test_differencing():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 257, 600)
    at = packing.difference(sizes, 75)
    sums = np.bincount(at, weights=sizes, minlength=75)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 8


def test_packing_cuts_only_what_is_needed():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 1024, 250), np.full(9, 600), np.full(3, 1023), np.array([1024] * 4), np.array([700, 340]), rng.integers(1, 3, 2000), np.array([5])):
        pieces = packing.pack(sizes.astype(np.int64), 1024)
        spans = {}
        for window in pieces:
            assert 0 < sum(n for *_, n in window) <= 1024
            for item, start, n in window:
                assert n >= min(packing.LEAST, sizes[item])
                spans.setdefault(item, []).append((start, n))
        for item, size in enumerate(sizes):
            at = 0
            for start, n in sorted(spans[item]):
                assert start == at
                at += n
            assert at == size
        assert len(pieces) <= -(-int(sizes.sum()) // 1024) + 1
    assert sum(map(len, packing.pack(rng.integers(1, 1024, 250), 1024))) < 400
    # Nothing may be cut: the windows rise until all fit.
    assert len(packing.pack(np.full(9, 600), 1024, whole=set(range(9)))) == 9
    assert [sum(x) for x in (lambda s: [[s[i] for i in of] for of in packing.bundles(s, 64)])([1, 2, 63, 100, 1, 64])] == [3, 64, 100, 64]


def test_many_tiny_rests_are_small_tables():
    sizes = [1] * 131_072
    items = packing.bundles(sizes, packing.TINY)
    assert len(items) == 2048 and max(map(len, items)) == 64
