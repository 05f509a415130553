import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conflux.llm import packing, queries
from conflux.llm import textcore as tc
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def encode(text, tokenizer):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_layout(rows, capacity=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    tokenizer = Tokenizer.from_file(PATH)
    rows = queries.op8_packing(spark, sf).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(encode(d.text, tokenizer), dtype="<u4")
        want = [(k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted(got[d.doc_id]) == want
    bins = check_layout(rows)
    assert bins <= packing.lower_bound(np.array([r.length for r in rows])) + 1


def exact_bins(lengths, capacity):
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in {f: j for j, f in enumerate(free) if f >= lengths[i]}.values():
            place(i + 1, [f - lengths[i] * (j == k) for j, f in enumerate(free)])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best


def test_bounds_hold():
    rnd = random.Random(4)
    for _, hard in itertools.product(range(150), (False, True)):
        capacity = 24
        lengths = sorted((rnd.randint(7, 13) if hard else rnd.randint(1, capacity) for _ in range(rnd.randint(1, 8))), reverse=True)
        best = exact_bins(lengths, capacity)
        bins, offsets = packing.best_fit(np.array(lengths), capacity)
        assert packing.lower_bound(np.array(lengths), capacity) <= best <= bins.max() + 1
        for b in range(bins.max() + 1):
            at = 0
            for o, n in sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b)):
                assert o == at
                at += n
            assert at <= capacity


@pytest.mark.parametrize("part", [40, 10_000])
def test_exchange_keeps_every_piece(spark, part):
    rnd = random.Random(9)
    rows = [(i % 90, i, 0, rnd.choice([700, 1100, 1400, 1500, 2100, 2700, 4096, 5]), i) for i in range(600)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    got = packing.packed(pieces, part=part).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(rows)
    bins = check_layout(got)
    assert bins <= packing.lower_bound(np.array([r[3] for r in rows])) * 1.08 + 2


def test_edge_cases(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [None, "", " \n ", "Hello, World's  e\u0301t\u00e9 don't 12 345 \u00a0x ÀÉ", "<|endoftext|> and <|startoftext|>x", "word " * 5000, "%%%&&& ¡ñ¿", "İstanbul ΣΑΣ", "Hello, World's  e\u0301t\u00e9"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    pieces = packing.tokenised(docs, PATH, with_ids=True).collect()
    got = {}
    for r in sorted(pieces, key=lambda r: (str(r.doc_id), r.piece)):
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        if r.doc_id != 3:
            got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {d: encode(t, tokenizer) for d, t, _ in rows if d != 3}
    assert len(pieces) == 11 + 1
    packed = packing.packed(packing.tokenised(docs, PATH)).collect()
    assert len(packed) == 12
    check_layout(packed)
    assert packing.packed(packing.tokenised(docs.limit(0), PATH)).count() == 0


def test_hard_mix_meets_its_bound(spark):
    for n in (600, 4000):
        rnd = random.Random(9)
        rows = [(0, 0, 0, rnd.choice([700, 1100, 1400, 1500, 2100, 2700, 4096, 5]), 0) for _ in range(n)]  # one row repeated
        got = packing.packed(spark.createDataFrame(rows, packing.PIECES)).collect()
        assert check_layout(got) == packing.lower_bound(np.array([r[3] for r in rows]))
        assert {(r.part_bins, r.part_bound) for r in got} == {(got[0].part_bins, got[0].part_bins)}


def test_repacking_saves_bins():
    """Groups of three that fill a bin exactly; best fit decreasing misses many of them."""
    rnd = random.Random(5)
    lengths = []
    for _ in range(120):
        a, b = rnd.randint(1030, 1600), rnd.randint(1030, 1300)
        lengths += [a, b, 4096 - a - b]
    lengths = np.array(lengths)
    first = packing.best_fit(lengths)[0]
    better = packing.improved(lengths, first, packing.lower_bound(lengths), 1)
    assert np.bincount(better, weights=lengths).max() <= 4096 and len(np.unique(better)) == better.max() + 1
    assert 120 <= better.max() + 1 < first.max() + 1


def test_words_are_forgotten():
    encoder, tokenizer = packing.WordEncoder(PATH, held=200, recent=60), Tokenizer.from_file(PATH)
    for k in range(8):
        text = " ".join(f"w{k * 30 + i} x{i}" for i in range(40))
        _, _, texts = next(tc.chunks(pa.array([text])))
        assert encoder(texts)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.ids.n <= 200 + 60 + 80


def test_ids_of_odd_texts():
    encoder, tokenizer = packing.WordEncoder(PATH, held=2000, recent=60), Tokenizer.from_file(PATH)
    rnd = random.Random(8)
    pieces = ["J\u030c", "j\u030c", "A\u0301", "q\u0301", "\u0130", "\u03a3", "\u212a", "\u00d7", "\u00f7", "\u00a0", "'s", "'S", "'re", ".", ",", "...", "!?", "<|endoftext|>", "<|startoftext|>", "\u00c9", "\u0149", "\u0105", "\ufb01", "\u4e2d", "\u0660", "5", "42", "ab", "The", "&&", "\"", "-", "\u2019", "\u200b", "\ud55c", "\u1112\u1161", "\U0001f600", "\x01", " ", " ", "\n"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    _, _, column = next(tc.chunks(pa.array(texts), 1 << 40))
    ids, bounds = encoder(column)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_two_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(tc.SpanHash, "__call__", lambda self, start, end: (end - start).astype(np.uint64))
    encoder, tokenizer = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ("abc", "abc abd xyz", "zzz"):
        _, _, texts = next(tc.chunks(pa.array([text])))
        assert encoder(texts)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
