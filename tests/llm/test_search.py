import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conflux.llm import queries, search

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, asked, k):
    """BM25 over all documents, straight from the formula."""
    bags = [(d, Counter(words(t))) for d, t in docs if d is not None]
    lengths = [sum(b.values()) for _, b in bags]
    mean = sum(lengths) / max(len(bags), 1)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for q, text in asked:
        weight = {t: n * math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) for t, n in Counter(words(text)).items()}
        scores = []
        for (d, bag), length in zip(bags, lengths, strict=True):
            s = sum(w * bag[t] * (search.K1 + 1) / (bag[t] + search.K1 * (1 - search.B + search.B * length / mean)) for t, w in weight.items() if t in bag)
            if s > 0:
                scores.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def check(rows, want):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    assert set(got) == {q for q in want if want[q]}
    for q, hits in got.items():
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
        assert [h[2] for h in hits] == pytest.approx([s for _, s in want[q]], abs=5e-6)
        by_score = {}
        for d, s in want[q]:
            by_score.setdefault(round(s, 3), set()).add(d)
        last = round(want[q][-1][1], 3)
        assert all(d in by_score.get(round(s, 3), ()) or round(s, 3) == last for _, d, s in hits)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries.op7_search(spark, sf).collect(), brute(docs, [d for d in docs if d[0] % 50 == 0], search.K))


@pytest.mark.parametrize(("k", "shard"), [(1, 10**9), (5, 300), (40, 2000)])
def test_pruning_and_merging_are_exact(spark, monkeypatch, k, shard):
    monkeypatch.setattr(search, "SHARD_WORDS", shard)
    monkeypatch.setattr(search, "ASKED", 4)  # two blocks of queries
    rnd = random.Random(k)
    vocabulary = [f"t{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 20, 80])))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(search.top_k(df, df.where("doc_id % 50 = 0"), k).collect(), brute(docs, [d for d in docs if d[0] % 50 == 0], k))


@pytest.mark.parametrize("seed", [1, 2])
def test_a_shard_skips_blocks_and_stays_exact(seed):
    """Thresholds up to the k-th best score itself lose nothing, ties at that place included."""
    rnd = random.Random(seed)
    vocabulary = [f"t{int(rnd.paretovariate(0.8))}" for _ in range(300)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([3, 20, 80, 200]))) for _ in range(700)]
    texts[100:130] = [texts[100]] * 30
    docs = list(enumerate(texts))
    parts = list(search._indexed(pa.array(texts), pa.array(range(len(texts)))))
    assert len(parts) == 1
    ids, owner, h, tf, length = parts[0]
    shard = search.Shard(ids, owner, h, tf, length, length.mean())
    n = len(texts)
    for q in range(90, 140):
        own, terms, count = owner == q, h[owner == q], tf[owner == q]
        assert own.any()
        df = np.array([(h == t).sum() for t in terms])
        weight = count * np.log(1 + (n - df + 0.5) / (df + 0.5))
        want = [(d, s) for d, s in brute(docs, [docs[q]], 10)[q]]
        for least in (0.0, want[-1][1] * 0.7, want[-1][1]):
            d, s = shard.top(shard.places(terms), weight, 10, least)
            assert s == pytest.approx([x for _, x in want], abs=5e-6)
            if 100 <= q < 130:
                assert ids[d].tolist() == list(range(100, 110))


def test_edge_cases(spark):
    rows = [(0, None), (50, ""), (100, "only here"), (1, "a b"), (2, "a b"), (2, "a b"), (None, "a b c"), (150, "a"), (200, "ONLY " * 100_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = search.top_k(docs, docs.where("doc_id % 50 = 0"), 3).collect()
    check(got, brute(rows, [(d, t) for d, t in rows if d is not None and d % 50 == 0], 3))
    assert search.top_k(docs.limit(0), docs.limit(0)).count() == 0
