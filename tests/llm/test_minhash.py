import random
import re

import pytest
from conflux.llm import minhash, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, shingles(t, size))
    ids, parent = sorted(sets), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    for d in ids:
        near = {}
        for s in sets[d]:
            for o in holders[s]:
                if o < d:
                    near[o] = near.get(o, 0) + 1
        for o, n in near.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = root(o), root(d)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op1_minhash(spark, sf).collect()}
    assert got == brute(rows, 4, 80)


def test_edge_cases(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "one two", 0), (5, "ONE\ttwo", 0), (6, "two one", 0), (7, "x", 0), (8, "x", 0), (8, "x", 0)]
    rows += [(100 + i, " ".join(base[: 100 + i]), 1) for i in range(20)]
    rows += [(200 + i, " ".join([*base[:i], "edit", *base[i + 1 :]]), 1) for i in range(40)]
    rows += [(900, "a " * 300_000 + "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 4, 80).collect())
    want = brute([(d, t) for d, t, _ in rows], 4, 80)
    assert got == sorted((d, *want[d]) for d, _, _ in rows)


def test_families_far_from_the_pivot(spark, monkeypatch):
    """Near copies that meet an unrelated smaller id in all of their buckets, classes of many members, repeated ids."""
    monkeypatch.setattr(minhash, "HOT", 3)
    monkeypatch.setattr(minhash, "HOT_CLASSES", 30)
    rnd = random.Random(11)
    one, two = ([f"w{rnd.randrange(10**6)}" for _ in range(100)] for _ in range(2))
    mixed = [*one[:60], *two[:60]]  # near neither family
    rows = [(0, " ".join(mixed)), (1, " ".join(one[:60] + one[:40]))]
    rows += [(10 + i, " ".join([*one[:i], f"e{i}", *one[i + 1 :]])) for i in range(30)]
    rows += [(50 + i, " ".join([*two[:i], f"e{i}", *two[i + 1 :]])) for i in range(30)]
    rows += [(100 + i, "copy of one text here") for i in range(40)]
    rows += [(7, " ".join(two)), (7, "another text of the same id altogether")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 4, 80).collect()}
    plain = brute([r for r in rows if r[0] != 7] + [(7, " ".join(two))], 4, 80)
    assert got == {d: c for d, (_, c, _) in plain.items()}


def test_copies_go_and_columns_may_clash(spark):
    names = ["doc_id", "text", "_kept", "_row", "_id", "n", "kept", "spot"]
    rows = [(1, "a b c d e f g", 1), (2, "a b c d e f g", 2), (3, None, 3), (4, "", 4), (None, "x", 5), (None, "x", 6), (5, "q r s t u v", 7), (5, "h i j k l m", 8), (6, "z z z z z z z", 9)]
    docs = spark.createDataFrame([(d, t, *[k] * 6) for d, t, k in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names[2:]))
    got = minhash.deduplicated(docs)
    assert got.columns == names
    assert sorted(r.kept for r in got.collect()) == [1, 3, 4, 5, 6, 8, 9]
    assert minhash.deduplicated(docs.limit(0)).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0


def test_chain_grouping(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 90), (300, 301), (302, 301)]
    edges = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long").repartition(7)
    got = {r.member: r.component for r in minhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 100: 90, 300: 300, 301: 300, 302: 300}


@pytest.mark.parametrize("n", [1, 3, 40, 400])
def test_signature_estimates_similarity(n):
    import numpy as np

    rnd = np.random.default_rng(n)
    shared, a, b = (rnd.integers(0, 2**63, size=k, dtype=np.int64).astype(np.uint64) for k in (n, n // 4, n // 4))
    sets = np.concatenate([np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b]))])
    sig = minhash.super_minhash(sets, np.array([0, n + n // 4, 2 * (n + n // 4)]))
    assert abs((sig[0] == sig[1]).mean() - n / (n + 2 * (n // 4))) < 0.2
