import hashlib
import zlib

import pytest
from conflux.llm import merkle, oracles, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    for level in tree[:-1]:
        if i ^ 1 < len(level):
            yield i & 1, level[i ^ 1]
        i >>= 1


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([lf for _, _, lf in sorted((r[0] is not None, r[0] or 0, leaf(*r)) for r in rows if r[2] == x)]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        own = sorted(((r[0] is not None, r[0] or 0, leaf(*r)), r) for r in rows if r[2] == x) if None not in {r[0] for r in rows} else sorted(((r[0] is not None, r[0] or 0, leaf(*r)), repr(r), r) for r in rows if r[2] == x)
        for i, (*_, r) in enumerate(own):
            siblings = [*way(trees[x], i), *way(top, n)]
            lf = leaf(*r)
            told = leaf(r[0], r[1], r[2], r[3], r[4] + 1) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else lf
            folded = told
            for left, node in siblings:
                folded = h(node, folded) if left else h(folded, node)
            out.append((r[0], lf, trees[x][-1][0], top[-1][0], h(*(node for _, node in siblings)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def audited(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = queries.op12_merkle(spark, "")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2}, {"en": 1, "de": 5, None: 3}, {"en": 37, "de": 16, "é": 17, None: 9, "a": 4}, {"en": 70}])
def test_trees_of_several_tiers(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "TIER", 2)
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7919 % 1000, f"text {i}", lang, "src", i))
            i += 1
    assert audited(spark, rows, monkeypatch) == brute(rows)


def test_defined_cases(spark, monkeypatch):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (1, "née", "en", None, 2**63 - 1), (1, "née", "en", None, 2**63 - 1), (1, "other", "en", "s", 3), (-5, "x" * 100_000, "en", "s", None), *((n, "t", "en", "s", n) for n in range(20, 60))]
    got = audited(spark, rows, monkeypatch)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}
    assert audited(spark, rows[:1], monkeypatch) == brute(rows[:1])
    df = spark.createDataFrame([], SCHEMA)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    assert queries.op12_merkle(spark, "").count() == 0


def test_sql_of_the_manifest_is_registered():
    assert {"op11_negatives", "op12_merkle"} <= set(oracles.ORACLES)
