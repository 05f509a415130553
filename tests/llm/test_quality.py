import re
from collections import Counter

import numpy as np
import pytest
from conflux.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def llr(rows, good):
    """Scores by the definition, with dictionaries."""

    def grams(t):
        b = (t or "").encode()
        return [(int.from_bytes(b[i : i + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(b) - 3)]

    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in good:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    one = {g: np.log((target[g] + 1) / (n_target + 65536)) - np.log((raw[g] + 1) / (n_raw + 65536)) for g in raw}
    return {d: float(np.mean([one[g] for g in grams(t)])) if n_target and grams(t) else 0.0 for d, t in rows}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    score = llr(rows, {r.doc_id for r in labels if r.quality == 1})
    got = {r.doc_id: r for r in queries.op5_quality(spark, sf).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert r.llr == pytest.approx(score[d], abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    kept = {r.doc_id: got[r.doc_id].kept for r in labels if not got[r.doc_id].base_failed}
    truth = {r.doc_id: r.quality == 1 for r in labels}
    assert all(kept[d] for d in kept if truth[d])
    assert np.mean([not kept[d] for d in kept if not truth[d]]) > 0.9


def test_edge_cases(spark):
    line = "a b c d e f g h"
    texts = [None, "", " \n\t\r\x0b\x0c ", "é ü x #*$%&|<>", f"{line}\n{line}\n{line} i\n\n\n", "x " * 200_000, "\n".join(["same"] * 30), "no  double  spaces " * 3, line, f"{line} {line}"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1), (0, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words long")
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.measured(docs, labels).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:7]) for r in got) == sorted((str(d), *brute(t)) for d, t, _, _ in rows)
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.measured(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "w " * 10 + " ".join(map(str, range(30))))], "doc_id long, text string")
    assert [(r.llr, r.kept) for r in quality.measured(some, labels).collect()] == [(0.0, True)]
