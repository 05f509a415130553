import math
import random

import numpy as np
import pytest
from conflux.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<float>, score double, rank int"


def brute(rows, k_pos, k_neg):
    """Straight from the definition, in Python's integers."""
    v = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    anchors = {}
    for i, label, q in v:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, r, strict=True)), i, own) for i, own, r in v if i != a and len(r) == len(q)]
        for s, p, _ in sorted(t for t in scored if t[2] == label)[:k_pos]:
            own = sorted((t, i) for t, i, o in scored if o != label and 30 * -s <= 100 * -t <= 90 * -s)[:k_neg]
            out += [(a, p, n, i, -s, -t) for n, (t, i) in enumerate(own, 1)]
    return sorted(out)


def mined(spark, rows, parts=3, k_pos=negatives.POSITIVES, k_neg=negatives.NEGATIVES):
    df = spark.createDataFrame([(*r, 0.0, 1) for r in rows], SCHEMA).repartition(parts)
    got = negatives.mined(negatives.relabelled(df), F.col("vec_id") % 100 == 0, k_pos, k_neg)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize(("digit", "block", "windows"), [(2, 7, 1), (9, 50, 3)])
def test_ties_hot_copies_and_small_digits(spark, monkeypatch, digit, block, windows):
    monkeypatch.setattr(negatives, "DIGIT", digit)
    monkeypatch.setattr(negatives, "ROWS", block)
    monkeypatch.setattr(negatives, "WINDOWS", windows)
    rnd = random.Random(digit)
    some = [[rnd.choice([-0.5, 0.0, 0.3, 0.9]) for _ in range(3)] for _ in range(12)]
    rows = [(i, rnd.randrange(3), some[0] if i % 3 else rnd.choice(some)) for i in range(320)]
    assert mined(spark, rows) == brute(rows, 5, 10)


def test_defined_cases(spark):
    rows = [(0, 1, [0.5, 0.5]), (0, 0, [9.0, 9.0]), (1, 0, [0.4, 0.1]), (2, 0, [0.4, 0.1]), (2, 0, [0.4, 0.1]), (3, 1, [0.3, 0.2]), (3, 1, [0.3, 0.2]), (4, 2, [0.2, 0.1]), (5, 2, None), (6, None, [1.0, 1.0]),
            (None, 1, [1.0, 1.0]), (8, 1, [1.0, None]), (9, 1, [math.nan, 1.0]), (10, 1, [math.inf, 1.0]), (11, 0, [1.0]), (12, 0, []), (100, 3, []), (13, 3, []), (15, 4, []), (200, None, [1.0, 2.0]), (300, 5, [-1.0, -1.0]), (16, 5, [1.0, 1.0])]
    assert mined(spark, rows) == brute(rows, 5, 10)
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []


@pytest.mark.parametrize("scale", [1e3, 1e5, 1e6])
def test_exact_beyond_single_and_double_precision(spark, scale):
    rnd = random.Random(7)
    rows = [(i, i % 3, [rnd.uniform(-1, 1) * scale + (i % 5) / 256 for _ in range(4)]) for i in range(150)]
    assert mined(spark, rows, k_neg=4) == brute(rows, 5, 4)


def test_components_beyond_the_edge_count_as_the_edge(spark):
    rows = [(0, 1, [3e38, 0.0]), (1, 1, [3e38, 1.0]), (2, 1, [2e38, 0.0]), (3, 2, [3e38, 5.0])]
    got = mined(spark, rows)
    assert got == []  # every score is the edge, and nine tenths of it is below
    assert list(negatives.products(np.array([[3e18, 1]]), np.array([[3e18, 0], [-3e18, 0]]), 1e37)[0]) == [negatives.EDGE, -negatives.EDGE]
