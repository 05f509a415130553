"""Scans over ranges against plain loops, with one key that holds most rows."""

import random

import pytest
from conflux.operators import scans
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    keys = [1] * 300 + [2] * 20 + [None] * 15 + [3]
    return [(k, rnd.randrange(40), i, rnd.choice([None, *range(20)])) for i, k in enumerate(keys)]


def in_order(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("ranges", [1, 7])
def test_scans(spark, rows, ranges):
    df = spark.createDataFrame(rows, "k long, t long, id long, v long").repartition(5)
    want = {name: {} for name in ("max", "max_own", "sum", "last", "rank")}
    for own in in_order(rows).values():
        for i, r in enumerate(own):
            seen = [x[3] for x in own[:i] if x[3] is not None]
            upto = [x[3] for x in own[: i + 1] if x[3] is not None]
            want["max"][r[2]] = max(seen, default=None)
            want["max_own"][r[2]] = max(upto, default=None)
            want["sum"][r[2]] = sum(seen) if seen else None
            want["last"][r[2]] = own[i - 1][3] if i else None
            want["rank"][r[2]] = i + 1
    by = (["k"], ["t", "id"], "x")
    got = {
        "max": scans.running(df, *by, F.col("v"), ranges=ranges), "max_own": scans.running(df, *by, F.col("v"), inclusive=True, ranges=ranges), "sum": scans.running(df, *by, F.col("v"), "sum", ranges=ranges),
        "last": scans.previous(df, *by, F.col("v"), ranges=ranges), "rank": scans.ranked(df, *by, ranges=ranges),
    }
    for name, out in got.items():
        assert out.columns == ["k", "t", "id", "v", "x"]
        assert {r.id: r.x for r in out.collect()} == want[name], name


def test_a_hot_key_is_cut_into_ranges(spark):
    """No task holds more than its range, though one key has every row."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 20_011).alias("t"), "id")
    sizes = [r["count"] for r in scans.ranged(df, ["k"], ["t", "id"], 16).groupBy("k", "_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    plan = scans.running(df, ["k"], ["t", "id"], "x", F.col("id"), ranges=16)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_range" in plan.split("hashpartitioning(k")[1].split(")")[0]
