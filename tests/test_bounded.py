"""Work that must not grow faster than the input: bands of pairs, counted degrees, tasks of fixed size, sets without rows."""

import random

import pytest
from conflux.operators import conflict, reports, requests
from conflux.plans import queries
from conflux.plans import reports as plans

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("larger", [{"ant": 9, "owner": 20}, {"ant": 3, "owner": 20}, {"ant": 3, "owner": 4}])
def test_only_the_band_between_two_gaps_is_met(spark, larger):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 1, 2]), rnd.choice([None, 1, 2, 3]), s, s + rnd.choice([0, 1, 4, 90, -30])) for i, s in enumerate(rnd.choices(range(90), k=60))]
    smaller = {"ant": 9, "owner": 12}
    after = [(a, b) for a in rows for b in rows if (a[3], a[0]) < (b[3], b[0])]
    meet = lambda a, b, rule, least: any(a[k] is not None and a[k] == b[k] and a[4] + least.get(r, -(10**6)) <= b[3] < a[4] + rule[r] for k, r in ((1, "ant"), (2, "owner")))
    df = spark.createDataFrame(rows, "cid long, ant int, owner long, s long, e long")
    band = sorted((a[0], b[0]) for a, b in after if meet(a, b, smaller, larger))
    assert sorted((r.i, r.j) for r in conflict.conflict_pairs(df, smaller, floor=larger).collect()) == band
    lost = sorted((min(a[0], b[0]), max(a[0], b[0])) for a, b in after if meet(a, b, smaller, {}) and not meet(a, b, larger, {}))
    assert sorted((r.u, r.v) for r in conflict.beyond(df, smaller, larger).collect()) == lost


def test_degrees_of_nodes_are_counted(spark, monkeypatch):
    monkeypatch.setattr(queries.Graph, "plain", property(lambda self: pytest.fail("all edges are made")))
    assert plans.l13_node_features(spark, DATA).count()


def test_tasks_of_agreed_anchors_have_as_many_rows(spark, monkeypatch):
    df = spark.createDataFrame([(k, float(k % 3 if k % 5 else n)) for k in range(40) for n in range(3)], "k long, a double")
    monkeypatch.setattr(reports, "ROWS", 10)
    out = reports.agreed_anchor(df, "k", "a")
    assert out.rdd.getNumPartitions() == 12
    assert {(r.k, r.agreed) for r in out.collect()} == {(k, float(k % 3) if k % 5 else None) for k in range(40)}


def test_sets_of_items_make_no_rows(spark):
    df = spark.createDataFrame([(1, 0, 3, 1), (1, 1, 0, 6), (2, 0, None, 1), (2, 1, 5, 3)], "k long, i long, w long, mask long")
    out = requests.coalitions(df, ["k"])
    assert "Generate" not in out._jdf.queryExecution().toString()
    assert sorted((r.k, r.best_any, r.least_paying) for r in out.collect()) == [(1, 2, 1), (2, 3, 1)]
