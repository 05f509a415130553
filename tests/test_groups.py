"""Scopes covered and recovered within tasks from their windows, against edges that are made."""

import random

import pytest
from conflux.operators import conflict, features, groups, recover
from conflux.plans import features as plans
from conflux.plans import queries

DATA = "/root/testdata/sf0.001"
RULE = {"ant": 7, "owner": 20}


@pytest.fixture(scope="module")
def scope(spark):
    draw = random.Random(3)
    own = []
    for cid in range(80):
        s = draw.randrange(0, 300)
        own.append((cid, draw.choice([0, 1, 2, None]), draw.choice([0, 1, 2, 3, None]), s, s + draw.choice([0, 5, 40, 400]), draw.choice([3, 5, 5, 8])))
    rows = [(a, *row) for a, k in enumerate([1, 2, 9, 30, 60, 80]) for row in draw.sample(own, k)]
    return spark.createDataFrame(rows, "action long, cid long, ant int, owner long, s long, e long, w long").repartition(3).cache()


@pytest.fixture
def small_batches(spark, monkeypatch):
    """Scopes run over several batches and steps."""
    monkeypatch.setattr(groups, "STEP", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cover_and_summaries_of_windows(spark, scope, small_batches):
    links = conflict.scope_conflicts(scope, scope, RULE)
    cover = features.clique_cover(scope, links).cache()
    rows = lambda df: sorted((r.action, list(r.members)) for r in df.collect())
    assert rows(features.window_cover(scope, RULE)) == rows(cover) != []
    want = features.summaries(scope, links, cover)
    got = {r.action: r for r in features.window_summaries(scope, RULE).collect()}
    for r in want.collect():
        assert got.pop(r.action).asDict() == pytest.approx(r.asDict())
    assert not got


def test_large_scopes_still_grow_in_rounds(spark, monkeypatch):
    told = sorted(map(tuple, plans.a20_scope_features(spark, DATA).collect()))
    monkeypatch.setattr(plans, "FITS", 5)
    assert sorted(map(tuple, plans.a20_scope_features(spark, DATA).collect())) == told


@pytest.mark.parametrize("name", ["g05_clique_cover", "a19_scope_statistics", "a20_scope_features", "g02_greedy_recovery", "g05_scope_bounds", "g10_local_search"])
def test_no_conflict_of_a_scope_is_stored(spark, monkeypatch, name):
    monkeypatch.setattr(queries.Graph, "inside", lambda *_: pytest.fail("conflicts are stored"))
    assert queries.QUERIES[name](spark, DATA).count()


def test_recovery_of_windows(spark, scope, small_batches):
    nodes = recover.scoped(scope, conflict.scope_conflicts(scope, scope, RULE)).cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(recover.scope_bounds(scope, RULE)) == rows(recover.bounds(nodes)) != []
    for backend in (lambda w, n: (recover.portfolio(w, n), False), lambda w, n: recover.branch_and_bound(w, n, 50)):
        assert rows(recover.recovered_scopes(scope, RULE, backend)) == rows(recover.recovered(nodes, backend))


def test_conflicts_of_named_scopes(spark, scope, small_batches):
    named = scope.selectExpr("concat('s', action, ':', action % 2) as kernel", "cid")
    own = scope.drop("action").distinct()
    rows = lambda df: sorted(map(tuple, df.select("kernel", "u", "v").collect()))
    assert rows(groups.window_conflicts(named, own, RULE, "kernel")) == rows(conflict.scope_conflicts(named, own, RULE, "kernel")) != []
