"""Selections and scopes that are found by their windows, against those found on stored edges."""

import random

import pytest
from conflux.operators import conflict, pairs, selection
from conflux.plans import queries

DATA = "/root/testdata/sf0.001"
RULE = {"ant": 6, "owner": 9}


@pytest.mark.parametrize("seed", range(2))
def test_scopes_against_edges(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(70):
        s = rnd.randrange(150)
        rows.append((i * 11 % 70, rnd.choice([None, 1, 2, 3]), rnd.choice([None, 1, 2, 3]), s, s + rnd.choice([0, 2, 5, 40]), rnd.randrange(9)))
    c = spark.createDataFrame(rows, "cid long, ant int, owner long, s long, e long, w long").repartition(3)
    edges = conflict.conflict_edges(c, *RULE.values()).cache()
    adj = conflict.symmetric(edges).cache()
    ids = lambda df: sorted(map(tuple, df.collect()))
    sel = selection.local_best(c, edges).cache()
    assert ids(selection.local_best_windows(c, RULE)) == ids(sel)
    near = selection.near_selected(c, RULE, sel).cache()
    assert ids(near) == ids(adj.join(sel.withColumnRenamed("cid", "v"), "v", "left_semi").select("u", "v"))
    outs = [r.cid for r in c.select("cid").join(sel, "cid", "left_anti").collect()]
    acts = spark.createDataFrame([(x, x) for x in outs] + [(-1 - n, x) for n in range(10) for x in rnd.sample(outs, 2)], "action long, cid long")
    gone = selection.displaced(acts, near, sel).cache()
    found = ids(selection.eligible_windows(acts, gone, pairs.blockers(c, near, sel), c, RULE))
    assert found == ids(selection.eligible(acts, gone, adj, sel)) and found


@pytest.mark.parametrize("name", ["g01_local_best", "j06_eligible", "u03_known_part"])
def test_no_edges_are_made(spark, monkeypatch, name):
    monkeypatch.setattr(queries.Graph, "plain", property(lambda self: pytest.fail("all edges are made")))
    assert queries.QUERIES[name](spark, DATA).count()
