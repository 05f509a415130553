"""Conflicts inside scopes are made from the scopes' own windows; no table of all conflicts is stored."""

import random

import pytest
from conflux.operators import conflict, selection
from conflux.plans import queries, reports, searches  # noqa: F401  (register their queries)
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def windows(spark):
    draw = random.Random(11)
    rows = []
    for cid in range(60):
        s = draw.randrange(0, 300)
        rows.append((cid, draw.choice([0, 1, 2, None]), draw.choice([0, 1, 2, 3, 4, None]), s, s + draw.choice([0, 5, 40, 400]), draw.randrange(1, 9)))
    return spark.createDataFrame(rows, "cid long, ant int, owner long, s long, e long, w long")


def test_scopes_of_any_overlap(spark, windows):
    draw = random.Random(5)
    scopes = {a: set(draw.sample(range(60), draw.choice([1, 2, 9, 30]))) for a in range(-4, 6)}
    scope = spark.createDataFrame([(a, c) for a, own in scopes.items() for c in own], "action long, cid long")
    edges = {(r.u, r.v) for r in conflict.conflict_edges(windows, 7, 20).collect()}
    want = sorted((a, u, v) for a, own in scopes.items() for u, v in edges if u in own and v in own)
    assert want
    assert sorted(map(tuple, conflict.scope_conflicts(scope, windows, {"ant": 7, "owner": 20}).collect())) == want
    wide = scope.join(windows, "cid").withColumnRenamed("action", "grp")
    links = conflict.scope_conflicts(wide, windows, {"ant": 7, "owner": 20}, "grp")
    whole = conflict.conflict_edges(windows, 7, 20)
    both = [sorted(map(tuple, selection.induced(wide.select("grp", "cid"), x).collect())) for x in (links, whole)]
    assert both[0] == both[1]


@pytest.mark.parametrize("name", ["g04_coordination_cells", "j08_induced", "o03_greedy_order", "l07_message_round", "j12_touched_cliques"])
def test_no_table_of_all_conflicts(spark, monkeypatch, name):
    def refused(self):
        raise AssertionError("all conflicts are made")

    for table in ("e", "adj", "plain"):
        monkeypatch.setattr(queries.Graph, table, property(refused))
    assert queries.QUERIES[name](spark, DATA).columns


def test_means_over_neighbours_without_pairs(spark, windows):
    rule = {"ant": 7, "owner": 20}
    value = {r.cid: (r.w, -r.cid) for r in windows.collect()}
    near = {}
    for u, v in conflict.conflict_edges(windows, 7, 20).select("u", "v").collect():
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    got = conflict.neighbour_means(windows, rule, [F.col("w"), -F.col("cid")]).collect()
    assert {r.cid: r.means for r in got} == {u: [sum(value[v][n] for v in vs) / len(vs) for n in (0, 1)] for u, vs in near.items()}


def test_touched_windows_are_the_touched_cliques(spark, windows):
    rule = {"ant": 7, "owner": 20}
    sel = selection.local_best_windows(windows, rule)
    near = selection.near_selected(windows, rule, sel)
    edges = conflict.conflict_edges(windows, 7, 20)
    adj = conflict.symmetric(edges)
    outs = windows.select("cid").join(sel, "cid", "left_anti")
    gone = selection.displaced(outs.select(F.col("cid").alias("action"), "cid"), adj, sel).cache()
    want = selection.touched_cliques(windows.where("ant is not null").select(F.col("ant").alias("clique"), "cid"), selection.sphere(gone, adj), edges)
    got = sorted(map(tuple, selection.touched_windows(windows, gone, near, rule, "ant").collect()))
    assert got and got == sorted(map(tuple, want.collect()))
