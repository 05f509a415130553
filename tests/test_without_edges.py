"""Queries that need no table of conflicts, against the operators that read one."""

import random

import pytest
from conflux.operators import conflict, greedy, pairs, selection
from conflux.plans import queries

DATA = "/root/testdata/sf0.001"
RULE = {"ant": 7, "owner": 20}


@pytest.fixture(scope="module")
def graph(spark):
    draw = random.Random(3)
    rows = []
    for cid in range(70):
        s = draw.randrange(0, 160)
        rows.append((cid * 13 % 70, draw.choice([0, 1, 2, None]), draw.choice([0, 1, 2, 3, None]), s, s + draw.choice([0, 3, 9, 60]), draw.randrange(1, 9)))
    c = spark.createDataFrame(rows, "cid long, ant int, owner long, s long, e long, w long").cache()
    e = conflict.conflict_edges(c, *RULE.values()).cache()
    return c, e, conflict.symmetric(e).cache(), selection.local_best(c, e).cache()


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_edges_and_triangles(graph):
    c, e, adj, _ = graph
    assert rows(conflict.both_at_once(e.select("u", "v"))) == rows(adj.select("u", "v"))
    assert rows(conflict.window_relation(c, RULE)) == rows(conflict.pair_relation(e, c))
    assert rows(conflict.counted_triangles(c, RULE)) == rows(pairs.triangles(e)) != ["(0,)"]


def test_components_and_greedy(graph):
    c, e, _, _ = graph
    assert rows(greedy.components(c, conflict.linked(c, RULE))) == rows(greedy.components(c, e))
    deg = c.join(conflict.degrees(c, e), "cid")
    for key in (None, greedy.degree_key(0.5)):
        for local in (20, 1 << 18):
            assert rows(greedy.greedy_windows(deg, RULE, key, local)) == rows(greedy.greedy(c if key is None else deg, e, key)), local


def test_scopes_of_actions(spark, graph):
    c, e, adj, sel = graph
    outs = [r.cid for r in c.select("cid").join(sel, "cid", "left_anti").collect()]
    draw = random.Random(4)
    acts = spark.createDataFrame([(x, x) for x in outs] + [(-1 - n, x) for n in range(20) for x in draw.sample(range(72), draw.choice([1, 2, 2, 2, 3]))], "action long, cid long").cache()
    assert rows(selection.valid_windows(acts, c, RULE, sel)) == rows(selection.valid_actions(acts, c, adj, sel))
    acts = acts.join(c.select("cid"), "cid", "left_semi").join(sel, "cid", "left_anti").select("action", "cid").cache()
    gone = selection.displaced(acts, adj, sel).cache()
    blk = pairs.blockers(c, adj, sel).cache()
    assert rows(selection.sphere_windows(gone, blk)) == rows(selection.sphere(gone, adj))
    fresh = c.where("cid % 4 <> 0").select("cid")
    assert rows(pairs.bundles_windows(blk, fresh, c, RULE)) == rows(pairs.bundles(blk, fresh, e))
    found = selection.eligible_windows(acts, gone, blk, c, RULE, costs=True).cache()
    assert rows(pairs.compatible_windows(found, RULE)) == rows(pairs.compatible_pairs(found.select("action", "cid", "w", "owner"), e, blk)) != []


def test_similar_pairs_in_neighbouring_cells(spark):
    draw = random.Random(6)
    cases = [(n, draw.choice("ab"), draw.choice([0, 1, 9, 10, 11, 100]), draw.choice([-3.0, -0.04, 0.0, 0.05, 0.95, 1.0, 1.05, 90.0, 95.0, 94.9])) for n in range(90)]
    got = pairs.similar_pairs(spark.createDataFrame(cases, "k long, g string, size int, x double"), "g", "k", "size", 0.1, ["x"], 0.05)
    want = sorted(
        (a[1], a[0], b[0]) for a in cases for b in cases
        if a[1] == b[1] and a[0] < b[0] and abs(a[2] - b[2]) <= 0.1 * max(a[2], b[2]) and abs(a[3] - b[3]) / max(1.0, abs(a[3]), abs(b[3])) <= 0.05
    )
    assert want and sorted(map(tuple, got.collect())) == want


NAMES = ["j03_adjacency", "j21_pair_relation", "a24_triangles", "f11_valid_actions", "j22_bundles", "g01_greedy", "g01_greedy_by_degree", "g03_components", "j05_sphere", "j09_compatible_pairs"]


@pytest.mark.parametrize("name", NAMES)
def test_no_table_of_conflicts_is_written(spark, monkeypatch, name):
    for table in ("e", "adj"):
        monkeypatch.setattr(queries.Graph, table, property(lambda self: pytest.fail("a table of conflicts is made")))
    assert queries.QUERIES[name](spark, DATA).columns
