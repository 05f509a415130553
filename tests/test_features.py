"""Covers, bounds, responses and packs against plain walks; generated graphs against their rules."""

import math
import random

import pytest
from conflux.operators import conflict, features, recover
from conflux.sources import generators
from pyspark.sql import functions as F

SCOPE = "action long, cid long, w long, owner long"


def _scopes(spark, sizes, chance, seed):
    rnd = random.Random(seed)
    n = max(sizes)
    edges = [(u, v) for u in range(n) for v in range(u + 1, n) if rnd.random() < chance]
    weight = {v: rnd.choice([3, 5, 5, 8]) for v in range(n)}
    scopes = {a: sorted(rnd.sample(range(n), k)) for a, k in enumerate(sizes)}
    rows = [(a, v, weight[v], v % 3) for a, vs in scopes.items() for v in vs]
    near = {a: {v: {x for e in edges for x in e if v in e and x != v and x in vs} for v in vs} for a, vs in scopes.items()}
    return spark.createDataFrame(rows, SCOPE), spark.createDataFrame(edges, "u long, v long"), weight, near


def test_cover_and_bounds_are_those_of_a_walk(spark):
    scope, edges, weight, near = _scopes(spark, [12, 9, 2, 1, 14], 0.45, 5)
    cliques = features.clique_cover(scope, edges)
    got = {}
    for r in cliques.collect():
        got.setdefault(r.action, []).append(list(r.members))
    told = {r.action: r for r in features.summaries(scope, edges, cliques).collect()}
    for a, around in near.items():
        own = {v: weight[v] for v in around}
        want = recover.clique_cover(own, around)
        assert sorted(got.get(a, [])) == sorted(want)
        r = told[a]
        assert r.upper == recover.upper_bound(own, want) and r.p1 == pytest.approx(recover.p1_proxy(own, want))
        assert (r.cliques, r.largest_clique) == (len(want), max(map(len, want), default=0))
        assert r.mean_clique == pytest.approx(sum(map(len, want)) / max(1, len(want)))
        assert r.mean_memberships == pytest.approx(sum(map(len, want)) / len(own)) and r.log_cliques == pytest.approx(math.log1p(len(want)))
        assert r.share_of_three == pytest.approx(sum(len(q) >= 3 for q in want) / max(1, len(want)))


def test_cover_of_one_large_clique_and_of_nothing(spark):
    ids = spark.range(20)
    scope = ids.select(F.lit(1).cast("long").alias("action"), F.col("id").alias("cid"), (F.col("id") % 7).alias("w"), F.lit(0).cast("long").alias("owner"))
    edges = ids.select(F.col("id").alias("u"), F.explode(F.expr("sequence(0L, 19L)")).alias("v")).where("u < v")
    assert [len(r.members) for r in features.clique_cover(scope, edges).collect()] == [20]
    assert features.clique_cover(scope, edges.where("false")).count() == 0
    alone = features.summaries(scope, edges.where("false"), features.clique_cover(scope, edges.where("false"))).first()
    assert alone.upper == alone.p1 == alone.total and alone.cliques == 0
    none = scope.where("false")
    assert features.summaries(none, edges, features.clique_cover(none, edges)).count() == 0


def test_response_by_hand(spark):
    """0 is inserted and displaces 1; 2 may come back; 3 stays selected beside 2's rival 4, which is no node."""
    vertices = spark.createDataFrame([(0, 10, 0), (1, 8, 0), (2, 4, 1), (3, 6, 1), (4, 5, 2)], "cid long, w long, owner long")
    adj = conflict.symmetric(spark.createDataFrame([(0, 1), (1, 2), (0, 3), (3, 4)], "u long, v long"))
    sel = spark.createDataFrame([(1,), (3,)], "cid long")
    one = lambda v: spark.createDataFrame([(0, v)], "action long, cid long")
    gone = one(1)  # 3 is kept here on purpose, to stand at the rim
    nodes = features.response_nodes(one(0), gone, one(2), adj, sel)
    assert {(r.cid, r.role) for r in nodes.collect()} == {(0, 1), (1, 2), (2, 3), (3, 0)}
    told = {r.cid: r for r in features.response_features(nodes, vertices, adj, sel).collect()}
    assert [(told[v].weight, told[v].degree, told[v].before, told[v].after, told[v].same_owner) for v in range(4)] == [
        (1.0, 0.5, False, True, 0.5), (0.8, 0.5, True, False, 0.5), (0.4, 0.25, False, False, 0.0), (0.6, 0.5, True, True, 0.0)
    ]
    assert [told[v].inside for v in range(4)] == pytest.approx([2 / 3, 2 / 3, 1 / 3, 1 / 3])
    arcs = {(r.u, r.v, r.kind) for r in features.response_arcs(nodes, vertices, adj).collect()}
    half = {(0, 1, 0), (0, 1, 1), (0, 1, 3), (1, 2, 0), (1, 2, 2), (0, 3, 0)}
    assert arcs == half | {(v, u, k) for u, v, k in half}


def test_packs_keep_empty_requests_and_merge(spark):
    requests = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)], "batch string, action long")
    nodes = spark.createDataFrame([(1, 7), (1, 9), (3, 7), (5, 2), (5, 3), (5, 4)], "action long, cid long")
    cliques = spark.createDataFrame([(1, [7, 9]), (5, [2, 3]), (5, [2, 4])], "action long, members array<long>")
    told, placed, incidence = features.packed(requests, nodes, cliques, "batch", "action")
    assert [tuple(r)[1:] for r in told.orderBy("action").collect()] == [(1, 2, 0, 1, 0), (2, 0, 2, 0, 1), (3, 1, 2, 0, 1), (4, 0, 0, 0, 0), (5, 3, 0, 2, 0)]
    assert [r.node for r in placed.orderBy("action", "cid").collect()] == [0, 1, 2, 0, 1, 2]
    assert sorted(map(tuple, incidence.collect())) == [("a", 0, 0), ("a", 0, 1), ("b", 0, 0), ("b", 0, 1), ("b", 1, 0), ("b", 1, 2)]
    whole = features.merged(told, "batch", "action").orderBy("place").collect()
    assert [(r.action, r.place, r.node_from, r.factor_from) for r in whole] == [(1, 0, 0, 0), (2, 1, 2, 1), (3, 2, 2, 1), (4, 3, 3, 1), (5, 4, 3, 1)]


@pytest.mark.parametrize("topology", generators.TOPOLOGIES)
def test_menus_follow_their_topology(spark, topology):
    r, m = 20, 6
    vertices, edges, chosen, actions = generators.menu_graph(spark, 9, r, m, 0.3, 0.05, topology)
    rows = {x.cid: x for x in vertices.collect()}
    found = sorted((x.u, x.v) for x in edges.collect())
    assert len(found) == len(set(found)) and all(u < v for u, v in found) and len(rows) == (r + 2) * m
    anchors = {x.cid for x in chosen.collect()}
    assert anchors == {k * (r + 2) for k in range(m)} and not any(u in anchors and v in anchors for u, v in found)
    inner, outer = [], []
    for u, v in found:
        a, b = rows[u], rows[v]
        if a.menu != b.menu:
            assert a.owner != b.owner and a.role > 1 and b.role > 1
            outer.append((u, v))
        elif a.role == 0:
            continue
        else:
            assert a.role > 1
            inner.append((a.role - 2, b.role - 2))
    assert sum(rows[u].role == 0 for u, _ in found) == m * (r + 1)
    if topology == "bipartite":
        assert all(x % 2 != y % 2 for x, y in inner)
    if topology == "components":
        assert all(x // 8 == y // 8 for x, y in inner)
    if topology == "cliques":
        assert sum(x // 5 == y // 5 for x, y in inner) == m * 4 * 10
    if topology == "erdos":
        assert 0.15 * 0.8 < len(inner) / (m * r * (r - 1) / 2) < 0.45 * 1.2
    assert outer
    taken = {}
    for x in actions.collect():
        taken.setdefault(x.action, []).append(x.cid)
    pairs = [c for c in taken.values() if len(c) == 2]
    assert len(taken) - len(pairs) == m and len(pairs) == m and all(rows[a].owner != rows[b].owner for a, b in pairs)
    again = generators.menu_graph(spark, 9, r, m, 0.3, 0.05, topology)[1].repartition(5)
    assert sorted((x.u, x.v) for x in again.collect()) == found


def test_sparse_menus_cost_their_edges(spark):
    _, edges, _, actions = generators.menu_graph(spark, 2, 98, 2000, 0.001, 1e-7)
    inside = edges.where("u % 100 > 0 and u div 100 = v div 100").count()  # density is 0.01 at least
    assert abs(inside - 0.01 * 2000 * 98 * 97 / 2) < 6 * math.sqrt(0.01 * 2000 * 98 * 97 / 2)
    assert actions.where("action < 0").select("action").distinct().count() == 2000


def test_windows_conflict_by_the_larger_setup(spark):
    contacts, edges = generators.window_graph(spark, 4, satellites=3, grounds=2, passes=12, alternatives=4)
    rows = contacts.collect()
    found = {(x.u, x.v) for x in edges.collect()}
    for x in rows:
        assert x.visible_from <= x.s + 1 and x.e <= x.visible_to + 2 and 2.9e7 < x.e - x.s < 7.7e8 and x.e - x.s <= x.w <= 2 * (x.e - x.s)
        for y in rows:
            if x.cid < y.cid:
                setup = max(30_000_000 * (x.owner == y.owner), 15_000_000 * (x.ground == y.ground))
                assert ((x.cid, y.cid) in found) == (setup > 0 and not (x.e + setup <= y.s or y.e + setup <= x.s))
    with pytest.raises(ValueError):
        generators.window_graph(spark, 4, grounds=0)
