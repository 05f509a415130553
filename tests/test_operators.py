"""Operators against hand fixtures, plain-Python scans and brute force."""

import itertools
import random

import pytest
from conflux.functions import scalars as X
from conflux.operators import admission, conflict, greedy, pairs, policy, recover, requests, selection, stats, windows
from pyspark.sql import functions as F


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def contacts(spark, windows_, ant=None, owner=None):
    rows = [(i, owner[i] if owner else i + 100, ant[i] if ant else 1, s, e - s, e) for i, (s, e) in enumerate(windows_)]
    return spark.createDataFrame(rows, "cid long, owner long, ant int, s long, w long, e long")


@pytest.mark.parametrize(
    ("windows_", "gap", "want"),
    [
        ([(0, 5), (15, 20)], 10, []),
        ([(0, 5), (14, 20)], 10, [(0, 1)]),
        ([(0, 10), (3, 4), (0, 2)], 0, [(0, 1), (0, 2)]),
        ([(0, 100), (2, 3), (20, 21)], 0, [(0, 1), (0, 2)]),
        ([(0, 5), (10, 11), (14, 19), (22, 23)], 5, [(1, 2), (2, 3)]),
        ([(0, 5), (10, 11), (14, 19), (22, 23)], 10, [(0, 1), (0, 2), (1, 2), (2, 3)]),
        ([(-7, -3), (-3, 5)], 1, [(0, 1)]),
    ],
)
@pytest.mark.parametrize("width", [1, 3, 1000])
def test_gap_conflicts(spark, windows_, gap, want, width):
    assert rows_of(conflict.gap_conflicts(contacts(spark, windows_), "ant", gap, width)) == want


def test_one_window_of_a_year_among_seconds(spark):
    """It looks into few wide buckets, not into one for each second."""
    second, year = 10**6, 365 * 86_400 * 10**6
    c = contacts(spark, [(0, year), *((i * 3600 * second, i * 3600 * second + second) for i in range(1, 200))])
    got = conflict.gap_conflicts(c, "ant", 1)
    assert rows_of(got) == [(0, i) for i in range(1, 200)]
    made = got._jdf.queryExecution().executedPlan()
    assert "Cartesian" not in made.toString()


def test_typed_edges(spark):
    c = contacts(spark, [(0, 4), (2, 6)], owner=[7, 7])
    assert rows_of(conflict.conflict_edges(c, 0, 0)) == [(0, 1, 3)]
    assert rows_of(conflict.conflict_edges(contacts(spark, [(0, 10), (159, 170)], ant=[1, 2], owner=[3, 3]), 0, 150)) == [(0, 1, 2)]
    assert rows_of(conflict.conflict_edges(contacts(spark, [(0, 10), (160, 170)], ant=[1, 2], owner=[3, 3]), 0, 150)) == []


def test_gap_conflicts_brute_force(spark):
    rnd = random.Random(1)
    w = [(s, s + rnd.choice([0, 1, 5, 60])) for s in (rnd.randrange(200) for _ in range(80))]
    ant = [rnd.choice([1, 1, 2, None]) for _ in w]
    got = rows_of(conflict.gap_conflicts(contacts(spark, w, ant=ant), "ant", 4, 7))
    want = []
    for i, j in itertools.combinations(range(len(w)), 2):
        (a, b) = sorted((i, j), key=lambda k: (w[k][0], k))
        if ant[i] is not None and ant[i] == ant[j] and w[b][0] < w[a][1] + 4:
            want.append((i, j))
    assert got == sorted(want)


def graph(spark, weights, edges, owner=None):
    v = spark.createDataFrame([(i, w, owner[i] if owner else i) for i, w in enumerate(weights)], "cid long, w long, owner long")
    e = spark.createDataFrame([(min(x), max(x), 1) for x in edges] or [(0, 0, 0)], "u long, v long, etype int").where("u < v")
    return v, e, conflict.symmetric(e)


def members(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "cid long")


def test_preference_reversal(spark):
    weights, edges = [10, 10, 15, 15, 4, 4, 4, 4], [(0, 2), (0, 4), (0, 5), (1, 3), (1, 6), (1, 7)]
    for extra, want in (((4, 5), {2: 9, 3: 13}), ((6, 7), {2: 13, 3: 9})):
        v, e, adj = graph(spark, weights, [*edges, extra])
        sel = members(spark, 0, 1)
        act = spark.createDataFrame([(2, 2), (3, 3)], "action long, cid long")
        gone = selection.displaced(act, adj, sel)
        gain = {r.action: r.gain for r in selection.immediate_gain(act, gone, v).collect()}
        scopes = recover.scoped(selection.pool(selection.eligible(act, gone, adj, sel), v), e)
        best = {r.action: r.value for r in recover.recovered(scopes, lambda w, n: recover.branch_and_bound(w, n, 100)).collect()}
        assert {a: gain[a] + best[a] for a in gain} == want


def test_joint_overlap(spark):
    v, e, adj = graph(spark, [10, 10, 11, 11, 9, 9], [(0, 2), (1, 3), (0, 4), (1, 5), (4, 5)])
    sel = members(spark, 0, 1)
    act = spark.createDataFrame([(1, 2), (1, 3)], "action long, cid long")
    gone = selection.displaced(act, adj, sel)
    assert rows_of(selection.immediate_gain(act, gone, v)) == [(1, 2)]
    found = selection.eligible(act, gone, adj, sel)
    assert rows_of(found) == [(1, 4), (1, 5)]
    assert recover.exhaustive(recover.scoped(selection.pool(found, v), e)).first().optimum + 2 == 11
    assert rows_of(selection.valid_actions(act, v, adj, sel)) == [(1, True)]


def random_graph(rnd, n, p):
    return [rnd.randint(0, 30) for _ in range(n)], [x for x in itertools.combinations(range(n), 2) if rnd.random() < p]


def scan(weights, edges, key):
    near = {i: set() for i in range(len(weights))}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    taken = set()
    for v in sorted(near, key=lambda v: (key(v, near), -weights[v], v)):
        if not near[v] & taken:
            taken.add(v)
    return sorted(taken)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_rounds_equal_the_scan(spark, seed):
    rnd = random.Random(seed)
    weights, edges = random_graph(rnd, 60, 0.08)
    v, e, _ = graph(spark, weights, edges)
    assert [r.cid for r in greedy.greedy(v, e).orderBy("cid").collect()] == scan(weights, edges, lambda x, near: -weights[x])
    rows = v.join(conflict.degrees(v, e), "cid")
    got = [r.cid for r in greedy.greedy(rows, e, greedy.degree_key(0.5)).orderBy("cid").collect()]
    assert got == scan(weights, edges, lambda x, near: -weights[x] / (1 + len(near[x])) ** 0.5)


def test_components(spark):
    v, e, _ = graph(spark, [1] * 40, [(i, i + 1) for i in range(25)] + [(30, 33), (33, 31)])
    got = dict(rows_of(greedy.components(v, e)))
    assert got == {i: 0 if i <= 25 else 30 if i in (30, 31, 33) else i for i in range(40)}


def optimum(weight, near):
    best = 0
    ids = sorted(weight)
    for bits in range(1 << len(ids)):
        s = [v for k, v in enumerate(ids) if bits >> k & 1]
        if not any(b in near[a] for a, b in itertools.combinations(s, 2)):
            best = max(best, sum(weight[v] for v in s))
    return best


def independent(s, near):
    return not any(b in near[a] for a, b in itertools.combinations(s, 2))


def test_recovery_backends_on_random_graphs():
    rnd = random.Random(7)
    for _ in range(120):
        n = rnd.randint(1, 11)
        weights, edges = random_graph(rnd, n, rnd.choice([0.1, 0.3, 0.6]))
        weight = dict(enumerate(weights))
        near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(n)}
        best = optimum(weight, near)
        value = lambda s: sum(weight[v] for v in s)  # noqa: E731, B023
        exact, proved = recover.branch_and_bound(weight, near, 10_000)
        assert proved and value(exact) == best and independent(exact, near)
        gone, done = recover.eliminate(weight, near)
        assert done and value(gone) == best and independent(gone, near)
        warm = recover.portfolio(weight, near)
        cover = recover.clique_cover(weight, near)
        assert value(warm) <= best <= recover.upper_bound(weight, cover)
        assert all(b in near[a] for c in cover for a, b in itertools.combinations(c, 2))
        searched = recover.local_search(weight, near, [], 1000)
        assert independent(searched, near) and value(searched) <= best
        a, b = (recover.sweep(rnd.sample(sorted(weight), n), near) for _ in range(2))
        fused = recover.fuse(weight, near, a, b)
        inside = {v: near[v] & (set(a) | set(b)) for v in set(a) | set(b)}
        assert independent(fused, near) and value(fused) == optimum({v: weight[v] for v in inside}, inside)


def test_fixed_optima():
    star = ({0: 10, 1: 4, 2: 4, 3: 4}, {0: {1, 2, 3}, 1: {0}, 2: {0}, 3: {0}})
    triangle = ({0: 10, 1: 9, 2: 9}, {0: {1, 2}, 1: {0, 2}, 2: {0, 1}})
    big = 1 << 45
    path = ({0: big, 1: big + 1, 2: big + 2}, {0: {1}, 1: {0, 2}, 2: {1}})
    for (weight, near), want in ((star, 12), (triangle, 10), (path, 2 * big + 2)):
        for members_ in (recover.branch_and_bound(weight, near, 100)[0], recover.eliminate(weight, near)[0]):
            assert sum(weight[v] for v in members_) == want


def test_two_hop_pairs_brute_force(spark):
    rnd = random.Random(3)
    for _ in range(3):
        weights, edges = random_graph(rnd, 12, 0.25)
        v, e, adj = graph(spark, weights, edges)
        sel = set(scan(weights, edges, lambda x, near: x))
        near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(12)}
        want = []
        for a, b in itertools.combinations(sorted(set(range(12)) - sel), 2):
            gain = weights[a] + weights[b] - sum(weights[x] for x in (near[a] | near[b]) & sel)
            if b not in near[a] and near[a] & near[b] & sel and gain > 0:
                want.append((a, b, gain))
        chosen = members(spark, *sel)
        assert rows_of(pairs.two_hop_pairs(v, e, pairs.blockers(v, adj, chosen), chosen)) == want


def audited(weights, edges, sel):
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(len(weights))}
    outs = sorted(set(near) - sel)
    gain = lambda *x: sum(weights[i] for i in x) - sum(weights[b] for b in set().union(*(near[i] & sel for i in x)))
    two = [(a, b) for a, b in itertools.combinations(outs, 2) if b not in near[a] and gain(a, b) > 0]
    shared = [p for p in two if near[p[0]] & near[p[1]] & sel]
    every = [(-gain(a), 0, a, None) for a in outs if gain(a) > 0] + [(-gain(a, b), 1, a, b) for a, b in two]
    best = min(every, key=lambda x: (x[0], x[1], x[2], x[3] or 0), default=(0, 0, None, None))
    return sum(gain(a) > 0 for a in outs), len(shared), len(two) - len(shared), -best[0], best[2], best[3]


@pytest.mark.parametrize(("seed", "size", "limit"), [(1, 1024, None), (2, 3, None), (3, 2, None), (4, 3, 0), (5, 3, 6)])
def test_pair_audit_brute_force(spark, seed, size, limit):
    """Counts, gain and witness of all pairs; with lists cut into blocks, and refused ones."""
    rnd = random.Random(seed)
    weights, edges = random_graph(rnd, 26, 0.16)
    sel = set(scan(weights, edges, lambda x, near: x))
    v, e, adj = graph(spark, weights, edges)
    chosen = members(spark, *sel)
    blocked = pairs.blockers(v, adj, chosen)
    singles, shared, apart, gain, a, b = audited(weights, edges, sel)
    r = pairs.pair_audit(v, e, blocked, chosen, limit, size).first()
    assert r.singles == singles
    if limit is None:
        assert (r.shared_pairs, r.apart_pairs, r.lower, r.a, r.b, r.upper, r.complete) == (shared, apart, gain, a, b, gain, True)
    else:
        assert r.shared_pairs is None and r.lower <= gain <= r.upper
        if r.complete:
            assert (r.lower, r.a, r.b) == (gain, a, b)
    with pytest.raises(pairs.PairsRefused):
        pairs.two_hop_pairs(v, e, blocked, chosen, limit=0)


def test_pairs_below_zero(spark):
    rnd = random.Random(9)
    values = [rnd.randrange(-6, 9) for _ in range(90)]
    d = spark.createDataFrame(list(enumerate(values)), "cid long, d long")
    assert pairs.pairs_below_zero(d) == sum(a + b < 0 for a, b in itertools.combinations(values, 2))
    assert pairs.pairs_below_zero(d.limit(0)) == 0


def test_a_hub_of_many_outsiders(spark):
    """A hub that no pair of its outsiders outweighs makes no pairs; a light hub with 10^5 outsiders is refused, with bounds."""
    n = 100_000
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"), F.lit(1).alias("etype"))
    chosen = members(spark, 0)
    for weight, complete in ((10**6, True), (1, False)):
        v = spark.range(n + 1).select(F.col("id").alias("cid"), F.when(F.col("id") == 0, weight).otherwise(F.col("id") % 97 + 2).cast("long").alias("w"), F.col("id").alias("owner"))
        blocked = pairs.blockers(v, conflict.symmetric(star), chosen)
        r = pairs.pair_audit(v, star, blocked, chosen).first()
        assert r.occurrences == n * (n - 1) // 2 and r.complete == complete
        assert (r.lower, r.upper) == (0, 0) if complete else 97 <= r.lower <= r.upper == 196


def test_strict_means(spark):
    rows = spark.createDataFrame([("s", "g", 1.0), ("s", "g", None), ("s", "h", 4.0), ("t", "i", 5.0), ("t", "i", float("nan")), ("u", "j", 2.0)], "source string, graph string, x double")
    graphs, sources, overall = stats.strict_levels(rows, "x", [["source", "graph"], ["source"], []])
    assert {r.graph: r.mean for r in graphs.collect()} == {"g": None, "h": 4.0, "i": None, "j": 2.0}
    assert {r.source: r.mean for r in sources.collect()} == {"s": None, "t": None, "u": 2.0}
    assert overall.first().mean is None


def test_admission_boundaries(spark):
    events = spark.createDataFrame([(1, 10, 1, 5.0, 20), (1, 20, 2, 9.0, 20), (1, 19, 3, 5.0, 20), (2, 30, 4, 1.0, 20)], "run long, t long, id long, value double, deadline long")
    assert rows_of(admission.final_incumbents(events)) == [(1, 5.0, 2, 1, 1), (2, 0.0, 0, 1, None)]
    assert sum(r.on_time for r in admission.admitted(events).collect()) == 2
    assert sum(r.on_time for r in admission.admitted(events, inclusive=True).collect()) == 3


def test_quota_skips_what_does_not_fit(spark):
    calls = spark.createDataFrame([(1, 1, 11, 4.0), (1, 2, 12, 9.0), (1, 3, 13, 3.0), (1, 4, 14, 1.0)], "run long, turn long, idx long, cost double")
    assert rows_of(policy.admission_quota(calls, 8.0, 2).select("idx", "place")) == [(11, 0), (13, 1)]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert str(value(X.parse_utc(F.lit("01 Nov 2026 00:00:12.123456789")))) == str(value(X.parse_utc(F.lit("2026-11-01T00:00:12.123456Z")))) == "2026-11-01 00:00:12.123456"
    assert [value(X.half_even_micros(F.lit(n))) for n in (2500, 3500, 2501, -2500)] == [2, 4, 3, -2]
    assert value(X.seconds_to_ns(F.lit("1.000000001").cast("decimal(18,9)"))) == 1_000_000_001
    assert value(X.seconds_to_ns(F.lit("1.0000000001").cast("decimal(20,10)"))) is None
    assert value(X.fraction_tolerance(F.lit("00:00:12.123"))) == pytest.approx(0.0005 + 1e-6)
    assert value(X.edge_code(F.lit(3).cast("long"), F.lit(4).cast("long"), F.lit(10).cast("long"))) == 34
    assert value(X.finite(F.lit(float("nan")))) is None and value(X.finite(F.lit(float("inf")))) is None
    classes = [((-5, 0), "outside_before"), ((10, 12), "outside_after"), ((-1, 11), "both"), ((-1, 3), "left"), ((9, 11), "right"), ((0, 10), "none")]
    assert [value(X.interval_class(F.lit(a), F.lit(b), F.lit(10))) for (a, b), _ in classes] == [c for _, c in classes]


def test_round_robin(spark):
    rows = spark.createDataFrame([(7, 1, 1, 0), (7, 1, 2, 1), (7, 2, 1, 2), (8, 1, 1, 0)], "state long, action long, cap long, idx long")
    spent = spark.createDataFrame([(7, 1, 1, 0)], "state long, action long, cap long, idx long")
    got = windows.round_robin(rows, spent).select("state", "action", "cap", "idx", "turns", "place")
    assert rows_of(got) == [(7, 1, 2, 1, 1, 2), (7, 2, 1, 2, 0, 1), (8, 1, 1, 0, 0, 1)]


def test_execution_rows_with_nulls(spark):
    """A null flag is false, a gain that is no number counts as failed, a lost time leaves nothing accepted."""
    nan = float("nan")
    labels = [
        ("fine", True, True, True, True, 3.0, 10.0, 4.0), ("late", True, True, True, True, 10.0, 10.0, 4.0), ("loss", True, True, True, True, 3.0, 10.0, -4.0), ("untimed", True, True, True, True, None, 10.0, 4.0), ("nan time", True, True, True, True, nan, 10.0, 4.0),
        ("nan gain", True, True, True, True, 3.0, 10.0, nan), ("no gain", True, True, True, True, 3.0, 10.0, None), ("available?", None, True, True, True, 3.0, 10.0, 4.0), ("launched?", True, None, True, True, 3.0, 10.0, 4.0),
        ("returned?", True, True, None, True, 3.0, 10.0, 4.0), ("valid?", True, True, True, None, 3.0, 10.0, 4.0), ("not valid", True, True, True, False, 3.0, 10.0, 4.0),
    ]
    df = spark.createDataFrame(labels, "key string, available boolean, launched boolean, returned boolean, valid boolean, elapsed double, deadline double, gain double")
    got = {r.key: tuple(r)[1:] for r in requests.execution_rows(df).collect()}
    failed = (True, False, False, False, 0.0, 0.0, "failed")
    assert got == {
        "fine": (True, True, True, True, 4.0, 4.0, "accepted"), "late": (True, True, True, False, 4.0, 0.0, "late"), "loss": (True, True, True, True, 0.0, 0.0, "accepted"),
        "untimed": (True, True, False, False, 4.0, 0.0, "timestamp_failed"), "nan time": (True, True, False, False, 4.0, 0.0, "timestamp_failed"), "nan gain": failed, "no gain": failed, "returned?": failed, "valid?": failed, "not valid": failed,
        "available?": (False, False, False, False, 0.0, 0.0, "unavailable"), "launched?": (False, False, False, False, 0.0, 0.0, "idle"),
    }


def test_hashes_tell_sets_and_fractions_apart(spark):
    import hashlib
    import struct

    rows = spark.createDataFrame([("a", 0, 0.5, 7), ("a", 1, -2.0, 8), ("b", 0, 0.7, 7), ("b", 1, -2.0, 8)], "k string, i long, w double, owner long")
    got = {r.k: r.sha for r in requests.content_sha(rows, ["k"], ["i"], ["w", "owner"]).collect()}
    assert got == {k: hashlib.sha256(struct.pack("<2d2q", w, -2.0, 7, 8)).hexdigest() for k, w in (("a", 0.5), ("b", 0.7))}
    sets = spark.createDataFrame([("x", 5), ("x", 5), ("x", 7), ("y", 7), ("z", 0)], "k string, v long")
    want = {}
    for k, held in (("x", {5, 7}), ("y", {7}), ("z", {0})):
        h = 1469598103934665603
        for i in range(9):
            h = ((h ^ (i in held)) * 1099511628211) % 2**64
        want[k] = (h - 2**64 if h >= 2**63 else h, len(held))
    assert {r.k: (r.signature, r.n) for r in requests.signature(sets, ["k"], "v", F.lit(9)).collect()} == want


@pytest.mark.parametrize("most", [12, 3])
def test_coalitions_of_any_size(spark, most):
    rnd = random.Random(most)
    groups = {k: [(i, rnd.randint(0, 4), rnd.choice([1, 3, 6, 8, 9])) for i in range(n)] for k, n in enumerate([1, 2, 5, 6, 8])}
    df = spark.createDataFrame([(k, *x) for k, g in groups.items() for x in g], "k long, i long, w long, mask long")
    value = lambda s: sum(x[1] for x in s) - bin(__import__("functools").reduce(lambda a, x: a | x[2], s, 0)).count("1")
    got = {r.k: r for r in requests.coalitions(df, ["k"], most).collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        sets = [c for n in range(1, len(g) + 1) for c in itertools.combinations(g, n)]
        best = lambda n: max([0, *(value(c) for c in sets if len(c) <= n)])  # noqa: E731, B023
        least = min((len(c) for c in sets if value(c) > 0), default=None)
        pays = [x for x in g if value([x]) > 0]
        r = got[k]
        assert (r.best_single, r.best_pair, r.additive, r.additive_gain) == (best(1), best(2), sum(value([x]) for x in pays), max(0, value(pays)))
        if len(g) <= most:
            assert (r.best_any, r.least_paying, r.least_lower) == (best(len(g)), least, least)
        else:
            assert r.best_any is None and r.least_paying == (least if least in (1, 2) else None) and r.least_lower == (least if least in (1, 2) else 3)


def test_sketch_bounds_hold(spark):
    rnd = random.Random(6)
    weights, edges = random_graph(rnd, 24, 0.2)
    v, e, adj = graph(spark, weights, edges)
    sel = set(scan(weights, edges, lambda x, near: x))
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(24)}
    chosen = members(spark, *sel)
    two = [(a, b) for a, b in itertools.combinations(sorted(set(near) - sel), 2) if b not in near[a]]
    gain = lambda *x: sum(weights[i] for i in x) - sum(weights[b] for b in set().union(*(near[i] & sel for i in x)))
    got = requests.sketches(spark.createDataFrame(two, "a long, b long"), v, conflict.degrees(v, e), pairs.blockers(v, adj, chosen), chosen).collect()
    assert {(r.a, r.b) for r in got} == set(two)
    for r in got:
        best = max(0, gain(r.a), gain(r.b), gain(r.a, r.b))
        assert r.witness == best <= r.upper
        assert r.credit == sum(weights[x] for x in near[r.a] & near[r.b] & sel)


def test_small_graphs_propose_from_all(spark):
    weights = [100, *range(1, 101)]
    v, e, adj = graph(spark, weights, [(0, i) for i in range(1, 101)])
    chosen = members(spark, 0)
    blocked = pairs.blockers(v, adj, chosen)
    got = [(r.a, r.b) for r in requests.proposals(v, e, blocked, chosen, most=4, pool=2).collect()]
    assert sorted(got, key=str) == sorted([(100, None), (99, None), (99, 100), (98, 100)], key=str)
    few = requests.proposals(v, e, blocked, chosen, most=4, candidates=members(spark, 3, 5, 7)).collect()
    assert sorted(((r.a, r.b) for r in few), key=str) == sorted([(7, None), (5, None), (5, 7), (3, 7)], key=str)


def test_pair_counts_brute_force(spark):
    rnd = random.Random(8)
    rows = [(k, rnd.choice([None, *range(6)]), float(rnd.randrange(5))) for k in [1] * 60 + [2] * 7 + [3] for _ in range(1)]
    got = {r.k: r for r in stats.pair_counts(spark.createDataFrame(rows, "k long, x long, y double"), ["k"], "x", "y").collect()}
    for k in (1, 2, 3):
        own = [(x, y) for g, x, y in rows if g == k and x is not None]
        if not own:
            assert k not in got
            continue
        two = list(itertools.combinations(own, 2))
        r = got[k]
        assert (r.n, r.pairs) == (len(own), len(two))
        assert r.tied_x == sum(a[0] == b[0] for a, b in two) and r.tied_y == sum(a[1] == b[1] for a, b in two) and r.tied_both == sum(a == b for a, b in two)
        assert r.concordant == sum((a[0] - b[0]) * (a[1] - b[1]) > 0 for a, b in two)


def test_pair_accuracy_of_a_large_state(spark):
    """A state of 10^5 requests, of which every second is ordered the wrong way round."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("state"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id")).cast("double").alias("predicted"), F.col("id").cast("double").alias("truth"))
    r = policy.pair_accuracy(rows, F.lit(-1.0)).first()
    half = n // 2
    right = half * (half - 1)  # every even one comes after all smaller ones, and no odd one does
    assert r.unequal_pairs == n * (n - 1) // 2
    assert r.accuracy == pytest.approx(right / r.unequal_pairs, abs=1e-9)


def test_bootstrap_interval(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(3)
    rows = [(s, i, float(x)) for s, n in ((1, 40), (2, 700)) for i, x in enumerate(rnd.normal(s, 1, n))]
    df = spark.createDataFrame(rows, "s long, u long, x double")
    ones = df.withColumn("x", F.lit(1.0))
    monkeypatch.setattr(stats, "UNITS", 64)
    r = stats.bootstrap_interval(ones, "s", "u", "x", 300).first()
    assert (r.draws, r.mean) == (300, pytest.approx(1)) and r.low == pytest.approx(1) and r.high == pytest.approx(1)  # copies add up to the units
    a = stats.bootstrap_interval(df, "s", "u", "x", 4000).first()
    assert tuple(a) == pytest.approx(tuple(stats.bootstrap_interval(df.repartition(7), "s", "u", "x", 4000).first()))
    x = [np.array([v for s, _, v in rows if s == k]) for k in (1, 2)]
    middle, spread = np.mean([v.mean() for v in x]), np.sqrt(sum(v.var() / len(v) for v in x)) / 2
    assert a.mean == pytest.approx(middle, abs=4 * spread / 60)
    assert (a.high - a.low) / (2 * 1.96 * spread) == pytest.approx(1, abs=0.08)
