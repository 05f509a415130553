"""Actions of every contact, missing cells, and more candidates than the cap."""

import duckdb
import pytest
from conflux.operators import stats
from conflux.plans import (
    queries,
    reports,  # noqa: F401  (registers its queries)
)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(got, want):
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in columns), strict=True)))
    assert rows(got) == rows(want)


def test_every_unselected_contact_acts(spark):
    g = queries.Graph(spark, DATA)
    acts = [tuple(r) for r in g.act.select("action", "cid").collect()]
    outs = {r.cid for r in g.outs.collect()}
    assert {c for a, c in acts if a >= 0} == outs and len([a for a, _ in acts if a >= 0]) == len(outs)
    two = {(r.a, r.b) for r in queries.QUERIES["j10_two_hop_pairs"](spark, DATA).collect()}
    sets = {}
    for a, c in acts:
        if a < 0:
            sets.setdefault(a, []).append(c)
    assert {tuple(sorted(x)) for x in sets.values()} == two and len(sets) == len(two)


def test_missing_cells(spark):
    plan = spark.createDataFrame([(n, y) for n in (1, 2) for y in (1992, 1993)], "nation int, y int")
    got = spark.createDataFrame([(1, 1992), (1, 1992), (1, 1993), (2, 1993), (3, 1992)], "nation int, y int")
    assert [tuple(r) for r in stats.plan_gaps(plan, got, ["nation", "y"]).collect()] == [(2, 1992)]
    cells = spark.createDataFrame([(1, 1992, 4), (1, 1993, 6), (2, 1993, 9), (3, 1992, 1), (3, 1993, None)], "nation int, y int, x long")
    means = {r.nation: (r["mean"], r.complete, r.incomplete) for r in stats.grid_mean(cells, ["nation"], "y", "x", [1992, 1993]).collect()}
    assert means == {1: (5.0, 2, 0), 2: (None, 1, 0), 3: (None, 1, 1)}


@pytest.fixture(scope="module")
def busy(tmp_path_factory):
    """One contact that holds up 300 light ones, of which 297 meet each other, and an action (contact 1) that displaces it."""
    folder = str(tmp_path_factory.mktemp("busy"))
    con = duckdb.connect()
    at = lambda s: f"TIMESTAMP '2024-01-01' + to_seconds({s})"
    con.execute(
        f"""COPY (SELECT 0::BIGINT AS event_id, {at(0)} AS ts, 1::BIGINT AS user_id, 'view' AS event_type, 100000.0::DOUBLE AS value, '{{"k": 1}}' AS props
  UNION ALL SELECT 1, {at(10)}, 1, 'view', 50.0, '{{"k": 2}}'
  UNION ALL SELECT i + 2, {at("20 + i * 10")}, i + 100, 'view', 2 + i * 0.01, '{{"k": 1}}' FROM range(297) r(i)
  UNION ALL SELECT i + 299, {at("40000 + i * 20000")}, i + 900, 'view', 0.5, '{{"k": 1}}' FROM range(3) r(i)) TO '{folder}/events.parquet' (FORMAT parquet)"""
    )
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["o02_coordination_pool", "u04_changes", "j09_compatible_pairs", "o01_pool"])
def test_more_candidates_than_the_cap(spark, busy, name):
    folder, con = busy
    got = queries.QUERIES[name](spark, folder).toArrow()
    same(got, con.execute(queries.ORACLES[name]).to_arrow_table())
    of_one = [r for r in got.to_pylist() if r["action"] == 1]
    if name == "o02_coordination_pool":
        assert [r["cid"] for r in sorted(of_one, key=lambda r: r["pos"])[:150]] == list(range(2, 302, 2))
    assert len(of_one) == {"o02_coordination_pool": 300, "u04_changes": 150, "j09_compatible_pairs": 3 * 297 + 3, "o01_pool": 256}[name]
