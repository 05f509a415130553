"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest
from conflux.plans import (
    features,  # noqa: F401  (registers its queries)
    queries,
    reports,  # noqa: F401  (registers its queries)
    requests,  # noqa: F401
    searches,  # noqa: F401
)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toArrow()
    if name not in queries.ORACLES:
        assert got.num_columns
        return
    want = duck.execute(queries.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = sorted(got.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in columns), strict=True)))
    assert rows(got) == rows(want)


def test_gap_join_is_an_equi_join(spark):
    plan = queries.QUERIES["j01_gap_edges"](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
