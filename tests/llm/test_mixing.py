import duckdb
import pytest
from conflux.llm import mixing, oracles, queries


def targets(sizes):
    """Water filling step by step; sizes: [(source, words)] in source order."""
    weight = {s: 1 + i % 3 for i, (s, _) in enumerate(sizes)}
    words = dict(sizes)
    open_, out, left = set(words), {}, float(sum(words.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * words[s]}
        if not full:
            out |= share
            break
        for s in full:
            out[s] = 3.0 * words[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    where = f"/root/testdata/{sf}"
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    got = [r.asDict() for r in queries.op10_mixing(spark, where).collect()]
    assert sorted(r["doc_id"] for r in got) == sorted(source)
    words, taken = {}, {}
    for r in got:
        s = source[r["doc_id"]]
        words[s] = words.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    want = targets(sorted(words.items()))
    for r in got:
        assert r["source_size"] == words[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= 2 * largest for s in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    rows = con.execute(oracles.mixing_sql()).fetchall()
    assert sorted(rows) == sorted(tuple(r.values()) for r in got)


def test_copies_cross_integer_boundaries(spark, monkeypatch):
    """One document a cell or many: the copies of a source's first n documents are its boundaries up to n * rate."""
    for cell in (1, 7, 10_000):
        monkeypatch.setattr(mixing, "CELL", cell)
        rows = [(i, "a" if i % 3 else "b", "w " * (1 + i % 5)) for i in range(300)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        got = mixing.mixed(docs).collect()
        words = {s: sum(r.size for r in got if bool(r.doc_id % 3) == (s == "a")) for s in "ab"}
        want = targets(sorted(words.items()))
        for s in "ab":
            own = [r for r in got if bool(r.doc_id % 3) == (s == "a")]
            assert abs(sum(r.copies for r in own) - len(own) * want[s] / words[s]) < 1
        assert all(r.copies <= 3 for r in got)


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = [(i, f"s{i % 40}", "w " * (1 + i % 9)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(map(str, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "SOURCES_BROADCAST", 3)
    assert sorted(map(str, mixing.mixed(docs).collect())) == want


def test_many_small_sources_meet_their_targets_in_sum(spark):
    """Offsets are uniform in [0, 1): of sources with one document, as many emit it as their rates add up to."""
    rows = [(i, f"s{i:04d}", "w " * (1 + i % 7 * 5)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs).collect()
    want = targets([(f"s{i:04d}", 1 + i % 7 * 5) for i in range(3000)])
    by_rate = {}
    for r in got:
        rate = r.target / r.source_size
        assert r.target == pytest.approx(want[f"s{r.doc_id:04d}"])
        assert rate - 1 < r.copies < rate + 1
        n, total, expected = by_rate.get(round(rate, 2), (0, 0, 0.0))
        by_rate[round(rate, 2)] = n + 1, total + r.copies, expected + rate
    for n, total, expected in by_rate.values():
        assert abs(total - expected) <= 4 * (n / 4) ** 0.5 + 1
    shifts = sorted(r["shift"] / mixing.UNIT for r in mixing.targets(docs.select("source", mixing.size_of(docs.text).alias("size"))).collect())
    assert max(abs(x - (i + 0.5) / 3000) for i, x in enumerate(shifts)) < 0.04


def test_one_id_repeated(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 100)
    rows = [(7, "a", "w w w")] * 5000 + [(i, "b", "w " * (i % 4)) for i in range(200)] + [(7, "a", "w x w")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    a = [r for r in got if r.source_size == 5003 * 3]
    rate = a[0].target / a[0].source_size
    assert abs(sum(r.copies for r in a) - rate * len(a)) < 2
    again = mixing.mixture(docs)
    assert again.count() == sum(r.copies for r in got)
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.execute("CREATE VIEW docs AS SELECT * FROM documents")
    assert sorted(con.execute(oracles.mixing_sql("docs")).fetchall()) == sorted(map(tuple, got))


def test_edge_cases(spark):
    rows = [(1, None, "s", 5), (2, "", "s", 5), (3, "a b", None, 5), (3, "a b", None, 5), (None, "c d e", "s", 5), (4, "\t\n", "empty", 5), (5, "w " * 100_000, "t", 5), (6, "x", "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].size == by[2][0].size == by[4][0].size == 0
    assert by[4][0].target == 0.0 and by[4][0].taken == 0
    assert all(r.target <= 3 * r.source_size and r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs).collect()))
    again = mixing.mixture(docs)
    assert again.columns == docs.columns
    assert again.count() == sum(r.copies for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = queries.op10_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
