import zlib

import numpy as np
import pytest
from conflux.llm import queries, toxicity
from pyspark.sql import functions as F


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op13_toxicity(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.5)
    told = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    clean = [r.score for r, toxic in told if not toxic]
    bad = [r.score for r, toxic in told if toxic]
    assert np.mean(np.array(clean) >= 0.5) < 0.01
    assert np.mean(np.array(bad) >= 0.5) > 0.8
    assert np.mean(np.array(bad)[:, None] > np.array(clean)[None, :]) > 0.9  # area under the curve; some labelled texts are junk without a telling word


def test_gradients_are_those_of_the_risk():
    rnd = np.random.default_rng(1)
    p, u, prior = rnd.normal(size=7), rnd.normal(size=11) + 2, 0.2

    def risk(p, u):
        return prior * np.logaddexp(0, -p).mean() + max(0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())

    a, b, negatives = toxicity.risk_gradients(p, u, prior)
    assert negatives > 0
    for g, at in ((a, 0), (b, 1)):
        for i in range(len(g)):
            step = [np.zeros(7), np.zeros(11)]
            step[at][i] = 1e-6
            assert g[i] == pytest.approx((risk(p + step[0], u + step[1]) - risk(p - step[0], u - step[1])) / 2e-6, abs=1e-6)
    # where the negatives' part is below 0, the step goes back on it
    a, b, negatives = toxicity.risk_gradients(np.full(7, 5.0), np.full(11, -5.0), 0.9)
    assert negatives < 0
    assert (a > 0).all()
    assert (b < 0).all()


def test_no_label_of_a_held_out_row_is_learned(spark):
    labels = spark.createDataFrame([(i, 1, 1) for i in range(50)] + [(1, 1, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.confirmed(labels)
    assert got.positive.tolist() == [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 and i not in (1, 2)]
    assert len(toxicity.confirmed(labels, 5).positive) == 5


def test_either_half_of_the_labels_will_do(spark):
    rows = [(i, ("vile " if i % 4 == 0 else "") + f"some words {i % 9} here") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = (spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id long, toxic int") for ids in (range(200), range(200, 400)))
    both = [toxicity.fit(docs, x) for x in (one, other)]
    assert both[0].bias != 0
    for m in both:
        got = {r.doc_id: r.predicted for r in toxicity.scored(docs, m).collect()}
        assert all(got[i] == (i % 4 == 0) for i in got)


def test_defined_cases(spark):
    rows = [(i, "awful stuff" if i % 3 else None) for i in range(60)] + [(None, "awful"), (7, "awful stuff"), (61, ""), (62, "word " * 300_000), (63, "1234 !?")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, toxic string, held_out int")
    for labels in ([], [(1, None), (2, 0)], [(i, 1) for i in range(60)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.scored(docs, model).collect()
        assert len(got) == len(rows)
        assert all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert toxicity.scored(empty, toxicity.fit(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).count() == 0
    assert docs.select(toxicity.held_out(F.lit(None).cast("long")).alias("x")).first().x is False
