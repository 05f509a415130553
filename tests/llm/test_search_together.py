import random

import numpy as np
import pyarrow as pa
import pytest
from conflux.llm import search
from conflux.shared import stored
from pyspark.sql import functions as F


def shard_of(texts):
    (ids, owner, h, tf, length), = search._indexed(pa.array(texts), pa.array(range(len(texts))))
    return search.Shard(ids, owner, h, tf, length, length.mean()), owner, h, tf


@pytest.mark.parametrize(("cells", "vocabulary"), [(1 << 20, 300), (500, 300), (1, 300), (1 << 20, 10**9)])
def test_queries_asked_together_find_what_each_finds_alone(monkeypatch, cells, vocabulary):
    """Also where arrays hold few queries at once, and in a shard without frequent terms."""
    monkeypatch.setattr(search, "CELLS", cells)
    rnd = random.Random(7)
    word = lambda: f"t{min(int(rnd.paretovariate(0.8)), vocabulary) if vocabulary < 10**9 else rnd.randrange(vocabulary)}"
    texts = [" ".join(word() for _ in range(rnd.choice([1, 3, 20, 80]))) for _ in range(700)]
    texts[100:110], texts[200], texts[201] = [texts[100]] * 10, "", "nowhere else"
    shard, owner, h, tf = shard_of(texts)
    assert (len(shard.dense) == 0) == (vocabulary == 10**9)
    cut = np.searchsorted(owner, np.arange(90, 221))
    at, weight = shard.places(h[cut[0] : cut[-1]]), tf[cut[0] : cut[-1]] * 1.5
    at[::50] = -1  # terms that the shard lacks
    cut = cut - cut[0]
    alone = [shard.top(at[a:b], weight[a:b], 5) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    kth = np.array([s[-1] if len(s) == 5 else 0.0 for _, s in alone])
    for least in (kth * 0, kth * 0.6, kth, kth + 1e6):
        got = {i: (d.tolist(), s.tolist()) for i, d, s in shard.tops(cut, at, weight, 5, least)}
        want = {}
        for i, (d, s) in enumerate(alone):
            if (good := s >= least[i]).any():
                want[i] = (d[good].tolist(), s[good].tolist())
        assert got == want


def test_blocks_are_read_once_for_queries_alike(monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices([f"{'ab'[i % 2]}{j}" for j in range(40)], k=30)) for i in range(640)]
    shard, owner, h, tf = shard_of(texts)
    calls = []
    summed = search.Shard.summed
    monkeypatch.setattr(search.Shard, "summed", lambda self, *a: calls.append(a[-1]) or summed(self, *a))
    cut = np.searchsorted(owner, np.arange(129))
    found = list(shard.tops(cut, shard.places(h[: cut[-1]]), tf[: cut[-1]] * 1.0, 3, np.zeros(128)))
    assert sorted(i for i, _, _ in found) == list(range(128))
    assert sum(calls) == 128
    assert len(calls) == 2


def test_a_shard_is_not_built_for_every_block_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "TASKS", 6)
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 7} w{i}") for i in range(60)], "doc_id long, text string")
    asked = stored(search.query_terms(docs).groupBy("query_id").agg(F.collect_list("term").alias("term"), F.collect_list(F.col("count").cast("double")).alias("weight")).repartition(10), "asked")
    files = len(asked.inputFiles())
    assert files == 10
    found = search._searched(search._text_rows(docs), asked, None, 3.0, 60, 3)
    assert found.rdd.getNumPartitions() <= 3 * 4  # before: 3 shards * 10 blocks
    assert {r.query_id for r in found.collect()} == set(range(60))
    assert found.where("query_id = doc_id").count() == 60
