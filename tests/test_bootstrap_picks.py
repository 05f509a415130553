"""The picks of the bootstrap are exact for strata whose hashes pass 32 and 64 bits."""

import numpy as np
from conflux.operators import stats


def test_picks_of_large_strata():
    for n in (7, 30_000, 10**6, 10**9):
        places = np.array([1, 2, n // 2 + 1, n - 1, n], dtype=np.int64)
        for draw in (1, 57, 100):
            want = [(draw * 7919 + k * 104729 + 1979) * 2654435761 % 4294967291 % n for k in places.tolist()]
            assert stats.bootstrap_picks(draw, places, n, 1979).tolist() == want


def test_a_stratum_whose_hashes_pass_32_bits(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 9000)
    n = {"a": 25_000, "b": 3}
    rows = spark.range(n["a"] + n["b"]).selectExpr(f"if(id < {n['a']}, 'a', 'b') as s", "id as u", "cast(id % 11 as double) as x")
    got = {r.draw: r["mean"] for r in stats.bootstrap(rows, "s", "u", "x", 9, 1979).collect()}
    assert sorted(got) == list(range(1, 10))
    for draw, mean in got.items():
        mu = []
        for first, size in ((0, n["a"]), (n["a"], n["b"])):
            picks = [(draw * 7919 + k * 104729 + 1979) * 2654435761 % 4294967291 % size for k in range(1, size + 1)]
            mu.append(sum((first + i) % 11 for i in picks) / size)
        assert abs(mean - sum(mu) / 2) < 1e-9
