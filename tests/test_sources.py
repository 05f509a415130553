import json

import pytest
from conflux.sources import contacts as S
from conflux.sources import arrays, generators, sinks

HEADER = ",".join(S.CONTACT_SCHEMA.fieldNames())
GOOD = "g,geo,r0,2026-11-01T00:00:00Z,c1,p1,sat1,site1,ant1,0.000000000,5.000000001,5.000000001,a,b,no,h"


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_contacts_csv(spark, tmp_path):
    bad = "other,geo,r0,2026-11-01T00:00:00Z,c2,p1,sat1,siteX,ant1,7.0,6.0,1.0,a,b,yes,"
    rows = S.read_contacts_csv(spark, write(tmp_path, "c.csv", "\n".join([HEADER, GOOD, bad])))
    stations = spark.createDataFrame([("site1", "ant1")], "site_id string, antenna_id string")
    got = {(r.contact_id, r.rule) for r in S.contact_violations(rows, 100, "g", stations).collect()}
    assert got == {("c2", r) for r in ("bad interval", "bad duration", "boundary crossing", "no settings hash", "other source", "unknown station")}
    broken = S.read_contacts_csv(spark, write(tmp_path, "d.csv", f"{HEADER}\n{GOOD.replace('5.000000001', 'x')}"))
    with pytest.raises(Exception, match="(?i)malformed"):
        broken.collect()


def test_json_and_snapshots(spark, tmp_path):
    ok = S.read_json_strict(spark, write(tmp_path, "a.jsonl", '{"x": 1}\n{"x": 2}\n'), "x double")
    assert sorted(r.x for r in ok.collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|NaN"):
        S.read_json_strict(spark, write(tmp_path, "b.jsonl", '{"x": NaN}\n'), "x double").collect()
    for text in ('{"x": 1, "x": 2}\n', '{"x": 1, "deep": [{"a": 1, "a": 1}]}\n'):
        with pytest.raises(ValueError, match="twice"):
            S.read_json_strict(spark, write(tmp_path, "twice.jsonl", text), "x double")
    (tmp_path / "deep/er").mkdir(parents=True)
    doc = {"snapshot_id": "s", "snapshot": {"best_gain_seconds": 1.5}, "requests": [{"action_index": 0}, {"action_index": 3}]}
    (tmp_path / "deep/er/snapshot_1.json").write_text(json.dumps(doc))
    flat = S.read_snapshots(spark, str(tmp_path / "deep"), "snapshot_id string, snapshot struct<best_gain_seconds:double>, requests array<struct<action_index:int>>")
    assert sorted(tuple(r) for r in flat.collect()) == [("s", 1.5, 0), ("s", 1.5, 3)]


def test_report_and_manifest(spark, tmp_path):
    rows = S.read_report_csv(spark, write(tmp_path, "r.csv", "a,status\n1,ok\nnan,ok\nNone,\n7,no_rows\n"))
    assert [(r.a, r.status) for r in rows.collect()] == [("1", "ok"), (None, "ok"), (None, None)]
    path = write(tmp_path, "m.csv", "graph,graph_id,source_group,split\nx,1,s,TRAIN\ny,2,t,TEST\n")
    with pytest.raises(PermissionError):
        S.read_manifest(spark, path)
    assert S.read_manifest(spark, path, allow_test=True).count() == 2
    with pytest.raises(ValueError, match="more than one split"):
        S.read_manifest(spark, write(tmp_path, "n.csv", "graph,graph_id,source_group,split\nx,1,s,TRAIN\ny,2,s,VAL\n"))


def test_graph_text_and_memberships(spark, tmp_path):
    path = write(tmp_path, "g.txt", "GRAPH1 3 2\n5 0.5 0\n6 0.6 1\n7 0.7 1\n0 1\n1 2\n2 0 2\n")
    rows = [(r.part, r.a, r.b) for r in S.parse_graph_text(spark, path).orderBy("part", "place").collect()]
    assert rows == [("edge", "0", "1"), ("edge", "1", "2"), ("initial", "0", None), ("initial", "2", None), ("size", "2", None), ("vertex", "5", "0.5"), ("vertex", "6", "0.6"), ("vertex", "7", "0.7")]
    text = spark.createDataFrame([("1 0 1",)], "value string")
    assert sorted(r.v for r in S.membership_from_text(text, 3).collect()) == [0, 2]
    assert sorted(r.v for r in S.membership_from_text(spark.createDataFrame([("3 1",)], "value string"), 5).collect()) == [0, 2]
    for text, why in (("3 1 3", "twice"), ("3 6", "lie in"), ("0 2", "lie in")):
        with pytest.raises(ValueError, match=why):
            S.membership_from_text(spark.createDataFrame([(text,)], "value string"), 5)
    ragged = spark.createDataFrame([("g", [1, 2, 3], [0, 2, 2, 3])], "k string, flat array<int>, ptr array<int>")
    assert sorted(tuple(r) for r in S.decode_ragged(ragged, "flat", "ptr").collect()) == [("g", 0, 0, 1), ("g", 0, 1, 2), ("g", 2, 0, 3)]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, [1, 2])], "x int, l array<int>")
    b = spark.createDataFrame([(2, "q")], "x int, y string")
    sinks.write_report_csv([a, b], str(tmp_path / "r"))
    got = spark.read.option("header", True).option("nullValue", "null").csv(str(tmp_path / "r"))
    assert got.columns == ["x", "l", "y"] and sorted((r.x, r.l, r.y) for r in got.collect()) == [("1", "[1,2]", None), ("2", None, "q")]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_report_csv([a], str(tmp_path / "r"))
    v = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "v long, w long")
    e = spark.createDataFrame([(0, 2)], "u long, v long")
    sinks.write_lines(sinks.metis_lines(v, e), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["3 1 10", "5 3", "6", "7 1"]
    sinks.write_graphs(v.selectExpr("'g' as graph_id", "v", "w"), e.selectExpr("'g' as graph_id", "u", "v"), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/vertices")).count() == 3


def test_graph_arrays_round_trip(spark, tmp_path):
    rows = [("g", "vertex", i, i % 2, w) for i, w in enumerate([2.5, 0.0, 3.0, 1.0])] + [("g", "edge", 0, 1, None), ("g", "edge", 1, 3, None), ("g", "member", 0, None, None), ("g", "member", 3, None, None)]
    rows += [("g", "clique", 0, 0, None), ("g", "clique", 0, 1, None), ("g", "clique", 1, 2, None), ("h", "vertex", 0, -1, 1.0)]
    df = spark.createDataFrame(rows, arrays.ROWS)
    folder = (tmp_path / "npz").as_uri()
    assert sorted(r.graph_id for r in arrays.write_graph_arrays(df, folder).collect()) == ["g", "h"]
    back = [tuple(r) for r in arrays.read_graph_arrays(spark, folder).collect()]
    assert sorted(map(str, back)) == sorted(map(str, rows))
    with pytest.raises(FileExistsError):
        arrays.write_graph_arrays(df, folder)
    (tmp_path / "npz" / "g.lost.npz").write_bytes(b"half a file")  # of an attempt that failed
    assert arrays.read_graph_arrays(spark, folder).count() == len(rows)


@pytest.mark.parametrize(
    ("change", "why"),
    [({"weights": [1.0, float("nan")]}, "finite"), ({"edges": [[0, 0]]}, "loop"), ({"edges": [[0, 2]]}, "leaves"), ({"edges": [[0, 1, 0], [1, 0, 1]]}, "rows of two"), ({"edges": [[0, 1], [1, 0]]}, "twice"), ({"selected": [0, 1]}, "inside"), ({"selected": [0, 0]}, "different"),
     ({"agents": [1]}, "length"), ({"initial_mask": [0, 2]}, "0 or 1"), ({"cliques_flat": [0], "cliques_ptr": [0, 2]}, "fit")],
)
def test_contradicting_arrays(change, why):
    import numpy as np

    good = {"weights": np.array([1.0, 2.0]), "edges": np.array([[0, 1]])}
    arrays.checked(good)
    with pytest.raises(ValueError, match=why):
        arrays.checked(good | {k: np.array(v) for k, v in change.items()})
    with pytest.raises(ValueError, match="must be 1"):
        arrays.checked(good, unit=True)


def test_graph_and_kernel_text(spark, tmp_path):
    v = spark.createDataFrame([(0, 5, 0.5, 0), (1, 6, 0.25, 1), (2, 7, 1.5, 1)], "v long, tick long, raw double, owner long")
    e = spark.createDataFrame([(0, 1), (1, 2)], "u long, v long")
    sinks.write_lines(arrays.graph_lines(v, e, spark.createDataFrame([(2,), (0,)], "v long"), "GRAPH1"), str(tmp_path / "g"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert lines == ["GRAPH1 3 2", "5 0.5 0", "6 0.25 1", "7 1.5 1", "0 1", "1 2", "2", "0", "2"]
    back = [(r.part, r.place, r.a, r.b) for r in S.parse_graph_text(spark, write(tmp_path, "back.txt", "\n".join(lines) + "\n")).orderBy("part", "place").collect()]
    assert [x[2] for x in back if x[0] == "initial"] == ["0", "2"] and [x[2:] for x in back if x[0] == "edge"] == [("0", "1"), ("1", "2")]
    good = "\n".join(lines) + "\n"
    faults = lambda text: sorted(r.why for r in S.graph_text_faults(spark, write(tmp_path, "f.txt", text), "GRAPH1").collect())
    assert faults(good) == []
    for old, new, why in (("GRAPH1 3", "OTHER 3", "header"), ("\n0\n2\n", "\n0\n", "initial size"), ("\n0\n2\n", "\n0\n2\n7 7\n", "initial size"), ("\n0\n2\n", "\n2\n2\n", "initial vertex"), ("\n0\n2\n", "\n0\n1\n", "infeasible initial"), ("\n1 2\n", "\n1 3\n", "edge"), ("6 0.25 1", "6 x 1", "vertex")):
        assert old in good and why in faults(good.replace(old, new)), why
    assert "truncated" in faults("GRAPH1 3 2\n5 0.5 0\n")
    far = 1 << 21
    spread = arrays.numbered_lines(spark, [(spark.createDataFrame([(far, 1), (1, far), (1, 2)], "u long, v long"), ["u", "v"], ["u", "v"]), (spark.createDataFrame([(3,), (far,)], "v long"), ["v"], ["v"])])
    assert [r.line for r in spread.orderBy("part", "first", "second").collect()] == ["1 2", f"1 {far}", f"{far} 1", "3", f"{far}"]
    k = spark.createDataFrame([(0, 5, 0.5, 0, 0, 1, 1, 0, 0.5, 10), (1, 6, 0.25, 1, 1, 0, 0, 1, 1.0, 11), (2, 7, 1.5, 1, -1, 0, 0, 0, 0.0, 12)], "v long, w long, raw double, owner long, color int, base int, p int, q int, freq double, id long")
    sinks.write_lines(arrays.kernel_lines(k, e, "KERNEL1").coalesce(1), str(tmp_path / "k"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "k")).collect())
    own, links, faults = arrays.parse_kernel_text(spark, write(tmp_path, "k.txt", text + "\n"), "KERNEL1")
    assert sorted(tuple(r)[1:] for r in own.collect()) == sorted(map(tuple, k.collect()))
    assert sorted(tuple(r)[1:] for r in links.collect()) == [(0, 1), (1, 2)] and not faults.count()
    for old, new in (("KERNEL1 3", "OTHER 3"), ("\n1 2", "\n1 3"), ("0.5 10", "0.5 11"), ("-1 0 0 0", "-1 1 0 0"), ("1.0 11", "1.5 11")):
        assert old in text
        assert arrays.parse_kernel_text(spark, write(tmp_path, "bad.txt", text.replace(old, new) + "\n"), "KERNEL1")[2].count() == 1


def test_json_is_strict_and_whole(spark, tmp_path):
    path = str(tmp_path / "x.json")
    for value in (1, 2):
        sinks.write_json_strict(spark, {"b": value, "a": [None, "é"]}, path)
    assert json.loads(open(path).read()) == {"a": [None, "é"], "b": 2}
    with pytest.raises(ValueError, match="(?i)json"):
        sinks.write_json_strict(spark, {"a": float("nan")}, path)


def test_generated_graphs(spark):
    v, e = generators.block_graph(spark, 3, n=60)
    edges = {(r.u, r.v) for r in e.collect()}
    assert {(u, u + 1) for u in range(0, 60, 3)} <= edges and all(u < w < 60 for u, w in edges)
    assert all(3 <= r.w < 20 for r in v.collect())
    again = generators.block_graph(spark, 3, n=60)[1].repartition(7)
    assert {(r.u, r.v) for r in again.collect()} == edges != {(r.u, r.v) for r in generators.block_graph(spark, 4, n=60)[1].collect()}
    tight = {(r.u, r.v) for r in generators.block_graph(spark, 3, compatibility=1.0, n=60)[1].collect()}
    assert all(u % 3 == 0 or w % 3 == 0 for u, w in tight)
    chosen = {r.cid for r in generators.initial_schedule(v, e, seed=5).collect()}
    assert chosen and not any(u in chosen and w in chosen for u, w in edges)
    assert all(x in chosen or any(y in chosen for p in edges if x in p for y in p) for x in range(60))


def test_the_first_schedule_prefers_leaves_to_a_hub(spark):
    v = spark.createDataFrame([(0, 10.0, 0), (1, 9.0, 1), (2, 9.0, 2), (3, 9.0, 3)], "cid long, w double, owner long")
    e = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "u long, v long")
    assert sorted(r.cid for r in generators.initial_schedule(v, e, perturbation=0.0).collect()) == [1, 2, 3]
    from pyspark.sql import functions as F

    assert [r.cid for r in generators.initial_schedule(v, e, perturbation=0.0, anchors=F.col("cid") == 0).collect()] == [0]
    with pytest.raises(ValueError, match="negative"):
        generators.initial_schedule(v, e, perturbation=-0.1)


def test_sparse_pairs_cost_their_edges(spark):
    n, chance = 1_000_000, 1e-6
    got = generators.random_pairs(spark, n, chance, 5)
    rows = got.selectExpr("count(*) as c", "count(distinct u, v) as d", "min(u) as lo", "max(v) as hi", "count_if(u >= v) as bad").first()
    want = n * (n - 1) / 2 * chance
    assert abs(rows.c - want) < 6 * want**0.5 and rows.d == rows.c and rows.bad == 0 and rows.lo >= 0 and rows.hi < n
    few = generators.random_pairs(spark, 40, 1.0, 5)
    assert {(r.u, r.v) for r in few.collect()} == {(u, v) for v in range(40) for u in range(v)}
    one = {(r.u, r.v) for r in generators.random_pairs(spark, 300, 0.05, 9, 100).collect()}
    assert one == {(r.u, r.v) for r in generators.random_pairs(spark, 300, 0.05, 9, 100).repartition(5).collect()}
    assert abs(len(one) - 300 * 299 / 2 * 0.05) < 6 * 47


def test_catalog_of_documents(spark, tmp_path):
    """Bad documents are told, not fatal; an unfinished source keeps neither counts nor graphs, though its arrays are there."""
    from conflux.sources import catalog

    for name, text in {
        "a": '{"graph_id": "a", "source_group": 1, "arrays": true}',
        "b": '{"graph_id": "b", "source_group": 1, "arrays": false}',
        "c": '{"graph_id": "c", "source_group": 2, "arrays": true}',
        "d": '{"graph_id": "d", "arrays": true}',
        "e": '{"source_group": 1}',
        "f": '{"graph_id": ',
    }.items():
        (tmp_path / f"{name}.json").write_text(text)
    graphs, warnings = catalog.read_documents(spark, str(tmp_path), "graph_id string, source_group long, arrays boolean", "graph_id")
    assert {(r.file[-6:], r.warning) for r in warnings.collect()} == {("e.json", "no graph_id"), ("f.json", "unreadable")}
    rows = [("x", 1, "train", "success", 5, 2), ("y", 2, "test", "failed", 7, 3), ("z", 3, "test", None, None, None), ("n", None, "other", "success", 1, None)]
    sources = spark.createDataFrame(rows, "scene_id string, source_group long, split string, status string, full long, crossing long")
    listed, linked = catalog.catalog(sources, graphs, 4)
    assert {r.scene_id: (r.status, r.completed, r.full, r.completed_graphs) for r in listed.collect()} == {
        "x": ("success", True, 5, 1), "y": ("failed", False, None, 0), "z": ("not_generated", False, None, 0), "n": ("success", True, 1, 0),
    }
    assert {r.graph_id: r.completed for r in linked.collect()} == {"a": True, "b": False, "c": False, "d": False}
    got = catalog.catalog_summary(listed, linked).first().asDict()
    assert got == {
        "planned_sources": 4, "completed_sources": 2, "planned_graphs": 16, "completed_graphs": 1, "full": 6, "crossing": 2,
        "train_planned": 1, "train_completed": 1, "validation_planned": 0, "validation_completed": 0, "test_planned": 2, "test_completed": 0,
    }
