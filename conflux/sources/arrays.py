"""Graphs as compressed array files, one file a graph, and as kernel text.

Read, a graph is rows (graph_id, part, i, j, x): ``vertex`` (i = id, j = owner, x = weight), ``edge`` (i < j), ``member`` (i =
a vertex of the initial selection) and ``clique`` (i = its number, j = a vertex).  A file is read or written by one task,
which holds that one graph.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "graph_id string, part string, i long, j long, x double"


def _whole(x: np.ndarray, name: str) -> np.ndarray:
    if x.dtype.kind not in "iu":
        raise ValueError(f"{name} must be whole numbers")
    return x.astype(np.int64)


def checked(arrays: dict[str, np.ndarray], unit: bool = False) -> dict[str, np.ndarray]:
    """weights, edges (sorted, u < v), agents, selected and cliques of one graph; raises where the arrays contradict.

    ``unit`` asks for weights of 1 and edges that are given in order.
    """
    w = np.asarray(arrays["weights"], dtype=np.float64)
    if w.ndim != 1 or not np.isfinite(w).all() or (w < 0).any():
        raise ValueError("weights must be one row of finite numbers from 0 on")
    if unit and (w != 1).any():
        raise ValueError("weights of a unit graph must be 1")
    if "edges" in arrays:
        e = np.asarray(arrays["edges"])
        if e.size and (e.ndim != 2 or e.shape[1] != 2):
            raise ValueError("edges must be rows of two vertices")
        e = _whole(e, "edges") if e.size else np.zeros((0, 2), np.int64)
    elif {"edge_u", "edge_v"} <= set(arrays):
        e = np.stack([_whole(arrays["edge_u"], "edge_u"), _whole(arrays["edge_v"], "edge_v")], axis=1)
    else:
        raise ValueError("edges are missing")
    if (e < 0).any() or (e >= len(w)).any() or (e[:, 0] == e[:, 1]).any():
        raise ValueError("an edge is a loop or leaves the graph")
    if unit and ((e[:, 0] >= e[:, 1]).any() or (np.diff(e[:, 0] * len(w) + e[:, 1]) <= 0).any()):
        raise ValueError("edges of a unit graph must rise")
    e = np.sort(e, axis=1)
    e = e[np.lexsort((e[:, 1], e[:, 0]))]
    if len(e) > 1 and (e[1:] == e[:-1]).all(axis=1).any():
        raise ValueError("an edge is given twice")
    agents = _whole(arrays["agents"], "agents") if "agents" in arrays else np.full(len(w), -1)
    if agents.shape != w.shape:
        raise ValueError("agents and weights differ in length")
    if "selected" in arrays:
        selected = np.unique(_whole(arrays["selected"], "selected"))
        if len(selected) != arrays["selected"].size or (selected < 0).any() or (selected >= len(w)).any():
            raise ValueError("selected must be different vertices")
    else:
        mask = np.asarray(arrays.get("initial_mask", np.zeros(len(w), np.int8)))
        if mask.shape != w.shape or not ((mask == 0) | (mask == 1)).all():
            raise ValueError("initial_mask must hold 0 or 1 for each vertex")
        selected = np.flatnonzero(mask)
    chosen = np.zeros(len(w), bool)
    chosen[selected] = True
    if (chosen[e[:, 0]] & chosen[e[:, 1]]).any():
        raise ValueError("the initial selection has an edge inside")
    flat, ptr = _whole(arrays.get("cliques_flat", np.zeros(0, np.int64)), "cliques_flat"), _whole(arrays.get("cliques_ptr", np.zeros(1, np.int64)), "cliques_ptr")
    if ptr[0] != 0 or ptr[-1] != len(flat) or (np.diff(ptr) < 0).any() or (flat < 0).any() or (flat >= len(w)).any():
        raise ValueError("cliques_ptr does not fit cliques_flat")
    return {"weights": w, "edges": e, "agents": agents, "selected": selected, "cliques_flat": flat, "cliques_ptr": ptr}


def read_graph_arrays(spark: SparkSession, path: str, unit: bool = False) -> DataFrame:
    """Rows of every ``.npz`` file under ``path``; the graph's id is in the file, else the file's name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        arrays = {k: z[k] for k in z.files}
                    g = checked(arrays, unit)
                except (ValueError, KeyError) as why:
                    raise ValueError(f"{name}: {why}") from why
                graph = str(arrays["graph_id"].item()) if "graph_id" in arrays else name.rsplit("/", 1)[-1].removesuffix(".npz")
                n = len(g["weights"])
                clique = np.repeat(np.arange(len(g["cliques_ptr"]) - 1), np.diff(g["cliques_ptr"]))
                for part, i, j, x in (
                    ("vertex", np.arange(n), g["agents"], g["weights"]), ("edge", g["edges"][:, 0], g["edges"][:, 1], None), ("member", g["selected"], None, None), ("clique", clique, g["cliques_flat"], None)
                ):
                    yield pd.DataFrame({"graph_id": graph, "part": part, "i": i, "j": pd.array([None] * len(i), "Int64") if j is None else j, "x": np.nan if x is None else x})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    told = _manifest(spark, path)
    if told is not None:  # files of attempts that failed may lie beside those that count
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(told.select("name"), "name", "left_semi").select("path", "content")
    rows = files.mapInPandas(run, ROWS)
    return rows.withColumn("x", F.when(F.col("part") == "vertex", F.col("x")))


def _manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_manifest")
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema("graph_id string, name string, bytes long").parquet(str(place)) if there else None


def write_graph_arrays(rows: DataFrame, folder: str) -> DataFrame:
    """Writes one ``.npz`` file for each graph of rows as above; returns the manifest (graph_id, name, bytes).

    A file's name ends in that of the attempt that wrote it, so a task that runs again disturbs nothing.  The manifest
    names the files that count and is committed last; a folder that has one is not written again.
    """
    spark = rows.sparkSession
    if _manifest(spark, folder) is not None:
        raise FileExistsError(folder)

    def run(t: pa.Table) -> pa.Table:
        frame = t.to_pandas().sort_values(["part", "i", "j"])
        graph = frame["graph_id"].iloc[0]
        of = {k: v for k, v in frame.groupby("part")}
        part = lambda k: of.get(k, frame.iloc[:0])
        v, e, c = part("vertex"), part("edge"), part("clique")
        if v["i"].tolist() != list(range(len(v))):
            raise ValueError(f"{graph}: vertices must be numbered from 0 on")
        arrays = {
            "weights": v["x"].to_numpy(np.float64), "agents": v["j"].fillna(-1).to_numpy(np.int64), "edges": e[["i", "j"]].to_numpy(np.int64).reshape(-1, 2), "selected": part("member")["i"].to_numpy(np.int64),
            "cliques_flat": c["j"].to_numpy(np.int64), "cliques_ptr": np.append(0, np.cumsum(np.bincount(c["i"].to_numpy(np.int64))) if len(c) else []).astype(np.int64),
        }
        checked(arrays)
        held = io.BytesIO()
        np.savez_compressed(held, graph_id=np.array(graph), **arrays)
        at, place = fs.FileSystem.from_uri(folder)
        at.create_dir(place, recursive=True)
        name = f"{graph}.{uuid.uuid4().hex}.npz"
        with at.open_output_stream(f"{place}/{name}", compression=None) as out:
            out.write(held.getvalue())
        return pa.table({"graph_id": [graph], "name": [name], "bytes": [len(held.getvalue())]})

    written = rows.select("graph_id", "part", "i", "j", "x").groupBy("graph_id").applyInArrow(run, "graph_id string, name string, bytes long")
    written.write.parquet(f"{folder.rstrip('/')}/_manifest")
    out = _manifest(spark, folder)
    assert out is not None
    return out


def numbered_lines(spark: SparkSession, parts: list[tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """(part, first, second, line): rows of the parts one after another, each by its order columns, values parted by spaces."""
    out = None
    for number, (rows, order, columns) in enumerate(parts):
        place = [F.col(c).cast("long") for c in order] + [F.lit(0).cast("long")] * (2 - len(order))
        lines = rows.select(F.lit(number).alias("part"), place[0].alias("first"), place[1].alias("second"), F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    assert out is not None
    return out


def _one(spark: SparkSession, text: str) -> tuple[DataFrame, list[str], list[str]]:
    return spark.createDataFrame([(text,)], "text string"), [], ["text"]


def graph_lines(vertices: DataFrame, edges: DataFrame, initial: DataFrame, magic: str) -> DataFrame:
    """Text of one graph: ``magic n m``, a line ``tick raw owner`` for each vertex (v), one ``u v`` for each edge, the number of initial ids, a line for each."""
    spark = vertices.sparkSession
    head = _one(spark, f"{magic} {vertices.count()} {edges.count()}")
    return numbered_lines(spark, [head, (vertices, ["v"], ["tick", "raw", "owner"]), (edges, ["u", "v"], ["u", "v"]), _one(spark, str(initial.count())), (initial, ["v"], ["v"])])


KERNEL = ["w", "raw", "owner", "color", "base", "p", "q", "freq", "id"]


def kernel_lines(vertices: DataFrame, edges: DataFrame, magic: str) -> DataFrame:
    """Text of a frozen kernel: ``magic n m``, the columns of ``KERNEL`` for each vertex (v), ``u v`` for each edge."""
    spark = vertices.sparkSession
    return numbered_lines(spark, [_one(spark, f"{magic} {vertices.count()} {edges.count()}"), (vertices, ["v"], KERNEL), (edges, ["u", "v"], ["u", "v"])])


def parse_kernel_text(spark: SparkSession, path: str, magic: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, faults) of kernel files; faults (file, at, why) is empty for valid ones.

    A color is -1, 0 or 1, base, p and q are 0 or 1, a coloured vertex has a parent and an uncoloured one neither a parent
    nor a base, freq lies in [0, 1], ids differ; no line is missing or left over.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"\s+$", ""), r"\n").alias("l"))
    files = files.withColumn("head", F.split(F.get("l", F.lit(0)), " ")).withColumn("n", F.get("head", F.lit(1)).try_cast("long")).withColumn("m", F.get("head", F.lit(2)).try_cast("long"))
    right = (F.get("head", F.lit(0)) == magic) & (F.size("l") == 1 + F.col("n") + F.col("m"))
    faults = files.where(~F.coalesce(right, F.lit(False))).select("file", F.lit(0).cast("long").alias("at"), F.lit("header or number of lines").alias("why"))
    rows = files.select("file", "n", F.posexplode("l").alias("at", "line")).where("at > 0").withColumn("x", F.split(F.trim("line"), r"\s+"))
    kinds = ["long", "double", "long", "int", "int", "int", "int", "double", "long"]
    own = rows.where("at <= n").select("file", (F.col("at") - 1).cast("long").alias("v"), *(F.get("x", F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate(zip(KERNEL, kinds, strict=True))))
    bits = F.col("base").isin(0, 1) & F.col("p").isin(0, 1) & F.col("q").isin(0, 1) & F.col("color").isin(-1, 0, 1)
    support = ((F.col("color") >= 0) == ((F.col("p") == 1) | (F.col("q") == 1))) & ((F.col("color") >= 0) | (F.col("base") == 0))
    good = bits & support & F.col("freq").between(0, 1) & (F.col("id") >= 0) & F.col("w").isNotNull() & F.col("raw").isNotNull() & F.col("owner").isNotNull()
    faults = faults.unionByName(own.where(~F.coalesce(good, F.lit(False))).select("file", "v", F.lit("vertex").alias("why")).withColumnRenamed("v", "at"))
    twice = own.groupBy("file", "id").agg(F.count(F.lit(1)).alias("c"), F.max("v").alias("at")).where("c > 1")
    faults = faults.unionByName(twice.select("file", "at", F.lit("repeated id").alias("why")))
    edges = rows.where("at > n").select("file", "n", (F.col("at") - 1).cast("long").alias("at"), F.get("x", F.lit(0)).try_cast("long").alias("u"), F.get("x", F.lit(1)).try_cast("long").alias("v"))
    inside = (F.col("u") >= 0) & (F.col("u") < F.col("n")) & (F.col("v") >= 0) & (F.col("v") < F.col("n")) & (F.col("u") != F.col("v"))
    faults = faults.unionByName(edges.where(~F.coalesce(inside, F.lit(False))).select("file", "at", F.lit("edge").alias("why")))
    return own, edges.select("file", "u", "v"), faults
