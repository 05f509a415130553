"""Contact and graph inputs: schemas, strict scans, their violation reports, and the stand-in built from ``events``."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scans

ANTENNA_GAP = 7_200_000_000
OWNER_GAP = 10_800_000_000

CONTACT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in "source_group geometry_id replicate_id epoch_utc contact_id pass_id satellite_id site_id antenna_id".split()]
    + [T.StructField(n, T.DecimalType(18, 9)) for n in "start_rel_seconds end_rel_seconds duration_seconds".split()]
    + [T.StructField(n, T.StringType()) for n in "start_utc end_utc boundary_crossing access_settings_hash".split()]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(ts: str) -> F.Column:
    """Microseconds of a zone-less timestamp, whatever the session's zone."""
    parts = F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + (F.expr(f"extract(second from {ts})") * 1_000_000).cast("long")
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000 + parts


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in contacts: cid, owner, ant, s, w, e (half-open microsecond intervals) of events with a positive value."""
    weight = F.round(F.col("value") * 100).cast("long") * 10_000
    rows = table(spark, sf_dir, "events").where("value > 0").select(
        F.col("event_id").alias("cid"), F.col("user_id").alias("owner"), F.get_json_object("props", "$.k").cast("int").alias("ant"), micros("ts").alias("s"), weight.alias("w")
    )
    return rows.withColumn("e", F.col("s") + F.col("w"))


def read_contacts_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 16-column contacts CSV, endpoints as exact decimals; malformed rows fail the query."""
    return spark.read.schema(CONTACT_SCHEMA).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def contact_violations(rows: DataFrame, horizon: int, source: str | None = None, stations: DataFrame | None = None) -> DataFrame:
    """(contact_id, rule) for every broken row rule."""
    tolerance = F.lit("0.000000002").cast("decimal(18,9)")
    rules = {
        "duplicate contact": F.count(F.lit(1)).over(_by("contact_id")) > 1,
        "duplicate window": F.count(F.lit(1)).over(_by("satellite_id", "antenna_id", "start_rel_seconds", "end_rel_seconds")) > 1,
        "bad interval": ~((F.col("start_rel_seconds") >= 0) & (F.col("start_rel_seconds") < F.col("end_rel_seconds")) & (F.col("end_rel_seconds") <= horizon)),
        "bad duration": F.abs(F.col("end_rel_seconds") - F.col("start_rel_seconds") - F.col("duration_seconds")) > tolerance,
        "boundary crossing": ~F.lower("boundary_crossing").isin("0", "false", "no", "none"),
        "no settings hash": F.coalesce(F.trim("access_settings_hash"), F.lit("")) == "",
    }
    if source is not None:
        rules["other source"] = ~F.col("source_group").eqNullSafe(source)
    found = rows.select("contact_id", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items()))).alias("rules"))
    out = found.select("contact_id", F.explode("rules").alias("rule"))
    if stations is not None:
        lost = rows.join(stations.select("site_id", "antenna_id"), ["site_id", "antenna_id"], "left_anti").select("contact_id", F.lit("unknown station").alias("rule"))
        out = out.unionByName(lost)
    return out


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def read_json_strict(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON (lines) under a declared schema; malformed records, NaN constants and keys given twice fail the query."""
    if repeated := repeated_keys(spark, path, multi_line).limit(1).collect():
        raise ValueError(f"{repeated[0].file}: malformed, key {repeated[0].key} is given twice")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).option("allowNonNumericNumbers", False).json(path)


def repeated_keys(spark: SparkSession, path: str, multi_line: bool = False, below: bool = False) -> DataFrame:
    """(file, key) of keys that one object holds twice, at any depth; the reader would keep one of them silently."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str]] = []
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):

                def held(pairs: list[tuple[str, object]], file: str = file) -> None:
                    seen: set[str] = set()
                    for key, _ in pairs:
                        if key in seen:
                            found.append((file, key))
                        seen.add(key)

                with contextlib.suppress(ValueError):  # the reader tells of what is not JSON
                    json.loads(text or "null", object_pairs_hook=held)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["file", "key"])

    texts = spark.read.option("recursiveFileLookup", below).text(path, wholetext=multi_line).select(F.input_file_name().alias("file"), "value")
    return texts.mapInArrow(run, "file string, key string")


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested snapshot documents anywhere below ``path``, flattened to one row per request."""
    if repeated := repeated_keys(spark, path, True, True).limit(1).collect():
        raise ValueError(f"{repeated[0].file}: malformed, key {repeated[0].key} is given twice")
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(path)
    return docs.select("snapshot_id", "snapshot.best_gain_seconds", F.explode("requests").alias("r")).select("snapshot_id", "best_gain_seconds", "r.*")


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """Report rows as text, with "", None, null, nan and infinities missing; the status sentinel row is dropped."""
    rows = spark.read.option("header", True).csv(path)
    missing = F.lower
    cleaned = rows.select(*(F.when(~missing(F.col(c)).isin("", "none", "null", "nan", "inf", "-inf", "infinity", "-infinity"), F.col(c)).alias(c) for c in rows.columns))
    return cleaned.where(F.coalesce(F.col("status") != "no_rows", F.lit(True))) if "status" in rows.columns else cleaned


def read_manifest(spark: SparkSession, path: str, allow_test: bool = False) -> DataFrame:
    """Manifest rows; fails if a source is in two splits, or asks for TEST without permission."""
    rows = spark.read.option("header", True).csv(path)
    leaks = rows.groupBy("source_group").agg(F.countDistinct("split").alias("n")).where("n > 1").limit(1).count()
    if leaks:
        raise ValueError("a source group is in more than one split")
    if not allow_test and rows.where("upper(split) = 'TEST'").limit(1).count():
        raise PermissionError("the test split is locked")
    return rows


def parse_graph_text(spark: SparkSession, path: str) -> DataFrame:
    """Weighted-graph text: header (magic n m), n lines (tick raw owner), m lines (u v), then k and k ids, in any lines.

    One row per part and place: vertex (a=tick, b=raw, c=owner), edge (a=u, b=v), initial (a=id) and size (a=k).
    """
    rows = _graph_lines(spark, path)
    part = F.when(F.col("at") <= F.col("n"), "vertex").otherwise("edge")
    own = rows.where("at <= n + m").select("file", part.alias("part"), (F.col("at") - 1 - F.when(F.col("at") > F.col("n"), F.col("n")).otherwise(0)).cast("long").alias("place"), F.split(F.trim("line"), r"\s+").alias("x"))
    own = own.select("file", "part", "place", *(F.get("x", F.lit(i)).alias(c) for i, c in enumerate("abc")))
    tail = _tail(rows)
    rest = tail.select("file", F.when(F.col("first"), "size").otherwise("initial").alias("part"), F.col("place"), F.col("x").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c"))
    return own.unionByName(rest)


def _graph_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"\s+$", ""), r"\n").alias("l"))
    head = F.split(F.trim(F.get("l", F.lit(0))), r"\s+")
    lines = lines.select("file", "l", F.get(head, F.lit(0)).alias("magic"), F.get(head, F.lit(1)).try_cast("long").alias("n"), F.get(head, F.lit(2)).try_cast("long").alias("m"))
    return lines.select("file", "magic", "n", "m", F.posexplode("l").alias("at", "line")).where("at > 0 or n is null or m is null")


def _tail(rows: DataFrame) -> DataFrame:
    """The words after the edges: (file, at, i, x), first for the number of ids; place counts ids from 0 in order of line and word."""
    words = rows.where("at > n + m").select("file", "n", "m", "at", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("i", "x")).where("x <> ''")
    numbered = scans.ranked(words, ["file"], ["at", "i"], "r")
    return numbered.select("file", "x", (F.col("r") == 1).alias("first"), F.greatest(F.lit(0), F.col("r") - 2).cast("long").alias("place"))


def graph_text_faults(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """(file, why) for what makes graph texts invalid: header, missing or surplus lines, bad vertices and edges, initial ids
    that are missing, left over, repeated, outside the graph or in conflict."""
    lines, rows = _graph_lines(spark, path), parse_graph_text(spark, path)
    say = lambda df, why: df.select("file", F.lit(why).alias("why")).distinct()
    out = say(lines.where(~F.coalesce((F.col("magic") == magic) & (F.col("n") >= 0) & (F.col("m") >= 0), F.lit(False))), "header")
    size = lines.groupBy("file", "n", "m").agg(F.max("at").alias("last"))
    out = out.unionByName(say(size.where("last < n + m + 1"), "truncated"))
    number = lambda c, kind="long": F.col(c).try_cast(kind)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    three = number("a").isNotNull() & number("b", "double").isNotNull() & number("c").isNotNull()
    out = out.unionByName(say(rows.where((F.col("part") == "vertex") & no(three)), "vertex"))
    bound = size.select("file", "n")
    inside = lambda c: (number(c) >= 0) & (number(c) < F.col("n"))
    edges = rows.where("part = 'edge'").join(bound, "file")
    out = out.unionByName(say(edges.where(no(inside("a") & inside("b") & (number("a") != number("b")))), "edge"))
    ids = rows.where("part = 'initial'").join(bound, "file")
    out = out.unionByName(say(ids.where(no(inside("a"))), "initial vertex"))
    out = out.unionByName(say(ids.groupBy("file", "a").count().where("count > 1"), "initial vertex"))
    told = rows.where("part = 'size'").select("file", number("a").alias("k"))
    have = size.select("file").join(told, "file", "left").join(ids.groupBy("file").agg(F.count(F.lit(1)).alias("have")), "file", "left")
    out = out.unionByName(say(have.where(no(F.col("k") == F.coalesce("have", F.lit(0)))), "initial size"))
    ends = edges.select("file", number("a").alias("u"), number("b").alias("v"))
    one = ids.select("file", number("a").alias("u"))
    return out.unionByName(say(ends.join(one, ["file", "u"], "left_semi").join(one.withColumnRenamed("u", "v"), ["file", "v"], "left_semi"), "infeasible initial")).distinct()


def decode_ragged(rows: DataFrame, flat: str, ptr: str) -> DataFrame:
    """Ragged arrays stored as a flat array and pointers: (group number, position, value) with the other columns."""
    keys = [c for c in rows.columns if c not in (flat, ptr)]
    number = F.explode(F.sequence(F.lit(0), F.size(ptr) - 2)).alias("g")
    cut = rows.where(F.size(ptr) > 1).select(*keys, flat, ptr, number)
    lo, hi = F.get(ptr, F.col("g")), F.get(ptr, F.col("g") + 1)
    return cut.select(*keys, "g", F.slice(F.col(flat), lo + 1, hi - lo).alias("part")).select(*keys, "g", F.posexplode("part").alias("i", "v"))


def membership_from_text(lines: DataFrame, n: int) -> DataFrame:
    """Solver output: a 0/1 vector of length n, or distinct 1-based ids, as 0-based members; repeated ids and ids outside 1..n are errors."""
    cells = lines.select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("i", "x"), F.monotonically_increasing_id().alias("at")).where("x <> ''").select(F.col("x").cast("long").alias("x"), "at", "i")
    told = cells.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isin(0, 1)).alias("bits"), F.min("x").alias("low"), F.max("x").alias("high"), F.countDistinct("x").alias("different")).first()
    if told.n == n and told.bits == n:
        return scans.ranked(cells, [], ["at", "i"], "v").where("x = 1").select((F.col("v") - 1).alias("v"))
    if told.n and (told.low < 1 or told.high > n):
        raise ValueError(f"ids must lie in 1..{n}")
    if told.different != told.n:
        raise ValueError("an id is given twice")
    return cells.select((F.col("x") - 1).alias("v"))
