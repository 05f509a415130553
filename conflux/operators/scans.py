"""Ranks, running values and predecessors of keys of any size.

A window partitioned by key sorts the key's whole history in one task.  Here rows are sorted by (keys, order) over ranges
that cut a large key into as many pieces as it needs; each range is scanned by itself, each leaves one row per key behind
(its largest, last or summed value), and a second, small scan over these rows gives every range what came before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def ranged(rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` in the order of (keys, order), with ``_at``, which rises along it, and ``_range``, the piece they are in."""
    number = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)
    by = [*keys, *order]
    out = rows.repartitionByRange(number, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return stored(out, "ranges").withColumn("_range", F.shiftright("_at", 33))


def _carried(pieces: DataFrame, keys: list[str], own: Column, carry: Column) -> DataFrame:
    """``pieces`` with what the earlier ranges of the same keys leave behind, as ``_carry``; keys may be null."""
    left = pieces.groupBy(*keys, "_range").agg(own.alias("_own")).withColumn("_carry", carry)
    left = left.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_scan_r"), "_carry")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_range") == F.col("_scan_r"))
    return pieces.join(left, same).drop("_scan_r", *(f"_k_{k}" for k in keys))


def running(rows: DataFrame, keys: list[str], order: list[str], name: str, value: Column, kind: str = "max", inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the largest (``max``) or summed (``sum``) value of the rows before, or up to, each of its key."""
    f = {"max": F.max, "sum": F.sum}[kind]
    both = F.greatest if kind == "max" else lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = _carried(ranged(rows.withColumn("_scan_v", value), keys, order, ranges), keys, f("_scan_v"), f("_own").over(before))
    own = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return pieces.withColumn(name, both(F.col("_carry"), f("_scan_v").over(own))).drop("_scan_v", "_at", "_range", "_carry")


def running_sums(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with the sums of several values over the rows before each of its key, 0 for none, in one scan; no value may be null."""
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    valued = rows.withColumn("_scan_v", F.struct(*(v.alias(n) for n, v in values.items())))
    own = F.struct(*(F.sum(F.col("_scan_v")[n]).alias(n) for n in values))
    carry = F.struct(*(F.coalesce(F.sum(F.col("_own")[n]).over(before), F.lit(0)).alias(n) for n in values))
    pieces = _carried(ranged(valued, keys, order, ranges), keys, own, carry)
    here = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.col("_carry")[n] + F.coalesce(F.sum(F.col("_scan_v")[n]).over(here), F.lit(0))).alias(n) for n in values]
    return pieces.select("*", *sums).drop("_scan_v", "_at", "_range", "_carry")


def previous(rows: DataFrame, keys: list[str], order: list[str], name: str, value: Column, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the value of the row just before, of the same key."""
    pieces = ranged(rows.withColumn("_scan_v", value), keys, order, ranges)
    pieces = _carried(pieces, keys, F.max_by("_scan_v", "_at"), F.lag("_own").over(Window.partitionBy(*keys).orderBy("_range")))
    own = Window.partitionBy(*keys, "_range").orderBy("_at")
    found = F.when(F.row_number().over(own) == 1, F.col("_carry")).otherwise(F.lag("_scan_v").over(own))
    return pieces.withColumn(name, found).drop("_scan_v", "_at", "_range", "_carry")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: their number within the key, from 1."""
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # rows of one key and range follow one another
    carry = F.coalesce(F.sum("_own.n").over(before), F.lit(0)) - F.col("_own.first")
    pieces = _carried(ranged(rows, keys, order, ranges), keys, F.struct(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")), carry)
    return pieces.withColumn(name, F.col("_at") + F.col("_carry") + 1).drop("_at", "_range", "_carry")
