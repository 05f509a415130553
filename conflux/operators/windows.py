"""Order-dependent checks and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def running_overlaps(rows: DataFrame, keys: list[str], start: str = "s", end: str = "e", id_col: str = "cid") -> DataFrame:
    """Per resource, how many windows start before the latest end seen so far (by start, id)."""
    seen = scans.running(rows.select(*keys, start, end, id_col), keys, [start, id_col], "_latest", F.col(end))
    return seen.withColumn("_hit", F.col(start) < F.col("_latest")).groupBy(*keys).agg(F.count_if("_hit").alias("overlaps"), F.count(F.lit(1)).alias("n"))


def setup_violations(rows: DataFrame, resource: str, setup: int, start: str = "s", end: str = "e", id_col: str = "cid") -> DataFrame:
    """Neighbours in time on one resource that are closer than the setup time."""
    near = scans.previous(rows.select(resource, start, end, id_col), [resource], [start, id_col], "_until", F.col(end))
    return near.withColumn("gap", F.col(start) - F.col("_until")).where(F.col("gap") < setup).select(resource, id_col, "gap")


def first_of_equal(rows: DataFrame, code: str, order: str) -> DataFrame:
    w = Window.partitionBy(code).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked_gain(rows: DataFrame, keys: list[str], order: list[Column], value: str, ks: list[int]) -> DataFrame:
    """Best positive value among the first k rows of each group, for every k."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_n", F.row_number().over(w))
    return ranked.groupBy(*keys).agg(*(F.coalesce(F.max(F.when(F.col("_n") <= k, F.greatest(F.col(value), F.lit(0.0)))), F.lit(0.0)).alias(f"top{k}") for k in ks))


def round_robin(rows: DataFrame, spent: DataFrame) -> DataFrame:
    """Requests (state, action, cap, idx) of each state in turn order: by turns its action has used, then action, cap, idx.

    Spent ones are left out; ``place`` counts from 1.
    """
    used = spent.groupBy("state", "action").agg(F.count(F.lit(1)).alias("turns"))
    open_ = rows.join(spent, ["state", "action", "cap", "idx"], "left_anti").join(used, ["state", "action"], "left").withColumn("turns", F.coalesce("turns", F.lit(0)))
    order = Window.partitionBy("state").orderBy("turns", "action", "cap", "idx")
    return open_.select("state", "action", "cap", "idx", "turns", F.row_number().over(order).alias("place"))


def first_minimum(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Earliest position of the strict minimum."""
    return rows.groupBy(*keys).agg(F.min(F.struct(value, at)).alias("m")).select(*keys, F.col(f"m.{at}").alias(at), F.col(f"m.{value}").alias(value))


def prefix(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap)


def backwards(rows: DataFrame, keys: list[str], order: str, clock: str) -> DataFrame:
    """Rows whose clock is not finite or runs back."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_p", F.lag(clock).over(w)).where(F.col(clock).isNull() | (F.col("_p") > F.col(clock))).drop("_p")


def positional_match(a: DataFrame, b: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Two interval lists met by position: counts, largest endpoint error, and whether they agree."""
    place = lambda x, n: x.select(*keys, F.col("s").alias(f"s{n}"), F.col("e").alias(f"e{n}"), F.row_number().over(Window.partitionBy(*keys).orderBy("s", "e")).alias("p"))
    both = place(a, 1).join(place(b, 2), [*keys, "p"], "full_outer")
    error = F.max(F.greatest(F.abs(F.col("s1") - F.col("s2")), F.abs(F.col("e1") - F.col("e2"))))
    out = both.groupBy(*keys).agg(F.count("s1").alias("n1"), F.count("s2").alias("n2"), error.alias("error"))
    return out.withColumn("agrees", (F.col("n1") == F.col("n2")) & (F.coalesce("error", F.lit(0)) <= tolerance))
