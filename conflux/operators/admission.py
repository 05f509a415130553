"""Event logs against deadlines, as batch queries; see conflux.streaming for the same on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans


def admitted(events: DataFrame, inclusive: bool = False) -> DataFrame:
    """Events (run, t, id, value, deadline) with ``on_time`` (strictly before the deadline unless inclusive).

    Late events stay and count 0; ``best`` is the running best of what is on time, by (t, id).
    """
    on_time = F.col("t") <= F.col("deadline") if inclusive else F.col("t") < F.col("deadline")
    rows = events.withColumn("on_time", on_time).withColumn("counted", F.when(F.col("on_time"), F.col("value")).otherwise(0.0))
    return scans.running(rows, ["run"], ["t", "id"], "best", F.when(F.col("on_time"), F.col("value")), inclusive=True)


def final_incumbents(events: DataFrame, initial: float = 0.0) -> DataFrame:
    """Per run: delivered best, counts, and the first event that reached it."""
    good = F.when(F.col("t") < F.col("deadline"), F.col("value"))
    best = F.max(F.struct(good.alias("v"), (-F.col("t")).alias("t"), (-F.col("id")).alias("id")))
    out = events.groupBy("run").agg(F.max(good).alias("delivered"), F.count(good).alias("on_time"), (F.count(F.lit(1)) - F.count(good)).alias("late"), best.alias("b"))
    return out.select("run", F.greatest(F.coalesce("delivered", F.lit(initial)), F.lit(initial)).alias("delivered"), "on_time", "late", F.when(F.col("delivered").isNotNull(), -F.col("b.id")).alias("winner"))


def prefix_split(events: DataFrame, prefix_kind: str) -> DataFrame:
    """Per run: value of the last timely event of the prefix kind, and of the last timely event of any kind."""
    timely = events.where("t < deadline")
    last = lambda c: F.max_by("value", F.when(c, F.struct("t", "id")))
    return timely.groupBy("run").agg(last(F.col("kind") == prefix_kind).alias("prefix_value"), last(F.lit(True)).alias("final_value"))


def affordable(requests: DataFrame, spent: DataFrame, remaining: float, strict: bool = False) -> DataFrame:
    """Requests not spent whose expected cost, and amount if in seconds, fit the rest of the budget.

    The two rules differ at equality on purpose: ``strict`` asks for less than the rest.
    """
    fits = (lambda c: c < remaining) if strict else (lambda c: c <= remaining)
    open_ = requests.join(spent, ["action", "cap", "workpoint"], "left_anti")
    return open_.where(fits(F.col("expected")) & ((F.col("kind") != "seconds") | fits(F.col("amount"))))


def call_counts(events: DataFrame) -> DataFrame:
    """Calls as told by the last finished event, else as observed, and then marked as not known to be complete."""
    told = F.max_by("calls", F.when(F.col("kind") == "finished", F.struct("t", "id")))
    seen = F.count_if(F.col("kind") == "request_started")
    return events.groupBy("run").agg(told.alias("told"), seen.alias("seen")).select("run", F.coalesce("told", "seen").alias("calls"), F.col("told").isNotNull().alias("known"))
