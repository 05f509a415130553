"""One step of history: each state takes exactly one request that was declared beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans
from ..shared import stored


def declared(actions: DataFrame, trajectory: int) -> DataFrame:
    """The action of each state at place ``trajectory`` modulo their number, of its prepared actions (state, place, action).

    Places need not be without gaps; equal ones go by action.  A state may hold most of all actions.
    """
    number = actions.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    placed = scans.ranked(actions.select("state", "place", "action"), ["state"], ["place", "action"], "at")
    return placed.join(number, "state").where(F.col("at") - 1 == F.pmod(F.lit(trajectory), F.col("n"))).select("state", "action")


def stepped(states: DataFrame, actions: DataFrame, outcomes: DataFrame, warm: DataFrame, spent: DataFrame, trajectory: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States, warm values and spent requests after one declared request of each state.

    states(state, original, best), outcomes(state, action, recovery, complete) of returned requests, warm(state, action, value),
    spent(state, action).  The request is spent whatever becomes of it.  A recovery above its action's warm value replaces it
    (or is the first), a complete value above the best becomes the best; equal ones change nothing, and one that is null
    or did not return neither.  ``gain`` is best - original, at least 0.  A state without prepared actions stays as it is, with
    status no_prepared_actions.  Outcomes have one row per request.
    """
    asked = stored(declared(actions.join(states.select("state"), "state", "left_semi"), trajectory), "asked")
    called = stored(asked.join(outcomes.select("state", "action", "recovery", "complete", F.lit(True).alias("returned")), ["state", "action"], "left"), "called")
    rows = states.join(called, "state", "left")
    best = F.when(F.col("complete") > F.col("best"), F.col("complete")).otherwise(F.col("best"))
    status = F.when(F.col("action").isNull(), "no_prepared_actions").when(F.col("returned").isNull(), "not_returned").otherwise("returned")
    zero = F.lit(0).cast("long")
    after = rows.select("state", status.alias("status"), "action", "original", best.alias("best"), F.greatest(zero, best - F.col("original")).alias("gain"))
    held = warm.join(called.select("state", "action", "recovery"), ["state", "action"], "full_outer")
    value = F.when(F.col("value").isNull() | (F.col("recovery") > F.col("value")), F.coalesce("recovery", "value")).otherwise(F.col("value"))
    warmer = held.select("state", "action", value.alias("value"), (~value.eqNullSafe(F.col("value"))).alias("changed")).where("value is not null")
    return after, warmer, spent.select("state", "action").union(asked).distinct()
