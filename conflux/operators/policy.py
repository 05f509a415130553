"""Order of requests under pluggable priorities, and the calls of one budgeted run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats

#: Built-in priorities: score of a request from its q (immediate), lower, upper and p1 values.
PRIORITIES: dict[str, Callable[[], Column]] = {
    "upper": lambda: F.col("q") + F.col("upper"),
    "lower": lambda: F.col("q") + F.col("lower"),
    "p1": lambda: F.col("q") + F.col("p1"),
    "immediate": lambda: F.col("q"),
}


def requests(actions: DataFrame, caps: list[int], workpoints: list[tuple[str, float, float]]) -> DataFrame:
    """actions x caps x workpoints (both short lists), without caps that give the same pool as a smaller one."""
    pts = F.explode(F.array(*(F.struct(F.lit(n).alias("workpoint"), F.lit(float(a)).alias("amount"), F.lit(float(c)).alias("expected")) for n, a, c in workpoints)))
    rows = actions.withColumn("cap", F.explode(F.array(*(F.lit(c) for c in sorted(caps))))).withColumn("used", F.least("cap", "pool_size"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("action", "used").orderBy("cap"))).where("_n = 1").drop("_n")
    return rows.withColumn("_w", pts).select("*", "_w.*").drop("_w")


def fixed_call_order(rows: DataFrame, incumbent: float) -> DataFrame:
    """Rank by marginal gain per cost, then gain per cost, then index."""
    per = lambda x: F.greatest(F.lit(0.0), x) / F.col("cost")
    w = Window.partitionBy("run").orderBy(F.desc(per(F.col("predicted") - incumbent)), F.desc(per(F.col("predicted"))), "idx")
    return rows.withColumn("turn", F.row_number().over(w))


def offline_regret(rows: DataFrame) -> DataFrame:
    """Per state: value of the chosen request (largest predicted gain per cost) against the best by truth per cost."""
    chosen = F.max_by("truth", F.struct((F.greatest(F.col("predicted"), F.lit(0.0)) / F.col("cost")).alias("s"), (-F.col("idx")).alias("i")))
    best = F.max_by("truth", F.struct((F.greatest(F.col("truth"), F.lit(0.0)) / F.col("cost")).alias("s"), (-F.col("idx")).alias("i")))
    return rows.groupBy("state").agg(chosen.alias("chosen"), best.alias("oracle")).withColumn("regret", F.col("oracle") - F.col("chosen"))


def pair_accuracy(rows: DataFrame, known: Column) -> DataFrame:
    """Per state of requests (state, predicted, truth): unequal_pairs, and the share that the prediction orders rightly.

    The truth of a request is what it adds to the gain that is ``known``, not below 0; predicted ties count a half; accuracy
    is null where no two requests differ.
    """
    wanted = rows.withColumn("_wanted", F.greatest(F.col("truth") - known, F.lit(0.0)))
    n = stats.pair_counts(wanted, ["state"], "predicted", "_wanted")
    unequal = F.col("pairs") - F.col("tied_y")
    half = (F.col("tied_x") - F.col("tied_both")) * 0.5
    return n.select("state", unequal.alias("unequal_pairs"), F.when(unequal > 0, (F.col("concordant") + half) / unequal).alias("accuracy"))


def admission_quota(rows: DataFrame, budget: float, quota: int) -> DataFrame:
    """Ranked calls of each run taken in order while they fit; one that does not fit is skipped and costs no quota."""
    packed = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("turn", "idx", "cost"))).alias("calls"))

    def step(state: Column, call: Column) -> Column:
        fits = (state["left"] >= call["cost"]) & (F.size(state["taken"]) < quota)
        return F.struct(
            F.when(fits, state["left"] - call["cost"]).otherwise(state["left"]).alias("left"), F.when(fits, F.concat(state["taken"], F.array(call["idx"]))).otherwise(state["taken"]).alias("taken")
        )

    start = F.struct(F.lit(float(budget)).alias("left"), F.array().cast("array<bigint>").alias("taken"))
    return packed.select("run", F.aggregate("calls", start, step).alias("r")).select("run", "r.left", F.posexplode("r.taken").alias("place", "idx"))
