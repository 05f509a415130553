"""Strict statistics: a missing input gives a missing result, and levels are averaged one by one, never pooled."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conflux.functions.scalars import finite

from . import scans
from ..shared import stored


def complete_mean(x: Column) -> Column:
    """Mean, null if any member is missing."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.avg(x))


def strict_levels(rows: DataFrame, value: str, levels: list[list[str]], members: dict[int, int] | None = None) -> list[DataFrame]:
    """Means of stacked levels; ``levels`` go from fine to coarse keys, the last may be [] for the overall mean.

    A level's mean is null if any value below is missing, or if ``members`` names a number of members it does not have.
    """
    out, now = [], rows.withColumn("x", finite(F.col(value)))
    for i, keys in enumerate(levels):
        mean = complete_mean(F.col("x"))
        if members and i in members:
            mean = F.when(F.count(F.lit(1)) == members[i], mean)
        now = now.groupBy(*keys).agg(mean.alias("x"), F.count(F.lit(1)).alias("n"))
        out.append(now.select(*keys, F.col("x").alias("mean"), "n"))
    return out


def grid_mean(rows: DataFrame, keys: list[str], label: str, value: str, declared: list) -> DataFrame:
    """Mean per key only if the labels are exactly the declared ones, once each, with all values present."""
    exact = F.array_sort(F.collect_list(label)) == F.array(*(F.lit(x) for x in sorted(declared)))
    return rows.withColumn("_x", finite(F.col(value))).groupBy(*keys).agg(F.when(exact, complete_mean(F.col("_x"))).alias("mean"), F.count("_x").alias("complete"), (F.count(F.lit(1)) - F.count("_x")).alias("incomplete"))


def summary(x: str) -> list[Column]:
    """count, mean, median, 95th percentile (linear) and maximum of finite values."""
    v = finite(F.col(x))
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"), F.max(v).alias("max")]


def weighted_mean(rows: DataFrame, keys: list[str], weight: str, value: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("mass"))


def calibration(rows: DataFrame, policy: str, seconds: str) -> DataFrame:
    """Largest per-policy 95th percentile, times 1.2, and its half and quarter."""
    p95 = rows.groupBy(policy).agg(F.percentile(seconds, F.lit(0.95)).alias("p95"))
    return p95.agg(F.max("p95").alias("p95")).select("p95", (F.col("p95") * 1.2).alias("full"), (F.col("p95") * 0.6).alias("half"), (F.col("p95") * 0.3).alias("quarter"))


def repeat_mean(rows: DataFrame, keys: list[str], value: str, valid: str, context: str, repeats: int) -> DataFrame:
    """Mean over repeats if all are valid, agree in context and have the declared number."""
    fine = F.bool_and(F.coalesce(F.col(valid), F.lit(False))) & (F.countDistinct(context) == 1) & (F.count(F.lit(1)) == repeats)
    return rows.groupBy(*keys).agg(F.when(fine, complete_mean(finite(F.col(value)))).alias("mean"), F.count(F.lit(1)).alias("n"))


def best_extra(rows: DataFrame, keys: list[str], value: str, valid: str, least: float = 1e-9) -> DataFrame:
    """Best value over valid rows and whether it is an opportunity."""
    best = F.max(F.when(F.col(valid).eqNullSafe(True), F.col(value)))
    return rows.groupBy(*keys).agg(best.alias("best"), F.coalesce(best > least, F.lit(False)).alias("opportunity"))


def pair_counts(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key, of the rows with both values: n, all pairs, those tied in x, in y, in both, and concordant ones.

    No pair is made.  Ranks of x are compared bit by bit: two ranks part at one bit, above which they agree, so within
    the rows of one upper part those with that bit meet the earlier ones (smaller y) without it, counted by a running sum.
    That is n log n rows, and no key is scanned as a whole.
    """
    cells = stored(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_c")), "cells")
    two = lambda c: F.sum(F.expr(f"{c} * ({c} - 1) div 2"))

    def tied(*by: str) -> DataFrame:
        return cells.groupBy(*keys, *by).agg(F.sum("_c").alias("_s")).groupBy(*keys).agg(F.sum("_s").alias("n"), two("_s").alias("t"))

    ranks = stored(scans.ranked(cells.select(*keys, "_x").distinct(), keys, ["_x"], "_r").withColumn("_r", F.col("_r") - 1), "ranks")
    bits = int(ranks.agg(F.max("_r")).first()[0] or 0).bit_length()
    lines = cells.join(ranks, [*keys, "_x"]).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(max(bits - 1, 0)))))
    lines = lines.withColumns({"_upper": F.expr("shiftright(_r, _level + 1)"), "_bit": F.expr("shiftright(_r, _level) & 1")}).withColumn("_flip", 1 - F.col("_bit"))
    # of equal y the rows with the bit come first, and so do not meet each other
    seen = scans.running(lines, [*keys, "_level", "_upper"], ["_y", "_flip"], "_before", F.when(F.col("_bit") == 0, F.col("_c")).otherwise(0), "sum")
    found = seen.where("_bit = 1").groupBy(*keys).agg(F.sum(F.col("_c") * F.coalesce("_before", F.lit(0))).alias("concordant"))
    out = tied().select(*keys, "n", F.col("t").alias("pairs"))
    for name, by in (("tied_x", ["_x"]), ("tied_y", ["_y"]), ("tied_both", ["_x", "_y"])):
        out = out.join(tied(*by).select(*keys, F.col("t").alias(name)), keys)
    return out.join(found, keys, "left").withColumn("concordant", F.coalesce("concordant", F.lit(0)))


def reversals(rows: DataFrame, keys: list[str], item: str, low: str, high: str, tolerance: float = 1e-7) -> DataFrame:
    """Unordered pairs of items of a group whose order differs between two measures; without tolerance by ranks alone."""
    if not tolerance:
        n = pair_counts(rows, keys, low, high).where("pairs > 0")
        return n.select(*keys, "pairs", (F.col("pairs") - F.col("tied_x") - F.col("tied_y") + F.col("tied_both") - F.col("concordant")).alias("reversed"))
    sign = lambda x: F.when(x > tolerance, 1).when(x < -tolerance, -1).otherwise(0)
    a = rows.select(*keys, F.col(item).alias("a"), F.col(low).alias("la"), F.col(high).alias("ha"))
    b = rows.select(*keys, F.col(item).alias("b"), F.col(low).alias("lb"), F.col(high).alias("hb"))
    pairs = a.join(b, keys).where("a < b")
    turned = sign(F.col("la") - F.col("lb")) * sign(F.col("ha") - F.col("hb")) < 0
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(turned).alias("reversed"))


def seed_range(rows: DataFrame, keys: list[str], seed: str, value: str, seeds: int) -> DataFrame:
    """Mean, least and greatest over seeds, null unless all expected seeds are there."""
    fine = (F.countDistinct(seed) == seeds) & (F.count(F.lit(1)) == F.count(value))
    return rows.groupBy(*keys).agg(*(F.when(fine, f(value)).alias(n) for f, n in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"))))


def paired(rows: DataFrame, keys: list[str], method: str, base: str, other: str, value: str) -> DataFrame:
    """Difference of two methods per key; a missing side stays, with a reason."""
    side = lambda m, n: rows.where(F.col(method) == m).select(*keys, F.col(value).alias(n))
    both = side(base, "base").join(side(other, "other"), keys, "full_outer")
    reason = F.concat_ws("+", F.when(F.col("base").isNull(), "no base"), F.when(F.col("other").isNull(), "no other"))
    return both.select(*keys, "base", "other", (F.col("base") - F.col("other")).alias("delta"), reason.alias("reason"))


#: Units of a stratum, and draws, that one task of ``bootstrap`` holds, and picks that it makes at a time.
BLOCK, DRAWS, PICKS = 1 << 20, 8, 1 << 20


def bootstrap_picks(draw: int, places: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Places from 0 of the units that the picks ``places`` (from 1) of a draw hit; whole numbers that never pass 64 bits."""
    base = (places % 4294967291 * 104729 + (draw * 7919 + seed) % 4294967291) % 4294967291
    low = (base & 0xFFFF) * 2654435761
    return (((base >> 16) * 2654435761 % 4294967291 << 16) + low) % 4294967291 % size


def bootstrap(rows: DataFrame, stratum: str, unit: str, value: str, draws: int, seed: int) -> DataFrame:
    """(draw, mean): mean over strata of the mean of resampled units, with hash-drawn indices.

    Units come in blocks by rank, once for every few draws; a task makes the draws' picks a piece at a time and sums those
    that fall into its block, so no pick is a row.
    """
    named = rows.select(F.col(stratum).cast("string").alias("stratum"), unit, F.col(value).cast("double").alias("x"))
    ranked = scans.ranked(named, ["stratum"], [unit], "_n")
    held = ranked.join(ranked.groupBy("stratum").agg(F.max("_n").alias("_size")), "stratum").select("stratum", F.expr(f"(_n - 1) div {BLOCK}").alias("block"), "_size", "_n", "x")
    parts = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS))))

    def run(t: pa.Table) -> pa.Table:
        name, block, n, part = (t.column(c)[0].as_py() for c in ("stratum", "block", "_size", "part"))
        t = t.sort_by("_n")
        known = t.column("x").is_valid().to_numpy(zero_copy_only=False)
        x = np.where(known, t.column("x").to_numpy(zero_copy_only=False), 0.0).astype(np.float64)
        out = []
        for draw in range(part * DRAWS + 1, min(draws, (part + 1) * DRAWS) + 1):
            total, number = 0.0, 0
            for first in range(1, n + 1, PICKS):
                hit = bootstrap_picks(draw, np.arange(first, min(n + 1, first + PICKS), dtype=np.int64), n, seed) - block * BLOCK
                hit = hit[(hit >= 0) & (hit < len(x))]
                total, number = total + float(x[hit].sum()), number + int(known[hit].sum())
            out.append((name, draw, total, number))
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("stratum", "draw", "total", "n"), zip(*out, strict=True), (pa.string(), pa.int32(), pa.float64(), pa.int64()), strict=True)})

    each = parts.groupBy("stratum", "block", "part").applyInArrow(run, "stratum string, draw int, total double, n long")
    means = each.groupBy("draw", "stratum").agg(F.when(F.sum("n") > 0, F.sum("total") / F.sum("n")).alias("m"))
    return means.groupBy("draw").agg(F.avg("m").alias("mean"))


#: Units that one task of the bootstrap holds, and draws that it makes at a time.
UNITS, AT_ONCE = 1024, 1000


def bootstrap_interval(rows: DataFrame, stratum: str, unit: str, value: str, draws: int = 10_000, seed: int = 1979, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """One row (draws, mean, low, high) of the mean over strata, each of the same mass, of the mean of its resampled units.

    A draw gives every unit a number of copies, as many in all as the stratum has units.  Units come in blocks, and how many
    copies a block gets in each draw is split off binomially on the way down a tree over the blocks, by generators that
    are seeded by place: a block finds its own counts without seeing another.  So rows are blocks times draws at most.
    """
    ranked = scans.ranked(rows.select(stratum, unit, value), [stratum], [unit], "_n")
    size = ranked.groupBy(stratum).agg(F.max("_n").alias("_size"))
    blocks = ranked.join(size, stratum).select(F.col(stratum).cast("string").alias("stratum"), F.expr(f"(_n - 1) div {UNITS}").alias("block"), "_size", F.col("_n"), F.col(value).cast("double").alias("x"))

    def run(t: pa.Table) -> pa.Table:
        name, block, n = (t.column(c)[0].as_py() for c in ("stratum", "block", "_size"))
        at = zlib.crc32(repr(name).encode())
        x = t.sort_by("_n").column("x").to_numpy()
        counts, lo, hi = np.full(draws, n), 0, -(-n // UNITS)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = np.random.default_rng([seed, at, lo, hi]).binomial(counts, (mid - lo) * UNITS / (min(n, hi * UNITS) - lo * UNITS))
            counts, lo, hi = (left, lo, mid) if block < mid else (counts - left, mid, hi)
        rnd = np.random.default_rng([seed, at, lo, hi, 1])
        share = np.full(len(x), 1 / len(x))
        total = np.concatenate([rnd.multinomial(counts[k : k + AT_ONCE], share) @ x for k in range(0, draws, AT_ONCE)])
        return pa.table({"stratum": pa.array([name] * draws, pa.string()), "draw": np.arange(draws), "total": total / n})

    each = blocks.groupBy("stratum", "block").applyInArrow(run, "stratum string, draw long, total double")
    by_draw = each.groupBy("stratum", "draw").agg(F.sum("total").alias("m")).groupBy("draw").agg(F.avg("m").alias("m"))
    return by_draw.agg(F.count(F.lit(1)).alias("draws"), F.avg("m").alias("mean"), *(F.percentile("m", F.lit(p)).alias(k) for k, p in zip(("low", "high"), levels, strict=True)))


def plan_gaps(plan: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """Declared cells that were not received."""
    return plan.select(*keys).distinct().join(received.select(*keys).distinct(), keys, "left_anti")
