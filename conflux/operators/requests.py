"""Actions worth trying, requests made for them, and what their labels say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairs, scans
from ..shared import stored


def proposals(vertices: DataFrame, edges: DataFrame, blocked: DataFrame, sel: DataFrame, most: int = 12, pool: int = 64, candidates: DataFrame | None = None, whole: int = 160) -> DataFrame:
    """(place, a, b, gain) of the action pool: singles (b null) and compatible pairs of two owners, by immediate gain.

    Of more than ``whole`` vertices only the ``pool`` unselected ones of largest gain are considered, so pairs are at most
    pool^2 / 2; of fewer, or with ``candidates`` (cid), which take the place of that choice, all unselected ones are.  The
    first half of ``most``, rounded up, goes to singles, the rest to pairs, and singles fill what pairs leave open.
    """
    d = pairs.deficits(vertices, blocked, sel)
    ones = d.select("cid", "w", "owner", (-F.col("d")).alias("gain"))
    if candidates is not None:
        ones = ones.join(candidates.select("cid").distinct(), "cid", "left_semi")
    elif vertices.limit(whole + 1).count() > whole:
        ones = ones.orderBy(F.desc("gain"), "cid").limit(pool)
    two = pairs.compatible_pairs(ones.withColumn("action", F.lit(0)), edges, blocked.join(ones, "cid", "left_semi"))
    singles = ones.select(F.col("cid").alias("a"), F.lit(None).cast("long").alias("b"), "gain", F.lit(1).alias("kind"))
    rows = singles.unionByName(two.select(F.col("u").alias("a"), F.col("v").alias("b"), "gain", F.lit(2).alias("kind")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("gain"), "a", "b"))).where(F.col("n") <= most)
    quota = max(1, (most + 1) // 2)
    # singles within the quota, then pairs, then the other singles
    turn = F.when((F.col("kind") == 1) & (F.col("n") <= quota), 0).when(F.col("kind") == 2, 1).otherwise(2)
    chosen = rows.orderBy(turn, "n").limit(most)
    return chosen.select(F.row_number().over(Window.orderBy(F.desc("gain"), "a", F.col("b").asc_nulls_first())).alias("place"), "a", "b", "gain")


def diverse_proposals(vertices: DataFrame, edges: DataFrame, blocked: DataFrame, sel: DataFrame, seed: int, most: int = 16, pool: int = 64) -> DataFrame:
    """(kind, place, a, b, gain): half of ``most`` singles (kind 1), half compatible pairs of two owners (2), part of each at random.

    Half of the pool are the unselected vertices of largest gain, half are drawn from the others.  Of either kind the first
    half of its quota goes to the largest gains, and the rest is drawn from what remains.  Draws order by a hash of seed and
    ids, so they do not depend on partitions.
    """
    shuffled = lambda *ids: F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(",", *ids)))
    d = pairs.deficits(vertices, blocked, sel).select("cid", "w", "owner", (-F.col("d")).alias("gain"))
    first = stored(d.orderBy(F.desc("gain"), "cid").limit(pool // 2), "first")
    drawn = d.join(first.select("cid"), "cid", "left_anti").orderBy(shuffled(F.col("cid").cast("string")), "cid").limit(pool - pool // 2)
    ones = stored(first.unionByName(drawn), "pool")
    two = pairs.compatible_pairs(ones.withColumn("action", F.lit(0)), edges, blocked.join(ones, "cid", "left_semi"))
    singles = ones.select(F.col("cid").alias("a"), F.lit(None).cast("long").alias("b"), "gain", F.lit(1).alias("kind"))
    rows = singles.unionByName(two.select(F.col("u").alias("a"), F.col("v").alias("b"), "gain", F.lit(2).alias("kind")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("gain"), "a", "b")))
    quota = F.when(F.col("kind") == 1, most // 2).otherwise(most - most // 2)
    late = F.col("n") > F.greatest(F.lit(1), F.expr(f"case kind when 1 then {most // 2 // 2} else {(most - most // 2) // 2} end"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(late, F.when(late, shuffled(text("a"), text("b"))), "n"))
    return rows.withColumn("place", place).where(F.col("place") <= quota).select("kind", "place", "a", "b", "gain")


def seeds(vertices: DataFrame, blocked: DataFrame, sel: DataFrame, most: int = 128) -> DataFrame:
    """(cid, score) of the best seeds: weight / (scale + weight of its blockers), then id; scale is the mean weight, 1 at least."""
    scale = vertices.agg(F.greatest(F.lit(1.0), F.coalesce(F.sum("w").cast("double") / F.count(F.lit(1)), F.lit(0.0)))).first()[0]
    d = pairs.deficits(vertices, blocked, sel)
    score = F.col("w").cast("double") / (F.lit(scale) + F.col("blocked_weight").cast("double"))
    return d.select("cid", score.alias("score")).orderBy(F.desc("score"), "cid").limit(most)


def sketches(two: DataFrame, vertices: DataFrame, degrees: DataFrame, blocked: DataFrame, sel: DataFrame) -> DataFrame:
    """(a, b, witness, upper, credit, score) of compatible pairs (a, b) of outsiders.

    Each blocker is charged to the outsiders that it blocks, in whole parts: half to each if it blocks both.  What is left
    of an outsider's weight, if positive, adds to ``upper``, which no choice among the two can exceed; 0 certifies that
    none pays.  ``witness`` is the best of either and both, ``credit`` the weight of shared blockers; the score weighs these
    against the work, 1 + degree for every outsider and blocker.
    """
    two = stored(two.select("a", "b"), "sketches")
    d = pairs.deficits(vertices, blocked, sel).join(degrees, "cid").select("cid", "w", F.col("d").alias("d"), "degree")
    ends = two.select("a", "b", F.explode(F.array("a", "b")).alias("cid"))
    met = ends.join(blocked.select("cid", F.col("b").alias("x"), "bw"), "cid").join(degrees.select(F.col("cid").alias("x"), F.col("degree").alias("xd")), "x")
    # a blocker of both comes twice
    per = met.groupBy("a", "b", "x", "bw", "xd").agg(F.count(F.lit(1)).alias("h"), F.min("cid").alias("one"))
    half = F.expr("bw div h")
    on_a = (F.col("h") == 2) | (F.col("one") == F.col("a"))
    on_b = (F.col("h") == 2) | (F.col("one") == F.col("b"))
    cost = per.groupBy("a", "b").agg(
        F.sum(F.when(on_a, half).otherwise(0)).alias("ca"), F.sum(F.when(on_b, half).otherwise(0)).alias("cb"), F.sum(F.when(F.col("h") == 2, F.col("bw")).otherwise(0)).alias("credit"), F.sum(1 + F.col("xd")).alias("work")
    )
    of = lambda k: d.select(F.col("cid").alias(k), F.col("w").alias(f"w{k}"), F.col("d").alias(f"d{k}"), F.col("degree").alias(f"g{k}"))
    out = two.join(of("a"), "a").join(of("b"), "b").join(cost, ["a", "b"], "left").fillna(0, ["ca", "cb", "credit", "work"])
    rest = lambda k: F.greatest(F.lit(0), F.col(f"w{k}") - F.col(f"c{k}"))
    witness = F.greatest(F.lit(0), -F.col("da"), -F.col("db"), F.col("credit") - F.col("da") - F.col("db"))
    out = out.select("a", "b", witness.cast("long").alias("witness"), (rest("a") + rest("b")).cast("long").alias("upper"), F.col("credit").cast("long").alias("credit"), (2 + F.col("ga") + F.col("gb") + F.col("work")).cast("double").alias("work"))
    n = lambda c: F.col(c).cast("double")
    return out.withColumn("score", (2.0 * n("witness") + 0.05 * n("upper") + 0.01 * n("credit")) / F.sqrt("work")).drop("work")


def pair_bounds(vertices: DataFrame, edges: DataFrame, blocked: DataFrame, sel: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """One row (lower, upper, complete): the best pair's gain, or the two largest unselected weights as a bound.

    The pairs are only made if their number, known beforehand, is at most ``limit``; else lower is null.
    """
    estimate = pairs.pair_estimate(blocked).first()
    heavy = vertices.join(sel, "cid", "left_anti").orderBy(F.desc("w"), "cid").limit(2).agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("loose"))
    if estimate is not None and estimate["pairs"] > limit:
        return heavy.select(F.lit(None).cast("long").alias("lower"), F.col("loose").alias("upper"), F.lit(False).alias("complete")), False
    best = pairs.two_hop_pairs(vertices, edges, blocked, sel).agg(F.coalesce(F.max("gain"), F.lit(0)).cast("long").alias("lower"))
    return best.select("lower", F.col("lower").alias("upper"), F.lit(True).alias("complete")), True


def witness(singles: DataFrame, two: DataFrame) -> DataFrame:
    """The best change: largest gain, then fewer vertices, then smaller ids; singles (a, gain) and pairs (a, b, gain)."""
    rows = singles.select("a", F.lit(None).cast("long").alias("b"), "gain").unionByName(two.select("a", "b", "gain")).where("gain > 0")
    return rows.orderBy(F.desc("gain"), F.col("b").isNotNull(), "a", "b").limit(1)


def comparator(rows: DataFrame, keys: list[str], score: str, place: str, *kept: str) -> DataFrame:
    """The row of highest score of each group, the first declared on ties."""
    best = F.max_by(F.struct(place, score, *kept), F.struct(F.col(score), -F.col(place)))
    return rows.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")


def recorded(available: Column, valid: Column, *numbers: Column) -> Column:
    """Whether a label counts: available, valid, and every number there and finite."""
    ok = F.coalesce(available & valid, F.lit(False))
    for x in numbers:
        x = x.cast("double")
        ok = ok & F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    return ok


def clipped(gain: Column, least: float = 1e-10) -> Column:
    return F.when(gain > least, gain).otherwise(0.0)


def request_rows(scopes: DataFrame, returned: DataFrame, known: Column) -> DataFrame:
    """(action, q, recovery, signed, extra, consistent).

    Scopes hold (action, q, original, full): immediate gain, value before and value after; ``returned`` (action, w) the
    recovered vertices.  full - original must be q + w(T); extra is what that adds to the gain known before.
    """
    recovery = returned.groupBy("action").agg(F.sum("w").alias("recovery"))
    rows = scopes.join(recovery, "action", "left").withColumn("recovery", F.coalesce("recovery", F.lit(0)))
    signed = F.col("full") - F.col("original")
    return rows.select("action", "q", "recovery", signed.alias("signed"), F.greatest(F.lit(0), F.col("q") + F.col("recovery") - known).alias("extra"), (signed == F.col("q") + F.col("recovery")).alias("consistent"))


def execution_rows(labels: DataFrame) -> DataFrame:
    """Flags and targets of label rows (key, available, launched, returned, valid, elapsed, deadline, gain).

    A launched request is spent whether or not it returns; only a valid return with a finite gain counts, and only a timely
    one is accepted: a late one keeps its returned gain and is accepted as 0, a missing one has gain 0 and is not valid.  A
    return without a time is neither on time nor raw_valid.  A null flag is false; flags and status follow from one another.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    launched = flag("available") & flag("launched")
    returned = launched & recorded(flag("returned"), flag("valid"), F.col("gain"))
    timed = returned & recorded(F.lit(True), F.lit(True), F.col("elapsed"), F.col("deadline"))
    on_time = timed & F.coalesce(F.col("elapsed") < F.col("deadline"), F.lit(False))
    back = F.when(returned, F.greatest(F.col("gain"), F.lit(0.0))).otherwise(0.0)
    status = F.when(~flag("available"), "unavailable").when(~launched, "idle").when(~returned, "failed").when(~timed, "timestamp_failed").when(~on_time, "late").otherwise("accepted")
    return labels.select(
        "key", launched.alias("spent"), returned.alias("membership_valid"), timed.alias("raw_valid"), on_time.alias("on_time"), back.alias("returned_gain"), F.when(on_time, back).otherwise(0.0).alias("accepted_gain"), status.alias("status")
    )


def supervision(rows: DataFrame, domain: str, state: str, value: str, weight: str) -> DataFrame:
    """Per domain: labels, positive ones, ordered pairs of unequal value within a state, weighted opportunity.

    Unequal pairs are all pairs less those within each value, so none is made.
    """
    per_value = rows.where(F.col(value).isNotNull()).groupBy(domain, state, value).agg(F.count(F.lit(1)).alias("c"))
    per_state = per_value.groupBy(domain, state).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    ordered = per_state.groupBy(domain).agg(F.sum(F.col("n") * F.col("n") - F.col("same")).alias("unequal_pairs"), F.count_if(F.col("n") * F.col("n") > F.col("same")).alias("ranked_states"))
    out = rows.groupBy(domain).agg(
        F.count(F.lit(1)).alias("labels"), F.count(value).alias("usable"), F.count_if(F.col(value) > 0).alias("positive"), F.coalesce(F.sum(F.greatest(F.col(value), F.lit(0.0)) * F.col(weight)), F.lit(0.0)).alias("mass")
    )
    return out.join(ordered, domain, "left").withColumn("unequal_pairs", F.coalesce("unequal_pairs", F.lit(0))).withColumn("ranked_states", F.coalesce("ranked_states", F.lit(0)))


def pooled(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean and weighted mean per request; an empty one gives 0, never a division by 0."""
    total = F.coalesce(F.sum(value), F.lit(0.0)) / F.greatest(F.count(value), F.lit(1))
    heavy = F.coalesce(F.sum(F.col(value) * F.col(weight)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(weight), F.lit(0.0)), F.lit(1e-12))
    return rows.groupBy(*keys).agg(total.alias("mean"), heavy.alias("weighted"))


def checked_interval(lower: Column, upper: Column) -> tuple[Column, Column]:
    """(valid, upper repaired): 0 <= L <= U but for roundoff, which is closed by raising U to L."""
    room = 1e-8 + 1e-10 * F.greatest(F.lit(1.0), lower, upper)
    valid = (lower >= 0) & (lower <= upper + room)
    return valid, F.when(valid, F.greatest(lower, upper))


def units(rows: DataFrame, request: str, *content: str) -> DataFrame:
    """(request, unit): requests with the same content share the unit of the smallest of them."""
    key = F.sha2(F.to_json(F.struct(*content)), 256)
    keyed = rows.select(request, key.alias("key"))
    first = keyed.groupBy("key").agg(F.min(request).alias("unit"))
    return keyed.join(first, "key").select(request, "unit")


def scope_features(scope: DataFrame, edges: DataFrame) -> DataFrame:
    """Per action: size, sum, largest, mean and population deviation of weights, log edges, density, cross-owner edges, owners.

    ``edges`` may be (action, u, v) of conflicts inside the scopes alone.
    """
    at = [k for k in ("action", "u") if k in edges.columns]
    inside = scope.select("action", F.col("cid").alias("u"), F.col("owner").alias("ou")).join(edges.select(*at, "v"), at)
    inside = inside.join(scope.select("action", F.col("cid").alias("v"), F.col("owner").alias("ov")), ["action", "v"])
    links = inside.groupBy("action").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("ou") != F.col("ov")).alias("cross_edges"))
    w = F.col("w").cast("double")
    own = scope.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"), F.max("w").alias("largest"), F.avg(w).alias("mean"), F.stddev_pop(w).alias("deviation"), F.countDistinct("owner").alias("owners")
    )
    out = own.join(links, "action", "left").withColumn("edges", F.coalesce("edges", F.lit(0))).withColumn("cross_edges", F.coalesce("cross_edges", F.lit(0)))
    density = 2.0 * F.col("edges") / F.greatest(F.lit(1), F.col("n") * (F.col("n") - 1))
    return out.withColumn("log_edges", F.log1p(F.col("edges").cast("double"))).withColumn("density", density)


def surrogates(scope: DataFrame, gains: DataFrame) -> DataFrame:
    """(action, immediate, with_all): gain before recovery, and with every replacement at once, an upper bound."""
    every = scope.groupBy("action").agg(F.sum("w").alias("x"))
    return gains.join(every, "action", "left").select("action", F.col("gain").alias("immediate"), (F.col("gain") + F.coalesce("x", F.lit(0))).alias("with_all"))


def warm_updates(events: DataFrame) -> DataFrame:
    """Events (run, t, id, value, deadline) that replace the warm set: timely, and strictly better than all timely before."""
    timely = scans.running(events.where("t < deadline"), ["run"], ["t", "id"], "_best", F.col("value"))
    return timely.where("_best is null or value > _best").drop("_best")


def gated(events: DataFrame, warmup: int, stale: int, cooldown: int, share: float, cost: int) -> DataFrame:
    """(run, t, id) of the events at which the gate opens.

    Per run, times from its first event on, an event opens the gate after ``warmup``, at least ``stale`` since the last
    improvement (rows with ``better``) and ``cooldown`` since the last opening, while ``share`` of the time passed pays
    for another opening of ``cost``.  A run's events come in order and meet a state of four numbers; no run is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = object()
        first = improved = spent = 0
        opened: int | None = None
        for batch in batches:
            kept = []
            for i, (key, t, _, better) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if key != now:
                    now, first, improved, opened, spent = key, t, t, None, 0
                if better:
                    improved = t
                elif t - first >= warmup and t - improved >= stale and (opened is None or t - opened >= cooldown) and share * (t - first) - spent >= cost:
                    opened, spent = t, spent + cost
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64())).select(["run", "t", "id"])

    ordered = events.select("run", F.col("t").cast("long").alias("t"), F.col("id").cast("long").alias("id"), F.coalesce("better", F.lit(False)).alias("better")).where("t is not null")
    ordered = ordered.repartition("run").sortWithinPartitions("run", "t", "id")
    return ordered.mapInArrow(run, ordered.select("run", "t", "id").schema)


def sealed(blocks: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the blocks (key, expected, complete) whose summary is complete and whose count is the expected one."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    good = blocks.join(counts, key).where("complete and n = expected").select(key)
    return rows.join(good, key, "left_semi")


def mask_sha(members: DataFrame, keys: list[str], place: str, size: Column) -> DataFrame:
    """SHA-256 of the 0/1 bytes of each group's members over places 0..size - 1."""
    held = members.groupBy(*keys).agg(F.collect_set(place).alias("held"), F.max(size).cast("int").alias("n"))
    byte = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(F.array_contains("held", i.cast("long")), "01").otherwise("00"))
    return held.select(*keys, F.sha2(F.unhex(F.array_join(byte, "")), 256).alias("sha"))


def _little_endian(x: Column) -> Column:
    """Hex of a long's eight bytes, the lowest first."""
    return F.regexp_replace(F.lpad(F.hex(x), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1")


def _double_bits(x: pd.Series) -> pd.Series:
    """The 64 bits of doubles as whole numbers."""
    return pd.Series(np.ascontiguousarray(x.to_numpy(np.float64)).view(np.int64), index=x.index)


def content_sha(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """SHA-256 over the little-endian 64-bit values of each group, one column after another, rows in order.

    Fractional columns count as doubles, whole ones as longs.
    """
    bits = F.pandas_udf(_double_bits, "long")
    kinds = dict(rows.dtypes)
    coded = rows.withColumns({f"_{v}": bits(F.col(v).cast("double")) if kinds[v] in ("double", "float") or kinds[v].startswith("decimal") else F.col(v).cast("long") for v in values})
    kept = coded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[F.col(f"_{v}").alias(f"v_{v}") for v in values]))).alias("x"))
    parts = [F.array_join(F.transform(F.col(f"x.v_{v}"), _little_endian), "") for v in values]
    return kept.select(*keys, F.sha2(F.unhex(F.concat(*parts)), 256).alias("sha"))


#: Offset basis and prime, 2^40 + 435, of the 64-bit FNV-1a hash: fixed values.
FNV_BASIS, FNV_PRIME = 1469598103934665603, 1099511628211


def _times_prime(h: Column) -> Column:
    """h * FNV_PRIME modulo 2^64, in halves, for a product of longs must not overflow."""
    half = F.lit(0xFFFFFFFF)
    low = h.bitwiseAND(half)
    product = low * (FNV_PRIME - (1 << 40))
    high = F.shiftrightunsigned(h, 32) * (FNV_PRIME - (1 << 40)) + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
    return F.shiftleft(high, 32).bitwiseOR(product.bitwiseAND(half))


def signature(members: DataFrame, keys: list[str], place: str, size: Column) -> DataFrame:
    """FNV hash of the 0/1 mask of each group's members over places 0..size - 1, as a signed long, and their number."""
    held = members.groupBy(*keys).agg(F.collect_set(F.col(place).cast("long")).alias("held"), F.max(size).cast("int").alias("size"))
    mask = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.array_contains("held", i.cast("long")).cast("long"))
    return held.select(*keys, F.aggregate(mask, F.lit(FNV_BASIS).cast("long"), lambda h, bit: _times_prime(h.bitwiseXOR(bit))).alias("signature"), F.size("held").cast("long").alias("n"))


def evaluated(rows: DataFrame, state: str, regret: str, weight: str, pairs_right: str, pairs_all: str) -> DataFrame:
    """One row: weighted regret, and pair accuracy over the states where it is defined; null without weight or pairs."""
    defined = F.col(pairs_all) > 0
    return rows.agg(
        F.count(state).alias("states"), (F.sum(F.col(regret) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("regret"),
        F.avg(F.when(defined, F.col(pairs_right) / F.col(pairs_all))).alias("accuracy"), F.count_if(defined).alias("ranked_states"),
    )


def coalitions(rows: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """What sets of items gain in each group of items (i from 0, w, mask: the shared costs that it needs, as bits).

    The value of a set is its weight less one for each bit that any of its items needs; the empty set is worth 0.
    best_single and best_pair (of at most two) are known for every group, additive (the sum of what items gain alone)
    and additive_gain (what that choice really gains) too; sets are enumerated in groups of up to ``most`` items and give
    best_any and least_paying, the size of the smallest set that pays.  In larger groups best_any is null, and
    least_paying is known if it is 1 or 2; least_lower bounds it from below (null where nothing pays).
    """
    alone = F.col("w") - F.bit_count("mask")
    rows = stored(rows.select(*keys, "i", "w", "mask", alone.alias("alone")), "items")
    union = F.bit_or(F.when(F.col("alone") > 0, F.col("mask")))
    own = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.greatest(F.lit(0), F.max("alone")).cast("long").alias("best_single"), F.sum(F.greatest(F.lit(0), F.col("alone"))).cast("long").alias("additive"),
        F.greatest(F.lit(0), F.coalesce(F.sum(F.when(F.col("alone") > 0, F.col("w"))) - F.bit_count(union), F.lit(0))).cast("long").alias("additive_gain"),
    )
    # of items that need the same only the two heaviest can be in a best pair
    heavy = F.row_number().over(Window.partitionBy(*keys, "mask").orderBy(F.desc("w"), "i"))
    few = rows.withColumn("_n", heavy).where("_n <= 2")
    side = lambda k: few.select(*keys, *(F.col(c).alias(f"{k}{c}") for c in ("i", "w", "mask")))
    two = side("a").join(side("b"), keys).where("ai < bi").groupBy(*keys).agg(F.max(F.col("aw") + F.col("bw") - F.bit_count(F.col("amask").bitwiseOR(F.col("bmask")))).alias("two"))
    items = rows.join(own.where(F.col("items") <= most).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "w", "mask"))).alias("v"))
    # the sets of the first items, then each of them once more with the next item; nulls are passed over as by sums
    none = F.expr("array(struct(0 as size, cast(null as bigint) as w, cast(null as bigint) as mask))")
    both = lambda f, x, y: F.coalesce(f(x, y), x, y)
    plus, either = lambda x, y: x + y, lambda x, y: x.bitwiseOR(y)
    grow = lambda y, x: F.struct((y["size"] + 1).alias("size"), both(plus, y["w"], x["w"]).alias("w"), both(either, y["mask"], x["mask"]).alias("mask"))
    long = F.transform("v", lambda x: F.struct(x["w"].cast("long").alias("w"), x["mask"].cast("long").alias("mask")))
    sets = items.select(*keys, F.aggregate(long, none, lambda sets, x: F.concat(sets, F.transform(sets, lambda y: grow(y, x)))).alias("sets"))
    worth = F.transform("sets", lambda y: F.struct((y["w"] - F.bit_count(y["mask"])).alias("value"), y["size"].alias("size")))
    sets = sets.select(*keys, worth.alias("sets"))
    paying = F.filter("sets", lambda y: y["value"] > 0)
    every = sets.select(*keys, F.greatest(F.lit(0), F.array_max("sets.value")).cast("long").alias("best_any"), F.array_min(F.transform(paying, lambda y: y["size"])).alias("least"))
    out = own.join(two, keys, "left").join(every, keys, "left").withColumn("best_pair", F.greatest("best_single", F.coalesce("two", F.lit(0))).cast("long"))
    lower = F.when(F.col("best_single") > 0, 1).when(F.col("best_pair") > 0, 2)
    least = F.when(F.col("items") <= most, F.col("least")).otherwise(lower)
    bound = F.when(F.col("items") <= most, F.col("least")).otherwise(F.coalesce(lower, F.lit(3)))
    return out.select(*keys, "items", "best_single", "best_pair", "additive", "additive_gain", "best_any", least.cast("int").alias("least_paying"), bound.cast("int").alias("least_lower"))
