"""Pairs of changes that pay together."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import conflict, scans
from ..shared import stored


def blockers(vertices: DataFrame, adj: DataFrame, sel: DataFrame) -> DataFrame:
    """(cid, b, bw): unselected vertices and their selected neighbours."""
    outside = vertices.select("cid").join(sel, "cid", "left_anti")
    met = outside.join(adj.select(F.col("u").alias("cid"), F.col("v").alias("b")), "cid")
    return met.join(vertices.select(F.col("cid").alias("b"), F.col("w").alias("bw")).join(sel.withColumnRenamed("cid", "b"), "b", "left_semi"), "b").select("cid", "b", "bw")


def deficits(vertices: DataFrame, blocked: DataFrame, sel: DataFrame) -> DataFrame:
    """d = weight of blockers - own weight, of every unselected vertex."""
    cost = blocked.groupBy("cid").agg(F.sum("bw").alias("blocked_weight"))
    own = vertices.select("cid", "w", "owner").join(sel, "cid", "left_anti").join(cost, "cid", "left")
    return own.select("cid", "w", "owner", F.coalesce("blocked_weight", F.lit(0)).alias("blocked_weight"), (F.coalesce("blocked_weight", F.lit(0)) - F.col("w")).alias("d"))


def pair_estimate(blocked: DataFrame) -> DataFrame:
    """How many rows the two-hop join makes: sum of k (k - 1) / 2 over blockers; to be looked at before expanding."""
    k = blocked.groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    return k.agg(F.count(F.lit(1)).alias("blockers"), F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("pairs"), F.max("k").alias("largest"))


#: Outsiders of one blocker that a task meets with each other; longer lists are cut into blocks by rising deficit.
LIST = 1024
#: Pairs of lists that are made for each row of the lists, at most; beyond it the expansion is refused.
PAIRS_PER_ROW = 4096
#: Pairs that outsiders without a shared blocker are met in, at most.
APART = 1 << 22


class PairsRefused(ValueError):
    """The pairs that would have to be made are too many; ``rows`` tells how many."""

    def __init__(self, rows: int, limit: int):
        super().__init__(f"{rows} pairs of outsiders of a shared blocker, {limit} allowed")
        self.rows, self.limit = rows, limit


class Expansion:
    """The blockers' lists, ready to be met: what can be in a pair of gain above ``least``, and how many pairs that makes.

    A pair of outsiders a and c of one blocker gains at most w_c - d_a and at most w_a - d_c, for the blockers of one of
    them go in any case.  So an outsider whose deficit is not below the largest weight of its list (less ``least``) is
    dropped before pairs are made.  A list of more than ``size`` is cut into blocks by rising deficit; a pair of blocks
    is met only if by its smallest deficits and largest weights it can hold a pair, so that no key is met whole.
    """

    def __init__(self, vertices: DataFrame, blocked: DataFrame, sel: DataFrame, least: int = 0, size: int = LIST):
        d = deficits(vertices, blocked, sel).select("cid", "w", "d", "blocked_weight")
        rows = blocked.select("b", "cid", "bw").join(d, "cid")
        for _ in range(2):  # what is dropped may have held the largest weight
            rows = rows.join(rows.groupBy("b").agg(F.max("w").alias("_most")), "b").where(F.col("d") + least < F.col("_most")).drop("_most")
        number = rows.groupBy("b").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        rows = stored(rows.join(number, "b"), "lists")
        self.whole = rows.where(F.col("k") <= size)
        short = F.when(F.col("k") <= size, F.col("k") - 1).otherwise(0)
        known = rows.agg(F.count(F.lit(1)).alias("listed"), F.coalesce(F.sum(short), F.lit(0)).alias("twice"), F.count_if(F.col("k") > size).alias("long")).first()
        self.listed, self.rows, self.cut = known.listed, known.twice // 2, None
        if not known.long:
            return
        cut = scans.ranked(rows.where(F.col("k") > size), ["b"], ["d", "cid"], "_n")
        self.cut = stored(cut.withColumn("block", F.expr(f"(_n - 1) div {size}")).drop("_n"), "blocks")
        block = self.cut.groupBy("b", "block").agg(F.min("d").alias("d"), F.max("w").alias("w"), F.count(F.lit(1)).alias("n"))
        left, right = (block.select("b", *(F.col(c).alias(f"{side}{c}") for c in ("block", "d", "w", "n"))) for side in "xy")
        met = left.join(right, "b").where((F.col("xblock") <= F.col("yblock")) & (F.col("yw") - F.col("xd") > least) & (F.col("xw") - F.col("yd") > least))
        self.met = stored(met.select("b", "xblock", "yblock", F.when(F.col("xblock") == F.col("yblock"), F.expr("xn * (xn - 1) div 2")).otherwise(F.col("xn") * F.col("yn")).alias("pairs")), "met")
        self.rows += self.met.agg(F.sum("pairs")).first()[0] or 0

    def pairs(self) -> DataFrame:
        """(b, bw, a, c) and their weights (wa, wc), deficits (da, dc) and blocked weights (ba, bc), a < c."""
        side = lambda rows, k, *more: rows.select("b", *more, F.col("cid").alias(k), F.col("d").alias(f"d{k}"), F.col("w").alias(f"w{k}"), F.col("blocked_weight").alias(f"b{k}"))
        small = side(self.whole, "a", "bw").join(side(self.whole, "c"), "b").where("a < c")
        if self.cut is None:
            return small
        x = self.met.select("b", "xblock", "yblock").join(side(self.cut, "x", "bw", "block").withColumnRenamed("block", "xblock"), ["b", "xblock"])
        large = x.join(side(self.cut, "y", "block").withColumnRenamed("block", "yblock"), ["b", "yblock"]).where("xblock < yblock or x < y")
        first = F.col("x") < F.col("y")
        pick = lambda p, s: F.when(first, F.col(f"{p}x")).otherwise(F.col(f"{p}y")) if s else F.when(first, F.col(f"{p}y")).otherwise(F.col(f"{p}x"))
        large = large.select("b", "bw", *(pick(p, s).alias(f"{p}{k}") for s, k in ((True, "a"), (False, "c")) for p in ("", "d", "w", "b")))
        return small.select(large.columns).unionByName(large)


def two_hop_pairs(
    vertices: DataFrame, edges: DataFrame | None, blocked: DataFrame, sel: DataFrame, least: int = 0, limit: int | None = None, size: int = LIST, apart: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(a, b, gain > least): compatible unselected pairs that share a selected blocker and pay together.

    gain = shared blocker weight - d_a - d_b.  ``PairsRefused`` is raised before any pair is made if the lists hold more
    than ``limit`` pairs (by default ``PAIRS_PER_ROW`` for each of their rows).  ``apart`` keeps the compatible ones of pairs
    (a, c) where there is no table of edges.
    """
    lists = Expansion(vertices, blocked, sel, least, size)
    most = PAIRS_PER_ROW * max(lists.listed, LIST) if limit is None else limit
    if lists.rows > most:
        raise PairsRefused(lists.rows, most)
    # whatever they share, it is no more than what either has for blockers
    met = lists.pairs().where(F.least("ba", "bc") - (F.col("da") + F.col("dc")) > least)
    shared = met.groupBy("a", "c", "da", "dc").agg(F.sum("bw").alias("shared"))
    shared = shared.where(F.col("shared") - F.col("da") - F.col("dc") > least)
    free = shared.join(edges.select(F.col("u").alias("a"), F.col("v").alias("c")), ["a", "c"], "left_anti") if apart is None else apart(shared)
    return free.select("a", F.col("c").alias("b"), (F.col("shared") - F.col("da") - F.col("dc")).alias("gain")).where(F.col("gain") > least)


def known_gains(candidates: DataFrame, vertices: DataFrame, edges: DataFrame, blocked: DataFrame, sel: DataFrame) -> DataFrame:
    """(a, b, gain) of compatible candidate pairs (a, b), whatever they share."""
    d = deficits(vertices, blocked, sel).select("cid", "d")
    of = lambda k: d.select(F.col("cid").alias(k), F.col("d").alias(f"d{k}"))
    apart = candidates.select("a", "b").distinct().join(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
    common = apart.join(blocked.select(F.col("cid").alias("a"), F.col("b").alias("x"), "bw"), "a").join(blocked.select(F.col("cid").alias("b"), F.col("b").alias("x")), ["b", "x"])
    shared = common.groupBy("a", "b").agg(F.sum("bw").alias("shared"))
    out = apart.join(shared, ["a", "b"], "left").join(of("a"), "a").join(of("b"), "b")
    return out.select("a", "b", (F.coalesce("shared", F.lit(0)) - F.col("da") - F.col("db")).cast("long").alias("gain"))


def guarded_pairs(vertices: DataFrame, edges: DataFrame, blocked: DataFrame, sel: DataFrame, share: float = 1.0) -> DataFrame:
    """(b, k, pairs, lower, upper, complete) of every blocker: the best pair of its list, if it is small enough to be met.

    The limit is taken from the data: ``share`` times the mean number of pairs of a blocker.  A list within it is met and
    gives its best gain (0 if no pair pays), exact over all shared blockers; a larger one has no lower bound, and its two
    heaviest outsiders as an upper one.
    """
    k = blocked.groupBy("b").agg(F.count(F.lit(1)).alias("k")).withColumn("pairs", F.expr("k * (k - 1) div 2"))
    limit = k.agg(F.coalesce(F.avg("pairs"), F.lit(0.0)) * share).first()[0]
    k = stored(k.withColumn("complete", F.col("pairs") <= limit), "guard")
    rows = blocked.join(k.where("complete").select("b"), "b", "left_semi").select("b", "cid")
    met = stored(rows.withColumnRenamed("cid", "a").join(rows.select(F.col("b").alias("_b"), F.col("cid").alias("c")), F.col("b") == F.col("_b")).where("a < c").select(F.col("b").alias("blocker"), "a", F.col("c").alias("b")), "met")
    best = met.join(known_gains(met, vertices, edges, blocked, sel), ["a", "b"]).groupBy("blocker").agg(F.max("gain").alias("best"))
    weights = blocked.select("b", "cid").join(vertices.select("cid", "w"), "cid")
    # the largest and the second largest without ranking the list: partial aggregates keep two
    top = weights.groupBy("b").agg(F.max(F.struct("w", "cid")).alias("x"))
    rest = weights.join(top, "b").where("cid <> x.cid").groupBy("b").agg(F.max("w").alias("second"))
    loose = top.join(rest, "b", "left").select("b", (F.col("x.w") + F.coalesce("second", F.lit(0))).cast("long").alias("loose"))
    out = k.join(best.withColumnRenamed("blocker", "b"), "b", "left").join(loose, "b")
    lower = F.when(F.col("complete"), F.greatest(F.coalesce("best", F.lit(0)), F.lit(0))).cast("long")
    return out.select("b", "k", "pairs", lower.alias("lower"), F.coalesce(lower, F.col("loose")).alias("upper"), "complete")


def pairs_below_zero(d: DataFrame) -> int:
    """How many pairs of rows (cid, d) have d_a + d_c < 0, without making one.

    Each distinct deficit x asks how many rows lie strictly below -x; questions and counts are put in one order and summed
    along it.
    """
    n = d.groupBy(F.col("d").cast("long").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    line = n.select("d", F.lit(1).alias("kind"), "n", F.lit(0).cast("long").alias("asked")).unionByName(n.select((-F.col("d")).alias("d"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), F.col("n").alias("asked")))
    found = scans.running(line, [], ["d", "kind"], "below", F.col("n"), "sum")
    ordered = found.agg(F.sum(F.col("asked") * F.coalesce("below", F.lit(0)))).first()[0] or 0
    return (ordered - d.where("d < 0").count()) // 2


def best_apart(vertices: DataFrame, edges: DataFrame, blocked: DataFrame, sel: DataFrame, limit: int, start: int = 64) -> tuple[tuple[int, int, int] | None, int]:
    """((gain, a, b), bound): the best pair that shares no blocker, is compatible and pays, the lowest ids on ties.

    Such a pair gains -d_a - d_c.  The outsiders of smallest deficit are met with each other; a pair outside these gains no
    more than the smallest deficit and the next one allow, so if the best found gains more it is the best of all, and else
    four times as many are met.  ``bound`` is the gain if that is settled, or what is left possible when the pairs to be
    made would pass ``limit``.
    """
    d = stored(deficits(vertices, blocked, sel).select("cid", F.col("d").cast("long").alias("d")), "deficits")
    number = d.count()
    while True:
        taken = min(start, number)
        few = d.orderBy("d", "cid").limit(taken + 1).collect()  # at most the square root of what may be made
        head, after = few[:taken], few[taken:]
        if len(head) < 2 or head[0].d + head[1].d >= 0:
            return None, 0
        rows = d.sparkSession.createDataFrame([(r.cid, r.d) for r in head], "cid long, d long")
        met = rows.select(F.col("cid").alias("a"), F.col("d").alias("da")).join(rows.select(F.col("cid").alias("b"), F.col("d").alias("dc")), (F.col("a") < F.col("b")) & (F.col("da") + F.col("dc") < 0))
        met = met.join(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
        own = blocked.join(F.broadcast(rows.select("cid")), "cid", "left_semi")  # ``taken`` rows
        common = own.select(F.col("cid").alias("a"), F.col("b").alias("x")).join(own.select(F.col("cid").alias("b"), F.col("b").alias("x")), "x").where("a < b").select("a", "b").distinct()
        best = met.join(common, ["a", "b"], "left_anti").select((-F.col("da") - F.col("dc")).alias("gain"), "a", "b").orderBy(F.desc("gain"), "a", "b").first()
        left = max(0, -head[0].d - after[0].d) if after else 0
        if best is not None and best.gain > left:
            return (best.gain, best.a, best.b), best.gain
        if not after or (best is None and not left):
            return ((best.gain, best.a, best.b), best.gain) if best is not None else (None, 0)
        if taken * taken * 8 > limit:
            return ((best.gain, best.a, best.b) if best is not None else None), left
        start = taken * 4


def pair_audit(vertices: DataFrame, edges: DataFrame, blocked: DataFrame, sel: DataFrame, limit: int | None = None, size: int = LIST) -> DataFrame:
    """One row that audits every change by at most two outsiders of a selection.

    occurrences: pairs of the blockers' lists.  singles, shared_pairs, apart_pairs: how many single insertions, pairs with
    a shared blocker and pairs without one pay (counts are null where they are not known).  lower and (a, b): the best
    gain and its insertion, b null for a single, a single before a pair and lower ids first on ties.  If the lists hold
    more pairs than ``limit``, what the most promising outsiders of each blocker gain raises the bar that lists must
    pass; if they still do, complete is false, and upper is the loose bound, the two heaviest outsiders.
    """
    d = deficits(vertices, blocked, sel)
    ones = d.agg(F.count_if(F.col("d") < 0).alias("n"), F.min(F.struct(F.col("d").cast("long").alias("d"), "cid")).alias("x")).first()
    best: tuple[int, int, int | None] | None = (-ones.x.d, ones.x.cid, None) if ones.n else None
    occurrences = pair_estimate(blocked).first().pairs
    loose = vertices.join(sel, "cid", "left_anti").orderBy(F.desc("w"), "cid").limit(2).agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("w")).first().w
    most = PAIRS_PER_ROW * max(blocked.count(), LIST) if limit is None else limit
    apart, bound = best_apart(vertices, edges, blocked, sel, min(most, APART)) if ones.n else (None, 0)
    shared_count = apart_count = None
    complete = apart is None or apart[0] == bound

    def better(gain: int, a: int, b: int) -> None:
        nonlocal best
        if best is None or gain > best[0] or (gain == best[0] and best[2] is not None and (a, b) < (best[1], best[2])):
            best = (gain, a, b)

    if apart is not None:
        better(*apart)
    elif bound:
        complete = False
    try:
        found = stored(two_hop_pairs(vertices, edges, blocked, sel, 0, most, size), "pairs")
        shared_count = found.count()
        if shared_count:
            r = found.orderBy(F.desc("gain"), "a", "b").first()
            better(r.gain, r.a, r.b)
        of = lambda k: d.select(F.col("cid").alias(k), F.col("d").alias(f"d{k}"))
        clash = edges.select("u", "v").join(of("u"), "u").join(of("v"), "v").where("du + dv < 0").count()
        below = found.join(of("a"), "a").join(of("b"), "b").where("da + db < 0").count()
        apart_count = pairs_below_zero(d) - clash - below
    except PairsRefused:
        probes = d.select("cid", "d").join(blocked.select("cid", "b"), "cid").groupBy("b").agg(F.min_by(F.struct("cid"), F.struct("d", "cid")).alias("x"))
        near = blocked.select("b", "cid").join(probes, "b").where("cid <> x.cid").select(F.least("cid", "x.cid").alias("a"), F.greatest("cid", "x.cid").alias("b"))
        r = known_gains(near, vertices, edges, blocked, sel).where("gain > 0").orderBy(F.desc("gain"), "a", "b").first()
        if r is not None:
            better(r.gain, r.a, r.b)
        bar = best[0] if best is not None else 0
        try:  # pairs as good as the bar too, for the lowest ids
            r = two_hop_pairs(vertices, edges, blocked, sel, max(bar - 1, 0), most, size).orderBy(F.desc("gain"), "a", "b").first()
            if r is not None:
                better(r.gain, r.a, r.b)
        except PairsRefused:
            complete = False
    lower = best[0] if best is not None else 0
    row = (ones.n, occurrences, shared_count, apart_count, lower, best[1] if best else None, best[2] if best else None, lower if complete else max(loose, lower), complete)
    return vertices.sparkSession.createDataFrame([row], "singles long, occurrences long, shared_pairs long, apart_pairs long, lower long, a long, b long, upper long, complete boolean")


def compatible_pairs(candidates: DataFrame, edges: DataFrame | None, blocked: DataFrame, rule: dict[str, int] | None = None) -> DataFrame:
    """Non-adjacent pairs u < v of different owners within a scope (action), with the gain over the union of their blockers.

    With ``rule`` (the gap of each resource) in place of edges, candidates have their windows and are judged by these.
    """
    own = ("s", "e", *rule) if rule else ()
    side = lambda k: candidates.select("action", F.col("cid").alias(k), F.col("w").alias(f"w{k}"), F.col("owner").alias(f"o{k}"), *(F.col(c).alias(f"{k}_{c}") for c in own))
    met = side("u").join(side("v"), "action").where("u < v and ou <> ov")
    if rule:
        of = lambda k: lambda c: F.col(k if c == "cid" else f"{k}_{c}")
        met = met.where(conflict.clash_type(rule, of("u"), of("v")) == 0).select("action", "u", "v", "wu", "wv")
    else:
        met = met.join(edges.select("u", "v"), ["u", "v"], "left_anti")
    lost = met.select("action", "u", "v", F.explode(F.array("u", "v")).alias("cid")).join(blocked, "cid").select("action", "u", "v", "b", "bw").distinct()
    lost = lost.groupBy("action", "u", "v").agg(F.sum("bw").alias("lost"))
    out = met.join(lost, ["action", "u", "v"], "left")
    return out.select("action", "u", "v", (F.col("wu") + F.col("wv") - F.coalesce("lost", F.lit(0))).alias("gain"))


def compatible_windows(candidates: DataFrame, rule: dict[str, int]) -> DataFrame:
    """``compatible_pairs`` of candidates that come with their windows and ``blockers`` (b, bw); no made pair is shuffled."""
    cost = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda t, y: t + y["bw"])
    side = lambda k: candidates.select("action", F.col("cid").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in dict.fromkeys(("w", "owner", "s", "e", *rule))), cost("blockers").alias(f"{k}_cost"), F.col("blockers").alias(f"{k}_held"))
    of = lambda k: lambda c: F.col(k if c == "cid" else f"{k}_{c}")
    met = side("u").join(side("v"), "action").where("u < v and u_owner <> v_owner").where(conflict.clash_type(rule, of("u"), of("v")) == 0)
    common = cost(F.filter("v_held", lambda y: F.array_contains("u_held.b", y["b"])))
    return met.select("action", "u", "v", (F.col("u_w") + F.col("v_w") - F.col("u_cost") - F.col("v_cost") + common).alias("gain"))


def bundles_windows(blocked: DataFrame, fresh: DataFrame, vertices: DataFrame, rule: dict[str, int]) -> DataFrame:
    """``bundles`` by the windows: of one resource none starts before the latest end, and the gap, of those before it.  Ids must be distinct."""
    near = blocked.join(fresh, "cid", "left_semi").select("b", "cid")
    rows = near.join(vertices.select("cid", "s", "e", *rule), "cid").repartition("b")
    for r, gap in rule.items():
        before = Window.partitionBy("b", r).orderBy("s", "cid").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(f"_{r}", F.col(r).isNotNull() & F.coalesce(F.col("s") < F.max(F.col("e") + gap).over(before), F.lit(False)))
    clash = F.max(reduce(Column.__or__, [F.col(f"_{r}") for r in rule]))
    return rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), clash.alias("_clash")).where("n >= 2 and not _clash").select("b", "n")


def bundles(blocked: DataFrame, fresh: DataFrame, edges: DataFrame) -> DataFrame:
    """(b, n) of blockers with at least two fresh neighbours, all of them pairwise compatible."""
    near = blocked.join(fresh, "cid", "left_semi").select("b", "cid")
    many = near.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    near = near.join(many, "b", "left_semi")
    clash = near.withColumnRenamed("cid", "u").join(edges.select("u", "v"), "u").join(near.withColumnRenamed("cid", "v"), ["b", "v"], "left_semi")
    return many.join(clash.select("b").distinct(), "b", "left_anti")


def triangles(edges: DataFrame) -> DataFrame:
    """Number of triangles: wedges over each smallest vertex, closed by an edge."""
    e = edges.select("u", "v")
    wedge = e.join(e.withColumnRenamed("v", "x"), "u").where("v < x")
    closed = wedge.join(e.select(F.col("u").alias("v"), F.col("v").alias("x")), ["v", "x"], "left_semi")
    return closed.agg(F.count(F.lit(1)).alias("triangles"))


def similar_pairs(rows: DataFrame, group: str, key: str, size: str, size_tolerance: float, features: list[str], tolerance: float) -> DataFrame:
    """Pairs of a group with sizes within a share of the larger and every feature within a relative distance.

    Sizes and the first feature are met by logarithmic bands, each as wide as the tolerance allows: a row in its own cell meets the
    rows of that cell and of the four neighbouring ones that come after it, so a pair is made once, and only between near rows.
    """
    import math

    widest = 1 << 60

    def band(y: Column, width: float) -> Column:
        # a little wider than the tolerance, for rounding
        return F.floor(F.least(F.greatest(y / (width * 1.000001 + 1e-9), F.lit(-float(widest))), F.lit(float(widest)))).cast("long")

    def bands(x: Column) -> Column:
        # linear up to 1, logarithmic beyond, so that a relative distance above 1 and an absolute one below are steps of one line
        x = x.cast("double")
        far = F.signum(x) * (1.0 + F.log(F.greatest(F.abs(x), F.lit(1.0))))
        return band(F.when(F.abs(x) <= 1.0, x).otherwise(far), -math.log(1 - tolerance))

    by_size = band(F.log(F.greatest(F.col(size).cast("double"), F.lit(1e-9))), -math.log(1 - size_tolerance))
    by_feature = bands(F.col(features[0])) if features and 0 <= tolerance < 0.5 else F.lit(0).cast("long")
    cols = [key, size, *features]
    # the rest of the row ends up as it was
    side = lambda k: [F.col(c).alias(f"{k}_{c}_") for c in cols]
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    own = rows.select(group, *cols, by_size.alias("_x"), by_feature.alias("_y"))
    left = own.select(group, *side("p"), "_x", "_y", F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps))).alias("_step"))
    left = left.select(group, *(f"p_{c}_" for c in cols), (F.col("_x") + F.col("_step.x")).alias("_x"), (F.col("_y") + F.col("_step.y")).alias("_y"), ((F.col("_step.x") == 0) & (F.col("_step.y") == 0)).alias("_same"))
    met = left.join(own.select(group, *side("q"), "_x", "_y"), [group, "_x", "_y"]).where(~F.col("_same") & (F.col(f"p_{key}_") != F.col(f"q_{key}_")) | (F.col(f"p_{key}_") < F.col(f"q_{key}_")))
    first = F.col(f"p_{key}_") < F.col(f"q_{key}_")
    met = met.select(group, *(F.when(first, F.col(f"{x}_{c}_")).otherwise(F.col(f"{y}_{c}_")).alias(f"{k}_{c}_") for k, x, y in (("l", "p", "q"), ("r", "q", "p")) for c in cols))
    near = F.abs(F.col(f"l_{size}_") - F.col(f"r_{size}_")) <= size_tolerance * F.greatest(f"l_{size}_", f"r_{size}_")
    for f in features:
        a, b = F.col(f"l_{f}_").cast("double"), F.col(f"r_{f}_").cast("double")
        near = near & (F.abs(a - b) / F.greatest(F.lit(1.0), F.abs(a), F.abs(b)) <= tolerance)
    return met.where(near).select(group, F.col(f"l_{key}_").alias("a"), F.col(f"r_{key}_").alias("b"))
