"""Random graphs and schedules, drawn by hash so that any partitioning draws the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflict, greedy


def uniform(seed: int, *key: Column) -> Column:
    """In [0, 1), the same for the same seed and key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / float(1 << 53)


def normal(seed: int, *key: Column) -> Column:
    near_one = 1.0 - uniform(seed, F.lit("r"), *key)
    return F.sqrt(-2.0 * F.log(near_one)) * F.cos(2.0 * 3.141592653589793 * uniform(seed, F.lit("a"), *key))


def random_places(spark: SparkSession, total: int, chance: float, seed: int, at_once: int = 1 << 16) -> DataFrame:
    """(place): each of 0..total - 1 with the same chance, independently.

    Gaps between those that are drawn are geometric; so the work grows with what is drawn.  The line is cut into pieces of
    about ``at_once`` places drawn, each with a generator of its own, whatever task draws it.
    """
    if not chance or total <= 0:
        return spark.createDataFrame([], "place long")
    span = max(1, int(at_once / chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                rnd, lo, hi = np.random.default_rng([seed, piece]), piece * span, min(total, (piece + 1) * span)
                at = lo - 1
                while True:
                    place = at + np.cumsum(rnd.geometric(chance, at_once))
                    at, place = int(place[-1]), place[place < hi]
                    yield pa.RecordBatch.from_arrays([pa.array(place)], names=["place"])
                    if at >= hi - 1:
                        break

    pieces = -(-total // span)
    return spark.range(0, pieces, 1, min(pieces, 4096)).mapInArrow(run, "place long")


def pair_at(place: str) -> list[Column]:
    """u and v, u < v, of a place in the line (0, 1), (0, 2), (1, 2), (0, 3) and so on."""
    at = F.col(place)
    root = F.floor((1 + F.sqrt(1 + 8 * at.cast("double"))) / 2).cast("long")
    under = lambda x: F.shiftright(x * (x - 1), 1)
    v = root - (under(root) > at).cast("long")  # the root may be rounded either way
    v = v + (under(v + 1) <= at).cast("long")
    return [(at - under(v)).alias("u"), v.alias("v")]


def random_pairs(spark: SparkSession, n: int, chance: float, seed: int, at_once: int = 1 << 16) -> DataFrame:
    """(u, v), u < v: every pair of 0..n - 1 with the same chance, independently; a sparse graph costs its edges."""
    return random_places(spark, n * (n - 1) // 2, chance, seed, at_once).select(*pair_at("place"))


def block_graph(spark: SparkSession, seed: int, coupling: float = 0.5, compatibility: float = 0.5, n: int = 96, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of bundles of three vertices among k agents.

    The first of each bundle is adjacent to the other two.  Any pair may be adjacent besides: of one agent with probability
    0.065, of two with 0.015 + 0.105 * coupling; an edge between two vertices that lead no bundle stays with probability
    1 - compatibility.  Weights are uniform in [3, 20).  Pairs are drawn with the larger of the two probabilities, then
    thinned, so the work grows with the edges.
    """
    if not (0 <= coupling <= 1 and 0 <= compatibility <= 1) or n < 3 or not 2 <= k <= n:
        raise ValueError("coupling and compatibility lie in [0, 1], and 2 <= k <= n, 3 <= n")
    ids = spark.range(n)
    vertices = ids.select(F.col("id").alias("cid"), (3 + 17 * uniform(seed, F.lit("w"), F.col("id"))).alias("w"), (F.col("id") % k).alias("owner"))
    most = max(0.065, 0.015 + 0.105 * coupling)
    drawn = random_pairs(spark, n, most, seed)
    chance = F.when(F.col("u") % k == F.col("v") % k, 0.065).otherwise(0.015 + 0.105 * coupling)
    spared = (F.col("u") % 3 != 0) & (F.col("v") % 3 != 0) & (uniform(seed, F.lit("c"), F.col("u"), F.col("v")) < compatibility)
    drawn = drawn.where((uniform(seed, F.lit("e"), F.col("u"), F.col("v")) * most < chance) & ~spared)
    bundles = ids.where(F.col("id") % 3 == 0).select(F.col("id").alias("u"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("v")).where(F.col("v") < n)
    edges = drawn.unionByName(bundles).distinct()
    return vertices, edges


def initial_schedule(vertices: DataFrame, edges: DataFrame, seed: int = 0, perturbation: float = 0.45, anchors: Column | None = None) -> DataFrame:
    """A feasible selection by greedy order of weight / sqrt(1 + degree), each times a lognormal factor.

    Vertices where ``anchors`` holds come before all others of ordinary weight (a bonus of 1000).
    """
    if perturbation < 0:
        raise ValueError("perturbation must not be negative")
    bonus = F.lit(0.0) if anchors is None else F.when(anchors, 1000.0).otherwise(0.0)
    rows = vertices.join(conflict.degrees(vertices, edges), "cid")
    priority = F.col("w") / F.sqrt(1.0 + F.col("degree")) * F.exp(perturbation * normal(seed, F.col("cid"))) + bonus
    return greedy.greedy(rows, edges, -priority)


TOPOLOGIES = ("erdos", "cliques", "bipartite", "components")


def menu_graph(
    spark: SparkSession, seed: int, replacements: int = 32, menus: int = 12, density: float = 0.15, coupling: float = 0.04, topology: str = "erdos"
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, selection, actions) of menus: an anchor that is selected, an insert, and alternatives.

    A menu's anchor conflicts with all else in it.  Its alternatives conflict as the topology says, with a density of the
    menu's own (``density`` times 0.5 to 1.5, in [0.01, 0.9]): any pair; blocks of five, and any pair at a tenth; odd with even
    places at twice; or blocks of eight at thrice.  Alternatives of two menus and two owners conflict with chance
    ``coupling``.  Actions are every insert alone, under its own id, and as many pairs of inserts of two owners as there are
    menus (all, if fewer), at random, under negative ids.  Edges and pairs are drawn on a line, so work grows with them.
    """
    if topology not in TOPOLOGIES or replacements < 0 or menus < 1 or not 0 <= coupling <= 1 or density < 0:
        raise ValueError(f"topology is one of {TOPOLOGIES}, and 0 <= coupling <= 1, density >= 0, replacements >= 0, menus >= 1")
    width, owners = replacements + 2, max(4, menus // 2)
    ids = spark.range(width * menus).select(F.col("id").alias("cid"), F.expr(f"id div {width}").alias("menu"), (F.col("id") % width).alias("role"))
    span = lambda lo, hi: lo + (hi - lo) * uniform(seed, F.lit("w"), F.col("cid"))
    leads = F.col("role") < 2
    vertices = ids.select(
        "cid", F.when(F.col("role") == 0, span(20, 35)).when(F.col("role") == 1, span(15, 30)).otherwise(span(2, 16)).alias("w"), F.when(leads, F.col("menu") % owners).otherwise(F.col("cid") % owners).alias("owner"), "menu", "role"
    )
    own = ids.where("role > 0").select((F.col("menu") * width).alias("u"), F.col("cid").alias("v"))

    times, apart, block = {"erdos": (1, None, 0), "cliques": (0.1, None, 5), "bipartite": (2, 2, 0), "components": (3, None, 8)}[topology]
    density_of = lambda menu: F.greatest(F.lit(0.01), F.least(F.lit(0.9), density * (0.5 + uniform(seed, F.lit("d"), menu))))
    chance = F.least(F.lit(1.0), times * density_of(F.col("menu")))
    most = min(1.0, times * max(0.01, min(0.9, 1.5 * density)))
    keep = uniform(seed, F.lit("k"), F.col("menu"), F.col("u"), F.col("v")) * most < chance
    line = replacements * (replacements - 1) // 2
    local = []
    if block:
        last = F.least(F.lit(replacements), F.expr(f"((role - 2) div {block} + 1) * {block}")) - 1
        blocks = ids.where("role > 1").withColumn("u", F.col("role") - 2).withColumn("last", last).where("u < last").select("menu", "u", F.explode(F.sequence(F.col("u") + 1, "last")).alias("v"))
        local.append(blocks if topology == "cliques" else blocks.where(uniform(seed, F.lit("b"), F.col("menu"), F.col("u"), F.col("v")) < chance))
    if topology != "components" and line:
        drawn = random_places(spark, line * menus, most, seed + 1).select(F.expr(f"place div {line}").alias("menu"), (F.col("place") % line).alias("place")).select("menu", *pair_at("place")).where(keep)
        local.append(drawn.where(F.col("u") % apart != F.col("v") % apart) if apart else drawn)
    at = lambda c: (F.col("menu") * width + 2 + F.col(c)).alias(c)
    edges = own
    for part in local:
        edges = edges.union(part.select(at("u"), at("v")))
    outer = random_pairs(spark, replacements * menus, coupling, seed + 2).withColumns({c: F.expr(f"({c} div {max(1, replacements)}) * {width} + 2 + {c} % {max(1, replacements)}") for c in "uv"})
    other = F.expr(f"u div {width} <> v div {width} and u % {owners} <> v % {owners}")
    edges = edges.union(outer.where(other)).distinct()

    total, share = menus * (menus - 1) // 2, min(1.0, 8 / menus)
    while True:
        pairs = random_pairs(spark, menus, share, seed + 3).where(F.col("u") % owners != F.col("v") % owners)
        if share >= 1 or not total or pairs.limit(menus).count() == menus:
            break
        share = min(1.0, share * 4)
    pairs = pairs.orderBy(uniform(seed, F.lit("p"), F.col("u"), F.col("v")), "u", "v").limit(menus).select((F.col("u") * width + 1).alias("a"), (F.col("v") * width + 1).alias("b"))
    two = pairs.select((-(F.expr("b * (b - 1) div 2") + F.col("a") + 1)).alias("action"), F.explode(F.array("a", "b")).alias("cid"))
    actions = ids.where("role = 1").select(F.col("cid").alias("action"), "cid").union(two)
    return vertices, edges, ids.where("role = 0").select("cid"), actions


def window_graph(
    spark: SparkSession, seed: int, satellites: int = 8, grounds: int = 4, passes: int = 48, alternatives: int = 6, horizon: float = 7200.0, satellite_setup: float = 30.0, ground_setup: float = 15.0
) -> tuple[DataFrame, DataFrame]:
    """(contacts, edges) of transmissions inside visibility windows of a satellite over a ground station; times in microseconds.

    A pass is a window of 360 to 900 seconds; its first transmission takes 0.6 to 0.85 of it, the others 30 to 180 seconds (at
    most 0.3 of it).  Weight is length times a priority of 1, 1.5 or 2 (at 0.6, 0.3, 0.1).  Two transmissions that share a
    satellite or a ground station conflict unless one ends, setup time included, before the other starts.
    """
    if min(satellites, grounds, alternatives) < 1 or passes < 0 or horizon < 0:
        raise ValueError("there is at least one satellite, ground station and alternative")
    drawn = lambda name, *key: uniform(seed, F.lit(name), *(F.col(k) for k in key))
    micros = lambda x: F.round(x * 1_000_000).cast("long")
    rows = spark.range(passes * alternatives).select(F.col("id").alias("cid"), F.expr(f"id div {alternatives}").alias("pass"), (F.col("id") % alternatives).alias("place"))
    rows = rows.withColumn("_long", 360 + 540 * drawn("long", "pass")).withColumn("_from", F.greatest(F.lit(1.0), horizon - F.col("_long")) * drawn("from", "pass"))
    short = 30 + (F.least(F.lit(180.0), 0.3 * F.col("_long")) - 30) * drawn("len", "cid")
    rows = rows.withColumn("_len", F.when(F.col("place") == 0, F.col("_long") * (0.6 + 0.25 * drawn("len", "cid"))).otherwise(short))
    rows = rows.withColumn("s", micros(F.col("_from") + (F.col("_long") - F.col("_len")) * drawn("at", "cid"))).withColumn("e", F.col("s") + micros(F.col("_len")))
    luck = drawn("priority", "cid")
    rows = rows.withColumn("priority", F.when(luck < 0.6, 1.0).when(luck < 0.9, 1.5).otherwise(2.0))
    contacts = rows.select(
        "cid", (F.col("pass") % satellites).alias("owner"), F.floor(grounds * drawn("ground", "pass")).cast("long").alias("ground"), "s", "e", F.round((F.col("e") - F.col("s")) * F.col("priority")).cast("long").alias("w"),
        "pass", micros(F.col("_from")).alias("visible_from"), micros(F.col("_from") + F.col("_long")).alias("visible_to"),
    )
    setups = {"owner": int(satellite_setup * 1_000_000), "ground": int(ground_setup * 1_000_000)}
    return contacts, conflict.setup_conflicts(contacts, setups)
