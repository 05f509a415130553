"""Coordination cells: commitments crossed with extra releases, found by many bounded breadth-first searches at once.

A search steps from a selected vertex over an unselected one to selected ones.  All searches move one level a round in the
same joins; rows are keyed by (seed, target_c, tree), so a round costs the frontiers and what they touch, and no search is met
whole by one task.  Where the order is free it is that of md5("seed:cid"), so it does not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import dropped, stored

#: Numbers of commitments and of extra releases: fixed values.
COMMITS = (0, 2, 4, 8)
RELEASES = (0, 16, 64)

SEARCH = ["seed", "target_c"]


def shuffled(cid: str = "cid") -> Column:
    return F.md5(F.concat_ws(":", "seed", cid))


def commitments(vertices: DataFrame, adj: DataFrame, sel: DataFrame, seeds: Sequence[int], most: int = max(COMMITS), leading: int = 32, drawn: int = 32, inside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(seed, pos, cid): up to ``most`` unselected vertices without conflicts, from a pool that takes the ``leading`` largest
    immediate gains and then ``drawn`` others in the seed's order; each is taken if it fits those before it.  With ``inside``, which gives the arcs (seed, u, v) inside such pools, ``adj`` needs
    only have those to selected vertices."""
    w = vertices.select("cid", "w")
    lost = adj.join(sel.withColumnRenamed("cid", "v"), "v", "left_semi").join(w.withColumnRenamed("cid", "v"), "v").groupBy(F.col("u").alias("cid")).agg(F.sum("w").alias("lost"))
    free = w.join(sel, "cid", "left_anti").join(lost, "cid", "left").select("cid", (F.col("w") - F.coalesce("lost", F.lit(0))).alias("gain"))
    per_seed = F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))).alias("seed")
    top = stored(free.orderBy(F.desc("gain"), "cid").limit(leading), "leading")
    first = top.select("*", per_seed).withColumn("pos", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("gain"), "cid")))
    others = free.join(top.select("cid"), "cid", "left_anti").select("cid", per_seed)
    others = others.withColumn("pos", F.row_number().over(Window.partitionBy("seed").orderBy(shuffled(), "cid"))).where(F.col("pos") <= drawn)
    pool = stored(first.select("seed", "pos", "cid").union(others.select("seed", F.col("pos") + leading, "cid")), "pool")
    if inside is None:
        hits = pool.select("seed", F.col("cid").alias("u")).join(adj, "u").join(pool.select("seed", F.col("cid").alias("v")), ["seed", "v"])
    else:
        hits = inside(pool)
    hits = hits.groupBy("seed", F.col("u").alias("cid")).agg(F.collect_set("v").alias("hits"))
    none = F.array().cast("array<bigint>")
    listed = pool.join(hits, ["seed", "cid"], "left").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("pos", "cid", F.coalesce("hits", none).alias("hits")))).alias("pool"))
    taken = F.aggregate("pool", none, lambda kept, x: F.when((F.size(kept) >= most) | F.arrays_overlap(kept, x.hits), kept).otherwise(F.concat(kept, F.array(x.cid))))
    return listed.select("seed", F.posexplode(taken).alias("pos", "cid")).withColumn("pos", F.col("pos") + 1)


def searched(starts: DataFrame, steps: DataFrame, limit: int) -> DataFrame:
    """(seed, target_c, tree, cid, place, start): what each search's queue holds, by place, until ``limit`` vertices besides its
    starts flagged ``free`` = false are there or nothing is left to reach.

    starts(seed, target_c, tree, cid, place, free); steps(s, x): edges from selected to unselected vertices.  A vertex queues
    behind its first parent, and those of one parent in the seed's order.  Every round that goes on adds a vertex to a
    search, so there are at most ``limit`` of them.
    """
    keys = [*SEARCH, "tree"]
    seen = stored(starts.select(*keys, "cid", "place", "free", F.lit(0).alias("level")), "queue")
    level = 0
    while True:
        short = seen.groupBy(*keys).agg(F.count_if("free").alias("n")).where(F.col("n") < limit).select(*keys)
        front = seen.where(F.col("level") == level).join(short, keys, "left_semi")
        over = front.join(steps.withColumnRenamed("s", "cid"), "cid").groupBy(*keys, "x").agg(F.min("place").alias("parent"))
        near = over.join(steps, "x").groupBy(*keys, F.col("s").alias("cid")).agg(F.min("parent").alias("parent"))
        near = near.join(seen.select(*keys, "cid"), [*keys, "cid"], "left_anti")
        level += 1
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("parent", shuffled(), "cid"))
        near = near.withColumn("rank", rank).where(F.col("rank") <= limit)
        new = stored(near.select(*keys, "cid", (F.lit(level) * (1 << 32) + F.col("rank")).alias("place"), F.lit(True).alias("free"), F.lit(level).alias("level")), "level")
        if new.isEmpty():
            dropped(new)
            return seen
        old, seen = seen, stored(seen.union(new), "queue")
        dropped(old, new)


def extra_releases(mandatory: DataFrame, short: DataFrame, adj: DataFrame, sel: DataFrame, limit: int = max(RELEASES)) -> DataFrame:
    """(seed, target_c, cid, rank): the first ``limit`` selected vertices in each search's queue that are not mandatory.

    A queue begins with the mandatory ones by id; whenever it runs dry it goes on from the next selected vertex in the
    seed's order.  Such restarts are made at once, as trees of their own: as many as releases are missing will do, since each
    gives one at least or lies in the tree of an earlier one, which then gives more.
    """
    half = adj.join(sel.withColumnRenamed("cid", "v"), "v", "left_semi").join(sel.withColumnRenamed("cid", "u"), "u", "left_anti")
    steps = stored(half.select(F.col("v").alias("s"), F.col("u").alias("x")).distinct(), "steps")
    by_id = F.row_number().over(Window.partitionBy(*SEARCH).orderBy("cid")).cast("long")
    seen = searched(mandatory.select(*SEARCH, F.lit(0).alias("tree"), "cid", by_id.alias("place"), F.lit(False).alias("free")), steps, limit)
    found = seen.where("free").groupBy(*SEARCH).agg(F.count(F.lit(1)).alias("n"))
    need = short.select(*SEARCH).join(found, SEARCH, "left").select(*SEARCH, (limit - F.coalesce("n", F.lit(0))).alias("need")).where("need > 0")
    dry = need.groupBy("seed").agg(F.collect_list(F.struct("target_c", "need")).alias("dry"))
    anchors = sel.select("cid").join(F.broadcast(dry)).select("seed", "cid", F.inline("dry"))  # a row for each seed
    anchors = anchors.join(seen.select(*SEARCH, "cid"), [*SEARCH, "cid"], "left_anti")
    tree = F.row_number().over(Window.partitionBy(*SEARCH).orderBy(shuffled(), "cid"))
    anchors = anchors.withColumn("tree", tree).where(F.col("tree") <= limit).where("tree <= need")
    trees = searched(anchors.select(*SEARCH, "tree", "cid", F.lit(0).cast("long").alias("place"), F.lit(True).alias("free")), steps, limit)
    every = seen.where("free").select(*SEARCH, "cid", "tree", "place").union(trees.select(*SEARCH, "cid", "tree", "place"))
    once = every.groupBy(*SEARCH, "cid").agg(F.min(F.struct("tree", "place")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(*SEARCH).orderBy("at"))
    return once.withColumn("rank", rank).where(F.col("rank") <= limit).select(*SEARCH, "cid", "rank")


def coordination_cells(vertices: DataFrame, adj: DataFrame, sel: DataFrame, seeds: Sequence[int], inside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The eleven cells of every seed: commitments 0, 2, 4, 8 by extra releases 0, 16, 64, without 0 by 0.

    A cell's inserts are the first commitments, its mandatory vertices their selected neighbours, its releases the first extra
    ones.  Status: insufficient_compatible_commitments, no_incumbent_releases_available, single_partition_only (one owner
    in all; a null owner counts as none), actual_action_alias (same inserts and releases as the prepared cell
    ``alias_cell``), else prepared.  Without vertices every cell lacks commitments or releases.
    """
    spark = vertices.sparkSession
    grid = [(c, e) for c in COMMITS for e in RELEASES if c or e]
    cells = spark.createDataFrame([(s, i, c, e) for s in seeds for i, (c, e) in enumerate(grid)], "seed long, cell int, target_c int, target_e int")
    chosen = stored(commitments(vertices, adj, sel, seeds, inside=inside), "chosen")
    have = chosen.groupBy("seed").agg(F.count(F.lit(1)).alias("have"))
    open_ = cells.select(*SEARCH).distinct().join(have, "seed", "left").where(F.coalesce("have", F.lit(0)) >= F.col("target_c")).select(*SEARCH)
    inserts = open_.join(chosen, "seed").where("pos <= target_c").select(*SEARCH, "cid")
    near = inserts.withColumnRenamed("cid", "u").join(adj, "u").select(*SEARCH, F.col("v").alias("cid")).distinct()
    mandatory = stored(near.join(sel, "cid", "left_semi").select(*SEARCH, "cid"), "mandatory")
    extra = extra_releases(mandatory, open_, adj, sel)
    kinds = [(inserts.withColumn("rank", F.lit(0)), "c"), (mandatory.withColumn("rank", F.lit(0)), "m"), (extra, "e")]
    parts = [df.select(*SEARCH, "cid", "rank", F.lit(kind).alias("kind")) for df, kind in kinds]
    members = parts[0].union(parts[1]).union(parts[2]).join(vertices.select("cid", "owner"), "cid")
    members = members.withColumn("target_e", F.explode(F.array(*map(F.lit, RELEASES)))).where("rank <= target_e")
    ids = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("cid")))), ",")
    size = lambda kind: F.count_if(F.col("kind") == kind)
    held = members.groupBy(*SEARCH, "target_e").agg(
        ids("c").alias("inserts"), ids("e").alias("releases"), size("c").alias("commits"), size("e").alias("extra"), size("m").alias("mandatory"), (F.min("owner") < F.max("owner")).alias("mixed")
    )
    rows = cells.join(open_.withColumn("open", F.lit(True)), SEARCH, "left").join(held, [*SEARCH, "target_e"], "left")
    empty = F.coalesce(F.col("commits") + F.col("extra"), F.lit(0)) == 0
    fails = F.when(F.col("open").isNull(), "insufficient_compatible_commitments").when(empty, "no_incumbent_releases_available").when(~F.coalesce("mixed", F.lit(False)), "single_partition_only")
    rows = rows.withColumn("fails", fails)
    same = Window.partitionBy("seed", F.col("fails").isNull(), "inserts", "releases")
    first = F.min(F.when(F.col("fails").isNull(), F.col("cell"))).over(same)
    rows = rows.withColumn("alias_cell", F.when(F.col("fails").isNull() & (first < F.col("cell")), first))
    status = F.coalesce("fails", F.when(F.col("alias_cell").isNotNull(), "actual_action_alias").otherwise("prepared"))
    ok = F.col("fails").isNull()
    kept = [F.when(ok, F.col(k)).alias(k) for k in ("commits", "extra", "mandatory", "inserts", "releases")]
    return rows.select("seed", "cell", *SEARCH[1:], "target_e", status.alias("status"), "alias_cell", *kept)
