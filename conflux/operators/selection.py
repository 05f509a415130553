"""Selections (independent sets) and the scopes around changes to them.

Tables: vertices(cid, w, owner, ...), adj(u, v) with both directions, sel(cid), actions(action, cid) with the inserts of
each action, releases(action, cid) for declared extra releases.  Scopes are kept as long tables keyed by action; the
base (sel - displaced) + inserts of an action is never spelled out, so nothing grows with actions * selection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from . import conflict


def local_best(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that come before all their neighbours in (-w, cid): an independent set, the first greedy round."""
    w = vertices.select("cid", "w")
    ends = edges.select("u", "v").join(w.select(F.col("cid").alias("u"), F.col("w").alias("wu")), "u").join(w.select(F.col("cid").alias("v"), F.col("w").alias("wv")), "v")
    beaten = ends.select(F.when((F.col("wu") > F.col("wv")) | ((F.col("wu") == F.col("wv")) & (F.col("u") < F.col("v"))), F.col("v")).otherwise(F.col("u")).alias("cid"))
    return vertices.select("cid").join(beaten.distinct(), "cid", "left_anti")


def local_best_windows(vertices: DataFrame, rule: dict[str, int], key: tuple[str, ...] = ()) -> DataFrame:
    """``local_best``, by columns ``key`` before (-w, cid), over the conflicts of ``rule`` (the gap of each resource), of windows that do not end before they start.

    Windows of one resource that start within one gap conflict, so of each such stretch only the best is left to be met
    with the others.
    """
    order = lambda side, cid: F.struct(*(F.col(f"{side}{c}") for c in key), (-F.col(f"{side}w")).alias("nw"), F.col(cid).alias("cid"))
    left = vertices
    for r, gap in rule.items():
        if gap <= 0:
            continue
        stretch = F.col("s") - F.pmod(F.col("s"), F.lit(gap))
        first = vertices.where(F.col(r).isNotNull()).groupBy(F.col(r).alias("_r"), stretch.alias("_k")).agg(F.min(order("", "cid"))["cid"].alias("_cid"))
        left = left.join(first, (F.col(r) == F.col("_r")) & (stretch == F.col("_k")), "left").where(F.col("_cid").isNull() | (F.col("_cid") == F.col("cid"))).drop("_r", "_k", "_cid")
    left = stored(left, "leading")
    beaten = []
    for rows, later, mine, other in ((left, vertices, "i", "j"), (vertices, left, "j", "i")):
        met = conflict.conflict_pairs(rows, rule, (*key, "w"), later)
        worse = [F.col(other) < F.col(mine)]
        for c, up in (("w", False), *((c, True) for c in reversed(key))):
            x, y = F.col(f"{other}_{c}"), F.col(f"{mine}_{c}")
            worse.append(((x < y) if up else (x > y)) | ((x == y) & worse[-1]))
        beaten.append(met.where(worse[-1]).select(F.col(mine).alias("cid")))
    return left.select("cid").join(beaten[0].union(beaten[1]).distinct(), "cid", "left_anti")


def near_selected(vertices: DataFrame, rule: dict[str, int], sel: DataFrame) -> DataFrame:
    """(u, v): arcs from every vertex to its selected neighbours; the other conflicts are not made."""
    chosen = stored(vertices.join(sel, "cid", "left_semi"), "chosen")
    before = conflict.conflict_pairs(chosen, rule, later=vertices).select(F.col("j").alias("u"), F.col("i").alias("v"))
    after = conflict.conflict_pairs(vertices, rule, later=chosen).select(F.col("i").alias("u"), F.col("j").alias("v"))
    return before.union(after)


def eligible_windows(actions: DataFrame, gone: DataFrame, blocked: DataFrame, vertices: DataFrame, rule: dict[str, int], own: bool = False, costs: bool = False) -> DataFrame:
    """``eligible`` (with ``own`` the vertices' columns too, with ``costs`` also their blockers, as ``blockers``: b, bw), for an independent selection and what its actions displace, judged by the windows themselves.

    A vertex of the sphere is eligible if the action displaces all its blockers (``blocked``: cid, b) and no insert conflicts with it; a
    displaced vertex conflicts with an insert.  So each vertex waits at its smallest blocker and is met there once by every
    action that displaces it; spheres and the conflicts around them are not made.
    """
    window = F.struct(*dict.fromkeys(("cid", "w", "owner", "s", "e", *rule)))
    inserts = actions.join(vertices, "cid").groupBy("action").agg(F.collect_list(window).alias("ins"))
    acting = gone.groupBy("action").agg(F.collect_list("cid").alias("gone")).join(inserts, "action").select("action", "ins", "gone", F.explode("gone").alias("b"))
    held = [F.collect_list(F.struct("b", "bw")).alias("blockers")] if costs else []
    waiting = blocked.groupBy("cid").agg(F.collect_list("b").alias("held"), F.min("b").alias("b"), *held).join(vertices.select(F.col("cid"), window.alias("x")), "cid")
    met = acting.join(waiting, "b").where(F.size(F.array_except("held", "gone")) == 0)
    side = lambda c: lambda k: c[k]
    clash = F.exists("ins", lambda i: (i["cid"] == F.col("x.cid")) | (conflict.clash_type(rule, side(i), side(F.col("x"))) > 0))
    return met.where(~clash).select("action", "x.*" if own or costs else "x.cid", *(["blockers"] if costs else []))


def violations(edges: DataFrame, sel: DataFrame) -> DataFrame:
    """Edges with both ends selected; empty for a feasible selection."""
    return edges.join(sel.select(F.col("cid").alias("u")), "u", "left_semi").join(sel.select(F.col("cid").alias("v")), "v", "left_semi")


def displaced(actions: DataFrame, adj: DataFrame, sel: DataFrame) -> DataFrame:
    """(action, cid) of the selected neighbours of each action's inserts, once each."""
    near = actions.select("action", F.col("cid").alias("u")).join(adj, "u").select("action", F.col("v").alias("cid"))
    return near.join(sel, "cid", "left_semi").select("action", "cid").distinct()


def released(gone: DataFrame, releases: DataFrame) -> DataFrame:
    return gone.select("action", "cid").union(releases.select("action", "cid")).distinct()


def sphere(gone: DataFrame, adj: DataFrame) -> DataFrame:
    """(action, cid) of displaced vertices and their neighbours."""
    near = gone.select("action", F.col("cid").alias("u")).join(adj, "u").select("action", F.col("v").alias("cid"))
    return gone.select("action", "cid").union(near).distinct()


def sphere_windows(gone: DataFrame, blocked: DataFrame) -> DataFrame:
    """``sphere`` of what actions displace from an independent selection, by ``blocked`` (cid, b), each vertex once and not shuffled.

    A vertex next to several displaced ones is listed at the smallest of them.
    """
    acting = gone.groupBy("action").agg(F.collect_list("cid").alias("gone")).select("action", "gone", F.explode("gone").alias("b"))
    held = blocked.groupBy("cid").agg(F.collect_list("b").alias("held")).select("cid", "held", F.explode("held").alias("b"))
    met = acting.join(held, "b").where(F.array_min(F.array_intersect("gone", "held")) == F.col("b"))
    return gone.select("action", "cid").union(met.select("action", "cid"))


def eligible(actions: DataFrame, gone: DataFrame, adj: DataFrame, sel: DataFrame) -> DataFrame:
    """Vertices of the sphere outside the base and without a neighbour in it."""
    around = sphere(gone, adj)
    kept = around.join(sel, "cid", "left_semi").join(gone, ["action", "cid"], "left_anti")
    free = around.join(kept, ["action", "cid"], "left_anti").join(actions, ["action", "cid"], "left_anti")
    touching = free.join(adj.withColumnRenamed("u", "cid"), "cid").select("action", "cid", F.col("v").alias("x"))
    by_kept = touching.join(sel.withColumnRenamed("cid", "x"), "x", "left_semi").join(gone.withColumnRenamed("cid", "x"), ["action", "x"], "left_anti")
    by_insert = touching.join(actions.withColumnRenamed("cid", "x"), ["action", "x"], "left_semi")
    blocked = by_kept.select("action", "cid").union(by_insert.select("action", "cid")).distinct()
    return free.join(blocked, ["action", "cid"], "left_anti").select("action", "cid")


def pool(found: DataFrame, vertices: DataFrame, cap: int = 256, more: tuple[str, ...] = ()) -> DataFrame:
    """The first ``cap`` of each action's candidates by (-w, cid), with their positions and what else is named in ``more``."""
    order = Window.partitionBy("action").orderBy(F.desc("w"), "cid")
    found = found if "w" in found.columns else found.join(vertices.select("cid", "w"), "cid")
    ranked = found.withColumn("pos", F.row_number().over(order))
    return ranked.where(F.col("pos") <= cap).select("action", "pos", "cid", "w", *more)


def immediate_gain(actions: DataFrame, gone: DataFrame, vertices: DataFrame) -> DataFrame:
    """Weight of the inserts minus weight of the displaced, per action."""
    w = vertices.select("cid", "w")
    plus = actions.select("action", "cid").distinct().join(w, "cid").select("action", F.col("w").alias("x"))
    minus = gone.join(w, "cid").select("action", (-F.col("w")).alias("x"))
    return plus.union(minus).groupBy("action").agg(F.sum("x").alias("gain"))


def valid_actions(actions: DataFrame, vertices: DataFrame, adj: DataFrame, sel: DataFrame) -> DataFrame:
    """(action, valid): one or two unselected, known, mutually compatible inserts, of two owners if a pair."""
    known = actions.join(vertices.select("cid", "owner"), "cid", "left").join(sel.withColumn("chosen", F.lit(1)), "cid", "left")
    own = known.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cid").alias("d"), F.count("owner").alias("known"), F.countDistinct("owner").alias("owners"), F.count("chosen").alias("chosen")
    )
    pair = actions.select("action", F.col("cid").alias("u")).join(adj, "u").join(actions.withColumnRenamed("cid", "v"), ["action", "v"], "left_semi").select("action").distinct()
    out = own.join(pair.withColumn("clash", F.lit(1)), "action", "left")
    ok = F.col("n").between(1, 2) & (F.col("d") == F.col("n")) & (F.col("known") == F.col("n")) & (F.col("owners") == F.col("n")) & (F.col("chosen") == 0) & F.col("clash").isNull()
    return out.select("action", ok.alias("valid"))


def valid_windows(actions: DataFrame, vertices: DataFrame, rule: dict[str, int], sel: DataFrame) -> DataFrame:
    """``valid_actions`` by the windows of the inserts; ids must be distinct.  Of each action the first and the last insert tell, for more than two are not valid."""
    window = F.struct(*dict.fromkeys(("cid", "s", "e", *rule)))
    own = vertices.select("cid", "owner", window.alias("x"))
    known = actions.select("action", "cid").join(own, "cid", "left").join(sel.select("cid", F.lit(1).alias("chosen")), "cid", "left")
    out = known.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.min("cid").alias("c1"), F.max("cid").alias("c2"), F.count("owner").alias("known"), F.min("owner").alias("o1"), F.max("owner").alias("o2"), F.count("chosen").alias("chosen"),
        F.min("x").alias("x1"), F.max("x").alias("x2"),
    )
    side = lambda k: lambda c: F.col(f"{k}.{c}")
    two = (F.col("n") == 2) & (F.col("c1") < F.col("c2")) & (F.col("o1") < F.col("o2")) & (conflict.clash_type(rule, side("x1"), side("x2")) == 0)
    ok = ((F.col("n") == 1) | two) & (F.col("known") == F.col("n")) & (F.col("chosen") == 0)
    return out.select("action", F.coalesce(ok, F.lit(False)).alias("valid"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges inside a node set (grp, cid) of each group, with local ids by rank of cid; ``edges`` may be (grp, u, v) of these alone."""
    at = [k for k in ("grp", "u") if k in edges.columns]
    local = nodes.select("grp", "cid").withColumn("id", F.row_number().over(Window.partitionBy("grp").orderBy("cid")) - 1)
    left = local.select("grp", F.col("cid").alias("u"), F.col("id").alias("lu"))
    right = local.select("grp", F.col("cid").alias("v"), F.col("id").alias("lv"))
    return left.join(edges.select(*at, "v"), at).join(right, ["grp", "v"]).select("grp", "u", "v", "lu", "lv")


def touched_cliques(members: DataFrame, scope: DataFrame, edges: DataFrame) -> DataFrame:
    """(action, clique, size) of cliques with at least two scope members that are pairwise adjacent."""
    inside = members.join(scope.select("action", "cid"), "cid").select("action", "clique", "cid").distinct()
    size = inside.groupBy("action", "clique").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    inside = inside.join(size.select("action", "clique"), ["action", "clique"], "left_semi")
    pairs = inside.withColumnRenamed("cid", "u").join(edges.select("u", "v"), "u").join(inside.withColumnRenamed("cid", "v"), ["action", "clique", "v"], "left_semi")
    found = pairs.groupBy("action", "clique").agg(F.count(F.lit(1)).alias("links"))
    return size.join(found, ["action", "clique"]).where("links = size * (size - 1) / 2").select("action", "clique", "size")


def touched_windows(vertices: DataFrame, gone: DataFrame, near: DataFrame, rule: dict[str, int], resource: str) -> DataFrame:
    """``touched_cliques`` of the windows of each resource in the spheres of displaced (selected) vertices, by ``near`` (u, v): arcs to these.

    Windows that do not end before they start and all conflict lie so close that the last start is within the longest gap of the
    first end.  Starts and ends are known for each displaced vertex and resource, and members are listed only where that holds.
    """
    columns = dict.fromkeys(("s", "e", *rule))
    around = gone.select("cid").distinct().select(F.col("cid").alias("b"), "cid").union(near.select(F.col("v").alias("b"), F.col("u").alias("cid")))
    around = stored(around.join(vertices.select("cid", *columns), "cid").where(F.col(resource).isNotNull()).withColumn("clique", F.col(resource)), "around")
    extent = around.groupBy("b", "clique").agg(F.max("s").alias("s"), F.min("e").alias("e"), F.count(F.lit(1)).alias("n"))
    acting = gone.select("action", F.col("cid").alias("b"))
    close = acting.join(extent, "b").groupBy("action", "clique").agg(F.max("s").alias("s"), F.min("e").alias("e"), F.sum("n").alias("n"))
    close = close.where((F.col("n") > 1) & (F.col("s") < F.col("e") + max(rule.values()))).select("action", "clique")
    listed = acting.join(close, "action").join(around, ["b", "clique"]).select(F.struct("action", "clique").alias("grp"), "cid", *columns).distinct()
    listed = stored(listed, "listed")
    size = listed.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    links = conflict.scope_conflicts(listed, vertices, rule, "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("links"))
    return size.join(links, "grp").where("links = size * (size - 1) / 2").select("grp.action", "grp.clique", "size")


def symmetric_distance(a: DataFrame, b: DataFrame, vertices: DataFrame) -> DataFrame:
    """Weight and number of vertices in exactly one of two selections, and in their union."""
    both = a.select("cid", F.lit(1).alias("x")).join(b.select("cid", F.lit(1).alias("y")), "cid", "full_outer").join(vertices.select("cid", "w"), "cid")
    one = F.col("x").isNull() | F.col("y").isNull()
    return both.agg(F.coalesce(F.sum(F.when(one, F.col("w"))), F.lit(0)).alias("distance"), F.count_if(one).alias("differing"), F.count(F.lit(1)).alias("in_union"))


def swapped(sel: DataFrame, gone: DataFrame, inserts: DataFrame) -> DataFrame:
    """(sel - gone) + inserts."""
    return sel.select("cid").join(gone.select("cid"), "cid", "left_anti").union(inserts.select("cid")).distinct()


def unique_actions(actions: DataFrame) -> DataFrame:
    """One action id, the smallest, for each set of inserts."""
    sets = actions.groupBy("action").agg(F.array_sort(F.collect_set("cid")).alias("inserts"))
    return sets.groupBy("inserts").agg(F.min("action").alias("action")).select("action", "inserts")
