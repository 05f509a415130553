"""Registered queries over the driver tables, each with the DuckDB SQL that checks it where SQL can.

Stand-ins: contacts and their conflict graph come from ``events``; metrics with missing values from ``orders`` and
``customer``; paired methods from ``lineitem``; similar items from ``part``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conflux.functions import scalars as X
from conflux.operators import admission, conflict, greedy, groups, pairs, policy, recover, selection, stats, vectors, windows
from conflux.sources import sinks
from conflux.sources.contacts import ANTENNA_GAP, OWNER_GAP, contacts, decode_ragged, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return keep


# Shared pieces of SQL -------------------------------------------------------------------------------------------------

CONTACTS = """c AS MATERIALIZED (SELECT event_id AS cid, user_id AS owner, CAST(json_extract_string(props, '$.k') AS INT) AS ant, epoch_us(ts) AS s,
  CAST(round(value * 100) AS BIGINT) * 10000 AS w, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 10000 AS e FROM events WHERE value > 0)"""


def gap_sql(resource: str, gap: int) -> str:
    return f"""SELECT least(a.cid, b.cid) AS u, greatest(a.cid, b.cid) AS v FROM c a JOIN c b ON a.{resource} = b.{resource}
  AND (a.s < b.s OR (a.s = b.s AND a.cid < b.cid)) AND b.s < a.e + {gap}"""


def edges_sql(ant: int = ANTENNA_GAP, owner: int = OWNER_GAP, name: str = "e") -> str:
    return f"""{name} AS MATERIALIZED (SELECT u, v, CAST(bit_or(t) AS INT) AS etype FROM (
  SELECT u, v, 1 AS t FROM ({gap_sql("ant", ant)}) UNION ALL SELECT u, v, 2 FROM ({gap_sql("owner", owner)})) GROUP BY u, v)"""


GRAPH = f"WITH {CONTACTS}, {edges_sql()}"
SELECTED = f"""{GRAPH}, adj AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
sel AS MATERIALIZED (SELECT cid FROM c WHERE NOT EXISTS (SELECT 1 FROM adj JOIN c n ON n.cid = adj.v WHERE adj.u = c.cid AND (n.w > c.w OR (n.w = c.w AND n.cid < c.cid)))),
outs AS (SELECT cid FROM c WHERE cid NOT IN (SELECT cid FROM sel)),
ablk AS MATERIALIZED (SELECT outs.cid, adj.v AS b, n.w AS bw FROM outs JOIN adj ON adj.u = outs.cid JOIN c n ON n.cid = adj.v WHERE adj.v IN (SELECT cid FROM sel)),
ad AS MATERIALIZED (SELECT c.cid, coalesce(sum(bw), 0) - c.w AS d FROM c LEFT JOIN ablk ON ablk.cid = c.cid WHERE c.cid IN (SELECT cid FROM outs) GROUP BY c.cid, c.w),
ash AS (SELECT x.cid AS a, y.cid AS z, sum(x.bw) AS shared FROM ablk x JOIN ablk y ON x.b = y.b AND x.cid < y.cid GROUP BY ALL),
two AS (SELECT a, z FROM ash JOIN ad p ON p.cid = a JOIN ad q ON q.cid = z WHERE shared - p.d - q.d > 0 AND NOT EXISTS (SELECT 1 FROM e WHERE u = a AND v = z)),
act AS MATERIALIZED (SELECT cid AS action, cid FROM outs UNION ALL SELECT -(z * (z - 1) // 2 + a + 1), unnest([a, z]) FROM two),
gone AS MATERIALIZED (SELECT DISTINCT action, adj.v AS cid FROM act JOIN adj ON adj.u = act.cid WHERE adj.v IN (SELECT cid FROM sel))"""
SPHERE = f"""{SELECTED}, sph AS MATERIALIZED (SELECT action, cid FROM gone UNION SELECT action, adj.v FROM gone JOIN adj ON adj.u = gone.cid)"""
ELIGIBLE = f"""{SPHERE}, base AS (SELECT a.action, sel.cid FROM (SELECT DISTINCT action FROM gone) a, sel WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.action = a.action AND g.cid = sel.cid)
  UNION SELECT action, cid FROM act),
elig AS MATERIALIZED (SELECT action, cid FROM sph WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.action = sph.action AND b.cid = sph.cid)
  AND NOT EXISTS (SELECT 1 FROM base b JOIN adj ON adj.v = b.cid WHERE b.action = sph.action AND adj.u = sph.cid))"""
POOL = f"""{ELIGIBLE}, pool AS MATERIALIZED (SELECT action, CAST(row_number() OVER (PARTITION BY action ORDER BY w DESC, cid) AS INT) AS pos, cid, w FROM elig JOIN c USING (cid))"""
BLOCKED = f"""{SELECTED}, blk AS MATERIALIZED (SELECT outs.cid, adj.v AS b, n.w AS bw FROM outs JOIN adj ON adj.u = outs.cid JOIN c n ON n.cid = adj.v WHERE adj.v IN (SELECT cid FROM sel)),
d AS MATERIALIZED (SELECT c.cid, c.w, c.owner, coalesce(sum(bw), 0) AS bw, coalesce(sum(bw), 0) - c.w AS d FROM c LEFT JOIN blk ON blk.cid = c.cid WHERE c.cid IN (SELECT cid FROM outs) GROUP BY c.cid, c.w, c.owner)"""
METRIC = """m AS (SELECT o_orderkey AS state, c_custkey AS graph, c_nationkey AS source, CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 9 <> 0 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) END AS x
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
RUNS = """r AS (SELECT user_id AS run, epoch_us(ts) AS t, event_id AS id, event_type AS kind, value, min(epoch_us(ts)) OVER (PARTITION BY user_id) + 864000000000 AS deadline FROM events)"""


def pair_id(a: str, b: str) -> Column:
    """A negative number of its own for each pair 0 <= a < b."""
    return -(F.expr(f"{b} * ({b} - 1) div 2") + F.col(a) + 1)


class Graph:
    """The stand-in conflict graph and what is derived from it.

    Edges, adjacency, selection and scopes are each read several times by what follows, so they are written once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, ant: int = ANTENNA_GAP, owner: int = OWNER_GAP):
        self.c = greedy.written(contacts(spark, sf_dir), "contacts")
        self.rule = {"ant": ant, "owner": owner}

    @cached_property
    def plain(self) -> DataFrame:
        return conflict.conflict_edges(self.c, self.rule["ant"], self.rule["owner"])

    @cached_property
    def distinct(self) -> bool:
        return conflict.distinct_ids(self.c)

    @cached_property
    def forward(self) -> bool:
        """Whether no window ends before it starts."""
        return self.c.where("e < s").isEmpty()

    @cached_property
    def degrees(self) -> DataFrame:
        return conflict.counted_degrees(self.c, self.rule)

    @cached_property
    def e(self) -> DataFrame:
        return greedy.written(self.plain, "edges")

    @cached_property
    def adj(self) -> DataFrame:
        return greedy.written(conflict.symmetric(self.e), "adj")

    @cached_property
    def sel(self) -> DataFrame:
        found = selection.local_best_windows(self.c, self.rule) if self.distinct else selection.local_best(self.c, self.e)
        return greedy.written(found, "sel")

    @cached_property
    def near_sel(self) -> DataFrame:
        """What ``adj`` has of arcs to selected vertices."""
        return greedy.written(selection.near_selected(self.c, self.rule, self.sel), "near_sel") if self.distinct else self.adj

    @cached_property
    def outs(self) -> DataFrame:
        return self.c.select("cid").join(self.sel, "cid", "left_anti")

    @cached_property
    def act(self) -> DataFrame:
        """Every unselected contact as a single action, under its own id, and every two-hop pair that pays, under a negative id."""
        two = self.two
        return greedy.written(self.outs.select(F.col("cid").alias("action"), "cid").union(two.select(pair_id("a", "b").alias("action"), F.explode(F.array("a", "b")).alias("cid"))), "act")

    @cached_property
    def two(self) -> DataFrame:
        if not self.distinct:
            return pairs.two_hop_pairs(self.c, self.e, self.blk, self.sel)
        return pairs.two_hop_pairs(self.c, None, self.blk, self.sel, apart=lambda met: conflict.pair_types(met.withColumnsRenamed({"a": "u", "c": "v"}), self.c, self.rule).where("etype = 0").withColumnsRenamed({"u": "a", "v": "c"}))

    @cached_property
    def singles(self) -> DataFrame:
        return self.act.where("action >= 0")

    @cached_property
    def gone(self) -> DataFrame:
        return greedy.written(selection.displaced(self.act, self.near_sel, self.sel), "gone")

    @cached_property
    def elig(self) -> DataFrame:
        return self.scope.select("action", "cid")

    @cached_property
    def found(self) -> DataFrame:
        """All eligible vertices with their own columns, for one reader."""
        if self.distinct:
            return selection.eligible_windows(self.act, self.gone, self.blk, self.c, self.rule, own=True)
        return selection.eligible(self.act, self.gone, self.adj, self.sel).join(self.c, "cid")

    @cached_property
    def scope(self) -> DataFrame:
        return greedy.written(self.found, "elig")

    @cached_property
    def pool(self) -> DataFrame:
        return selection.pool(self.scope, self.c)

    @cached_property
    def weighed(self) -> DataFrame:
        """All eligible vertices with weight and owner, whatever their place in the pool."""
        return self.scope.select("action", "cid", "w", "owner")

    def inside(self, scope: DataFrame, key: str = "action") -> DataFrame:
        """(key, u, v), u < v: conflicts inside scopes (key, cid); where ids are not distinct, all edges (u, v)."""
        return greedy.written(conflict.scope_conflicts(scope, self.c, self.rule, key), "inside") if self.distinct else self.e

    def near(self, chosen: DataFrame, scope: DataFrame, key: str) -> DataFrame:
        """What ``adj`` has of arcs from or to ``chosen`` vertices and of those inside small scopes (key, cid)."""
        if not self.distinct:
            return self.adj
        arcs = selection.near_selected(self.c, self.rule, chosen.select("cid"))
        return greedy.written(conflict.symmetric(arcs.union(groups.window_conflicts(scope, self.c, self.rule, key).select("u", "v"))), "near")

    @cached_property
    def blk(self) -> DataFrame:
        return greedy.written(pairs.blockers(self.c, self.near_sel, self.sel), "blk")


# Scans, edges and their statistics ------------------------------------------------------------------------------------


@query(f"WITH {CONTACTS} SELECT * FROM c")
def s01_contacts(spark, d):
    return contacts(spark, d)


@query(f"{GRAPH} SELECT * FROM e")
def j01_gap_edges(spark, d):
    return Graph(spark, d).plain


@query(
    f"""{GRAPH}, t AS (SELECT x AS cid, count(*) AS n FROM (SELECT u AS x FROM e UNION ALL SELECT v FROM e) GROUP BY x)
SELECT c.ant, count(*) AS vertices, CAST(sum(coalesce(n, 0)) AS BIGINT) AS degree_sum, CAST(max(coalesce(n, 0)) AS BIGINT) AS degree_max, count(*) FILTER (coalesce(n, 0) = 0) AS isolated, CAST(sum(w) AS BIGINT) AS weight
FROM c LEFT JOIN t USING (cid) GROUP BY c.ant"""
)
def flagship(spark, d):
    """Degree statistics of every antenna over the conflicts of all contacts."""
    g = Graph(spark, d)
    rows = g.c.join(g.degrees, "cid")
    return rows.groupBy("ant").agg(
        F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("degree_sum"), F.max("degree").alias("degree_max"), F.count_if(F.col("degree") == 0).alias("isolated"), F.sum("w").alias("weight")
    )


@query(f"WITH {CONTACTS} SELECT DISTINCT u, v FROM ({gap_sql('ant', ANTENNA_GAP)} UNION ALL {gap_sql('owner', OWNER_GAP)})")
def j02_setup_edges(spark, d):
    g = Graph(spark, d)
    return conflict.setup_conflicts(g.c, g.rule)


@query(f"{GRAPH} SELECT u, v FROM e UNION SELECT v, u FROM e")
def j03_adjacency(spark, d):
    g = Graph(spark, d)
    return conflict.both_at_once(g.plain) if g.distinct else g.adj


@query(f"WITH {CONTACTS}, {edges_sql(ANTENNA_GAP // 2, OWNER_GAP // 2, 'lo')}, {edges_sql(name='hi')} SELECT lo.u, lo.v FROM lo WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.u = lo.u AND hi.v = lo.v)")
def j19_monotone_edges(spark, d):
    lo, hi = Graph(spark, d, ANTENNA_GAP // 2, OWNER_GAP // 2), Graph(spark, d)
    if conflict.distinct_ids(hi.c):
        return conflict.beyond(hi.c, lo.rule, hi.rule)
    return conflict.not_contained(lo.plain, hi.plain).select("u", "v")


@query(f"{GRAPH} SELECT c.cid AS u, c.cid + 10 AS v, coalesce(e.etype, 0) AS etype FROM c LEFT JOIN e ON e.u = c.cid AND e.v = c.cid + 10")
def j20_edge_lookup(spark, d):
    g = Graph(spark, d)
    near = g.c.select((F.col("cid") + 10).alias("v"), F.col("cid").alias("u"))
    found = conflict.pair_types(near, g.c, g.rule) if conflict.distinct_ids(g.c) else conflict.edge_lookup(near, g.e)
    return found.select("u", "v", "etype")


@query(
    f"""{GRAPH} SELECT u, v, greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) AS overlap, b.s < a.s AS extends_left, b.e > a.e AS extends_right, (b.s >= a.s AND b.e <= a.e) AS contained,
a.owner = b.owner AS same_owner, a.ant = b.ant AS same_antenna FROM e JOIN c a ON a.cid = u JOIN c b ON b.cid = v"""
)
def j21_pair_relation(spark, d):
    g = Graph(spark, d)
    return conflict.window_relation(g.c, g.rule) if g.distinct else conflict.pair_relation(g.e, g.c)


@query(f"WITH {CONTACTS} SELECT DISTINCT u, v FROM ({gap_sql('ant', 0)} UNION ALL {gap_sql('owner', 0)})")
def j23_overlap_edges(spark, d):
    c = contacts(spark, d)
    return conflict.gap_conflicts(c, "ant", 0, 10**9).union(conflict.gap_conflicts(c, "owner", 0, 10**9)).distinct()


@query(f"{GRAPH} SELECT count(*) AS edges, count(*) FILTER (etype & 1 <> 0) AS antenna_edges, count(*) FILTER (etype & 2 <> 0) AS owner_edges, count(*) FILTER (etype = 3) AS double_edges FROM e")
def a01_typed_edge_stats(spark, d):
    g = Graph(spark, d)
    return conflict.counted_stats(g.c, *g.rule.values())


@query(f"{GRAPH}, x AS (SELECT u AS cid FROM e UNION ALL SELECT v FROM e) SELECT c.cid, count(x.cid) AS degree FROM c LEFT JOIN x ON x.cid = c.cid GROUP BY c.cid")
def a02_degrees(spark, d):
    return Graph(spark, d).degrees


@query(f"WITH {CONTACTS} SELECT ant, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM c WHERE ant IN (SELECT DISTINCT CAST(p_size AS INT) FROM part WHERE p_size % 3 = 0) GROUP BY ant")
def f01_station_view(spark, d):
    view = table(spark, d, "part").where("p_size % 3 = 0").select(F.col("p_size").cast("int").alias("ant")).distinct()
    return contacts(spark, d).join(view, "ant", "left_semi").groupBy("ant").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


@query(
    """WITH p AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS ok, o_totalprice AS x FROM orders)
SELECT k, x FROM p WHERE ok IS NOT DISTINCT FROM true AND x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)"""
)
def f02_signal_eligibility(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("case o_orderstatus when 'O' then true when 'F' then false end").alias("ok"), F.col("o_totalprice").alias("x"))
    return rows.where(F.col("ok").eqNullSafe(True) & X.finite(F.col("x")).isNotNull()).select("k", "x")


@query(
    f"""WITH {CONTACTS}, h AS (SELECT min(s) + 864000000000 AS z, 1728000000000 AS hor FROM c), x AS (SELECT cid, s - z AS a, e - z + 600000000 AS b, hor FROM c, h)
SELECT cid, CASE WHEN b <= 0 THEN 'outside_before' WHEN a >= hor THEN 'outside_after' WHEN a < 0 AND b > hor THEN 'both' WHEN a < 0 THEN 'left' WHEN b > hor THEN 'right' ELSE 'none' END AS class FROM x"""
)
def f07_interval_class(spark, d):
    c = contacts(spark, d)
    zero = c.agg((F.min("s") + 864_000_000_000).alias("z"))
    x = c.join(F.broadcast(zero))  # one row
    return x.select("cid", X.interval_class(F.col("s") - F.col("z"), F.col("e") - F.col("z") + 600_000_000, F.lit(1_728_000_000_000)).alias("class"))


# Selections and scopes ------------------------------------------------------------------------------------------------


@query(f"{SELECTED} SELECT sel.cid, w FROM sel JOIN c USING (cid)")
def g01_local_best(spark, d):
    g = Graph(spark, d)
    return g.sel.join(g.c.select("cid", "w"), "cid")


@query(f"{SELECTED} SELECT * FROM gone")
def j04_displaced(spark, d):
    return Graph(spark, d).gone


@query(f"{SPHERE} SELECT * FROM sph")
def j05_sphere(spark, d):
    g = Graph(spark, d)
    return selection.sphere_windows(g.gone, g.blk) if g.distinct else selection.sphere(g.gone, g.adj)


@query(f"{ELIGIBLE} SELECT * FROM elig")
def j06_eligible(spark, d):
    return Graph(spark, d).found.select("action", "cid")


@query(f"{SELECTED} SELECT u, v, etype FROM e WHERE u IN (SELECT cid FROM sel) AND v IN (SELECT cid FROM sel)")
def j07_violations(spark, d):
    g = Graph(spark, d)
    return selection.violations(g.e, g.sel).select("u", "v", "etype")


@query(
    f"""{ELIGIBLE}, l AS (SELECT action, cid, row_number() OVER (PARTITION BY action ORDER BY cid) - 1 AS id FROM elig)
SELECT a.action AS grp, e.u, e.v, CAST(a.id AS INT) AS lu, CAST(b.id AS INT) AS lv FROM e JOIN l a ON a.cid = e.u JOIN l b ON b.cid = e.v AND b.action = a.action"""
)
def j08_induced(spark, d):
    g = Graph(spark, d)
    scope = g.scope.withColumnRenamed("action", "grp")
    return selection.induced(scope.select("grp", "cid"), g.inside(scope, "grp"))


@query(
    f"""{POOL}, met AS (SELECT x.action, x.cid AS u, y.cid AS v, x.w + y.w AS w FROM pool x JOIN pool y ON x.action = y.action AND x.cid < y.cid JOIN c a ON a.cid = x.cid JOIN c b ON b.cid = y.cid AND a.owner <> b.owner
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = x.cid AND e.v = y.cid)),
blk AS (SELECT adj.u AS cid, adj.v AS b, n.w AS bw FROM adj JOIN c n ON n.cid = adj.v WHERE adj.v IN (SELECT cid FROM sel) AND adj.u NOT IN (SELECT cid FROM sel)),
lost AS (SELECT action, u, v, sum(bw) AS lost FROM (SELECT DISTINCT action, u, v, b, bw FROM met JOIN blk ON blk.cid IN (u, v)) GROUP BY ALL)
SELECT action, u, v, CAST(met.w - coalesce(lost, 0) AS BIGINT) AS gain FROM met LEFT JOIN lost USING (action, u, v)"""
)
def j09_compatible_pairs(spark, d):
    g = Graph(spark, d)
    if g.distinct:
        found = selection.eligible_windows(g.act, g.gone, g.blk, g.c, g.rule, costs=True)
        return pairs.compatible_windows(greedy.written(found, "elig"), g.rule)
    return pairs.compatible_pairs(g.weighed, g.e, g.blk)


@query(
    f"""{BLOCKED}, sh AS (SELECT x.cid AS a, y.cid AS b, sum(x.bw) AS shared FROM blk x JOIN blk y ON x.b = y.b AND x.cid < y.cid GROUP BY ALL)
SELECT a, sh.b, CAST(shared - p.d - q.d AS BIGINT) AS gain FROM sh JOIN d p ON p.cid = a JOIN d q ON q.cid = sh.b WHERE shared - p.d - q.d > 0 AND NOT EXISTS (SELECT 1 FROM e WHERE u = a AND v = sh.b)"""
)
def j10_two_hop_pairs(spark, d):
    g = Graph(spark, d)
    return g.two


@query(
    f"""{SPHERE}, cq AS (SELECT ant AS clique, cid FROM c), ins AS (SELECT action, clique, cq.cid FROM cq JOIN sph USING (cid)),
sz AS (SELECT action, clique, count(*) AS size FROM ins GROUP BY ALL HAVING count(*) >= 2),
lk AS (SELECT x.action, x.clique, count(*) AS links FROM ins x JOIN e ON e.u = x.cid JOIN ins y ON y.cid = e.v AND y.action = x.action AND y.clique = x.clique GROUP BY ALL)
SELECT action, clique, size FROM sz JOIN lk USING (action, clique) WHERE links = size * (size - 1) / 2"""
)
def j12_touched_cliques(spark, d):
    g = Graph(spark, d)
    if g.distinct:
        return selection.touched_windows(g.c, g.gone, g.near_sel, g.rule, "ant")
    return selection.touched_cliques(g.c.select(F.col("ant").alias("clique"), "cid"), selection.sphere(g.gone, g.adj), g.e)


@query(
    """WITH a AS (SELECT c_custkey AS action, CAST(c_nationkey AS INT) * 8 AS pool_size FROM customer), x AS (SELECT action, cap, least(cap, pool_size) AS used FROM a, (SELECT unnest([16, 64, 128]) AS cap)),
u AS (SELECT *, row_number() OVER (PARTITION BY action, used ORDER BY cap) AS n FROM x)
SELECT action, cap, used, workpoint, amount, expected FROM u, (VALUES ('short', 0.01::DOUBLE, 0.03::DOUBLE), ('long', 0.2::DOUBLE, 0.21::DOUBLE)) w(workpoint, amount, expected) WHERE n = 1"""
)
def j13_requests(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("action"), (F.col("c_nationkey").cast("int") * 8).alias("pool_size"))
    return policy.requests(a, [16, 64, 128], [("short", 0.01, 0.03), ("long", 0.2, 0.21)]).select("action", "cap", "used", "workpoint", "amount", "expected")


_L = "l AS (SELECT l_suppkey AS k, l_returnflag AS f, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS x FROM lineitem GROUP BY ALL)"


def _supplier_flags(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("f")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("x"))


@query(
    f"""WITH {_L}, a AS (SELECT k, x FROM l WHERE f = 'A'), r AS (SELECT k, x FROM l WHERE f = 'R')
SELECT k, a.x AS base, r.x AS other, a.x - r.x AS delta, concat_ws('+', CASE WHEN a.x IS NULL THEN 'no base' END, CASE WHEN r.x IS NULL THEN 'no other' END) AS reason FROM a FULL JOIN r USING (k)"""
)
def j15_workpoint_pairs(spark, d):
    return stats.paired(_supplier_flags(spark, d), ["k"], "f", "A", "R", "x")


@query(
    """SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE abs(a.p_size - b.p_size) <= 0.1 * greatest(a.p_size, b.p_size) AND abs(a.p_retailprice - b.p_retailprice) / greatest(1.0::DOUBLE, abs(a.p_retailprice), abs(b.p_retailprice)) <= 0.05"""
)
def j16_similar_pairs(spark, d):
    return pairs.similar_pairs(table(spark, d, "part"), "p_brand", "p_partkey", "p_size", 0.1, ["p_retailprice"], 0.05)


@query(
    """WITH g AS (SELECT n_nationkey AS nation, y FROM nation, (SELECT unnest(range(1992, 1999)) AS y)),
r AS (SELECT DISTINCT c_nationkey AS nation, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT nation, CAST(y AS INT) AS y FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.nation = g.nation AND r.y = g.y)"""
)
def j18_matrix_gaps(spark, d):
    plan = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.sequence(F.lit(1992), F.lit(1998))).alias("y"))
    got = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("y"))
    return stats.plan_gaps(plan, got, ["nation", "y"])


@query(
    f"""{BLOCKED}, fresh AS (SELECT cid FROM outs), nr AS (SELECT b, cid FROM blk WHERE cid IN (SELECT cid FROM fresh)), many AS (SELECT b, count(*) AS n FROM nr GROUP BY b HAVING count(*) >= 2)
SELECT b, n FROM many WHERE NOT EXISTS (SELECT 1 FROM nr x JOIN e ON e.u = x.cid JOIN nr y ON y.cid = e.v AND y.b = x.b WHERE x.b = many.b)"""
)
def j22_bundles(spark, d):
    g = Graph(spark, d)
    return pairs.bundles_windows(g.blk, g.outs, g.c, g.rule) if g.distinct else pairs.bundles(g.blk, g.outs, g.e)


@query(f"{SELECTED}, ev AS (SELECT action, CAST(sum(x) AS BIGINT) AS gain FROM (SELECT action, w AS x FROM act JOIN c USING (cid) UNION ALL SELECT action, -w FROM gone JOIN c USING (cid)) GROUP BY action) SELECT * FROM ev")
def f10_immediate_gain(spark, d):
    g = Graph(spark, d)
    return selection.immediate_gain(g.act, g.gone, g.c)


@query(
    f"""{SELECTED}, all_act AS (SELECT * FROM act UNION ALL SELECT -((cid + 1) * ((cid + 1) - 1) // 2 + cid + 1), cid + k FROM sel, (SELECT 0 AS k UNION ALL SELECT 1)),
o AS (SELECT action, count(*) AS n, count(DISTINCT a.cid) AS dn, count(owner) AS kn, count(DISTINCT owner) AS ow, count(sel.cid) AS ch FROM all_act a LEFT JOIN c ON c.cid = a.cid LEFT JOIN sel ON sel.cid = a.cid GROUP BY action),
cl AS (SELECT DISTINCT x.action FROM all_act x JOIN adj ON adj.u = x.cid JOIN all_act y ON y.cid = adj.v AND y.action = x.action)
SELECT action, (n BETWEEN 1 AND 2 AND dn = n AND kn = n AND ow = n AND ch = 0 AND action NOT IN (SELECT action FROM cl)) AS valid FROM o"""
)
def f11_valid_actions(spark, d):
    g = Graph(spark, d)
    bad = g.sel.select(F.col("cid").alias("a"), (F.col("cid") + 1).alias("b"))  # selected first inserts: not valid, and no pair of act
    more = bad.select(pair_id("a", "b").alias("action"), F.explode(F.array("a", "b")).alias("cid"))
    actions = g.act.union(more)
    return selection.valid_windows(actions, g.c, g.rule, g.sel) if g.distinct else selection.valid_actions(actions, g.c, g.adj, g.sel)


@query(f"{POOL} SELECT * FROM pool WHERE pos <= 256")
def o01_pool(spark, d):
    return Graph(spark, d).pool


@query(f"{SELECTED} SELECT cid FROM sel WHERE cid NOT IN (SELECT cid FROM gone WHERE action >= 0) UNION SELECT cid FROM act WHERE action >= 0")
def u01_swapped(spark, d):
    g = Graph(spark, d)
    return selection.swapped(g.sel, g.gone.where("action >= 0"), g.singles)


@query(f"{SELECTED} SELECT action, cid FROM gone UNION SELECT action, sel.cid FROM (SELECT DISTINCT action FROM act WHERE action >= 0) JOIN sel ON sel.cid = action + 1")
def u02_released(spark, d):
    g = Graph(spark, d)
    extra = g.singles.select("action", (F.col("action") + 1).alias("cid")).join(g.sel, "cid", "left_semi").select("action", "cid")
    return selection.released(g.gone, extra)


@query(f"{POOL} SELECT action, cid FROM pool WHERE pos <= 3 AND cid % 2 = 0")
def u03_known_part(spark, d):
    p = Graph(spark, d).pool
    return p.where("pos <= 3").select("action", "cid").intersect(p.where("cid % 2 = 0").select("action", "cid"))


@query(f"{SELECTED}, b AS (SELECT cid FROM c WHERE cid % 3 = 0) SELECT CAST(sum(w) FILTER (x IS NULL OR y IS NULL) AS BIGINT) AS distance, count(*) FILTER (x IS NULL OR y IS NULL) AS differing, count(*) AS in_union FROM (SELECT coalesce(sel.cid, b.cid) AS cid, sel.cid AS x, b.cid AS y FROM sel FULL JOIN b ON sel.cid = b.cid) JOIN c USING (cid)")
def u05_distance(spark, d):
    g = Graph(spark, d)
    return selection.symmetric_distance(g.sel, g.c.where("cid % 3 = 0").select("cid"), g.c)


@query(f"{GRAPH}, near AS (SELECT u, list_sort(list(v + 1)) AS l FROM (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) GROUP BY u) SELECT cid AS v, rtrim(concat_ws(' ', w::VARCHAR, coalesce(array_to_string(l, ' '), ''))) AS line FROM c LEFT JOIN near ON near.u = c.cid UNION ALL SELECT -1, (SELECT count(*) FROM c)::VARCHAR || ' ' || (SELECT count(*) FROM e)::VARCHAR || ' 10'")
def k04_metis_lines(spark, d):
    g = Graph(spark, d)
    return sinks.metis_lines(g.c.select(F.col("cid").alias("v"), "w"), g.e)


@query(
    f"""{GRAPH} SELECT count(*) AS triangles FROM e x JOIN e y ON x.u = y.u AND x.v < y.v JOIN e z ON z.u = x.v AND z.v = y.v"""
)
def a24_triangles(spark, d):
    g = Graph(spark, d)
    return conflict.counted_triangles(g.c, g.rule) if g.distinct and g.forward else pairs.triangles(g.e)


@query(f"{BLOCKED} SELECT count(*) AS blockers, CAST(coalesce(sum(k * (k - 1) // 2), 0) AS BIGINT) AS pairs, max(k) AS largest FROM (SELECT b, count(*) AS k FROM blk GROUP BY b)")
def r02_pair_estimate(spark, d):
    return pairs.pair_estimate(Graph(spark, d).blk)


@query(f"{BLOCKED} SELECT cid, w, owner, CAST(bw AS BIGINT) AS blocked_weight, CAST(d AS BIGINT) AS d FROM d")
def g17_deficits(spark, d):
    g = Graph(spark, d)
    return pairs.deficits(g.c, g.blk, g.sel)


# Statistics -----------------------------------------------------------------------------------------------------------


def _metric(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = F.when((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 9 != 0), F.round(F.col("o_totalprice") * 100).cast("long").cast("double"))  # cents: exact sums
    return rows.select(F.col("o_orderkey").alias("state"), F.col("c_custkey").alias("graph"), F.col("c_nationkey").alias("source"), x.alias("x"))


_MEAN = "CASE WHEN count(*) = count(x) THEN avg(x) END"


@query(f"WITH {METRIC}, g AS (SELECT source, graph, {_MEAN} AS x FROM m GROUP BY ALL) SELECT source, graph, x AS mean FROM g")
def a03_graph_means(spark, d):
    return stats.strict_levels(_metric(spark, d), "x", [["source", "graph"]])[0].select("source", "graph", "mean")


@query(
    f"""WITH {METRIC}, k AS (SELECT state, graph, source, CASE WHEN x IS NULL AND source % 3 <> 0 THEN 0.0::DOUBLE ELSE x END AS x FROM m), g AS (SELECT source, graph, {_MEAN} AS x FROM k GROUP BY ALL), s AS (SELECT source, {_MEAN} AS x, count(*) AS n FROM g GROUP BY source)
SELECT source, round(x, 2) AS mean, n FROM s UNION ALL SELECT -1, round({_MEAN}, 2), count(*) FROM s"""
)
def a03_strict_means(spark, d):
    rows = _metric(spark, d).withColumn("x", F.expr("case when x is null and source % 3 <> 0 then 0d else x end"))  # a third of the sources has gaps
    levels = stats.strict_levels(rows, "x", [["source", "graph"], ["source"], []])
    overall = levels[2].select(F.lit(-1).cast(levels[1].schema["source"].dataType).alias("source"), F.round("mean", 2).alias("mean"), "n")
    return levels[1].select("source", F.round("mean", 2).alias("mean"), "n").unionByName(overall)


@query(f"WITH {_L} SELECT k, CASE WHEN list_sort(list(f)) = ['A', 'N', 'R'] AND count(*) = count(x) THEN avg(x) END AS mean, count(x) AS complete, count(*) - count(x) AS incomplete FROM l GROUP BY k")
def a04_grid_means(spark, d):
    return stats.grid_mean(_supplier_flags(spark, d), ["k"], "f", "x", ["A", "N", "R"])


@query(
    f"""WITH {_L}, s AS (SELECT s_suppkey AS k, s_nationkey AS nation FROM supplier), g AS (SELECT k, CASE WHEN count(*) = count(x) THEN avg(x) END AS x FROM l GROUP BY k),
f AS (SELECT nation, avg(x) AS x FROM g JOIN s USING (k) GROUP BY nation) SELECT count(*) AS families, round({_MEAN}, 2) AS mean FROM f"""
)
def a07_family_means(spark, d):
    rows = _supplier_flags(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation")), "k")
    return stats.strict_levels(rows, "x", [["nation", "k"], ["nation"], []])[-1].select(F.col("n").alias("families"), F.round("mean", 2).alias("mean"))


@query("SELECT o_orderpriority AS p, round(sum(o_totalprice * (o_orderkey % 7)) / sum(o_orderkey % 7), 2) AS mean, CAST(sum(o_orderkey % 7) AS BIGINT) AS mass FROM orders GROUP BY p")
def a09_weighted_means(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), (F.col("o_orderkey") % 7).cast("long").alias("w"), F.col("o_totalprice").alias("x"))
    return stats.weighted_mean(rows, ["p"], "w", "x").select("p", F.round("mean", 2).alias("mean"), "mass")


@query(
    f"WITH {METRIC} SELECT source, count(x) AS n, round(avg(x), 2) AS mean, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.95), 4) AS p95, max(x) AS max FROM m GROUP BY source"
)
def a10_summary(spark, d):
    out = _metric(spark, d).groupBy("source").agg(*stats.summary("x"))
    return out.select("source", "n", F.round("mean", 2).alias("mean"), F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"), "max")


@query(
    """WITH p AS (SELECT event_type AS k, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY k)
SELECT round(max(p95), 6) AS p95, round(max(p95) * 1.2, 6) AS "full", round(max(p95) * 0.6, 6) AS half, round(max(p95) * 0.3, 6) AS quarter FROM p"""
)
def a12_calibration(spark, d):
    out = stats.calibration(table(spark, d, "events").select(F.col("event_type").alias("k"), "value"), "k", "value")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(
    """WITH r AS (SELECT l_orderkey AS k, l_quantity AS x, l_returnflag <> 'R' AS ok, l_linestatus AS ctx FROM lineitem)
SELECT k, CASE WHEN bool_and(ok) AND count(DISTINCT ctx) = 1 AND count(*) = 3 AND count(x) = 3 THEN round(avg(x), 6) END AS mean, count(*) AS n FROM r GROUP BY k"""
)
def a13_repeat_means(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_linestatus").alias("ctx"))
    return stats.repeat_mean(rows, ["k"], "x", "ok", "ctx", 3).select("k", F.round("mean", 6).alias("mean"), "n")


@query("SELECT user_id AS k, max(value) FILTER (event_type <> 'view') AS best, coalesce(max(value) FILTER (event_type <> 'view') > 1e-9, false) AS opportunity FROM events GROUP BY k")
def a14_best_extra(spark, d):
    return stats.best_extra(table(spark, d, "events").select(F.col("user_id").alias("k"), "value", (F.col("event_type") != "view").alias("ok")), ["k"], "value", "ok")


@query(
    """WITH x AS (SELECT p_brand AS g, p_size AS i, CAST(sum(p_partkey % 97) AS BIGINT) AS lo, CAST(sum(p_partkey % 89) AS BIGINT) AS hi FROM part GROUP BY ALL)
SELECT a.g, count(*) AS pairs, count(*) FILTER (sign(a.lo - b.lo) * sign(a.hi - b.hi) < 0) AS reversed FROM x a JOIN x b ON a.g = b.g AND a.i < b.i GROUP BY a.g"""
)
def a16_reversals(spark, d):
    x = table(spark, d, "part").groupBy(F.col("p_brand").alias("g"), F.col("p_size").alias("i")).agg(F.sum(F.col("p_partkey") % 97).alias("lo"), F.sum(F.col("p_partkey") % 89).alias("hi"))
    return stats.reversals(x, ["g"], "i", "lo", "hi", 0)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY status")
def a17_status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {METRIC}, u AS (SELECT source, graph, CAST(count(*) AS DOUBLE) AS x FROM m GROUP BY ALL), k AS (SELECT source, x, row_number() OVER (PARTITION BY source ORDER BY graph) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM u),
p AS (SELECT DISTINCT source, n FROM k), q AS (SELECT source, n, j, draw FROM p, (SELECT unnest(range(1, 101)) AS draw), LATERAL (SELECT unnest(range(1, n + 1)) AS j)),
s AS (SELECT draw, q.source, avg(k.x) AS mu FROM q JOIN k ON k.source = q.source AND k.i = ((draw * 7919 + j * 104729 + 1979) * 2654435761 % 4294967291) % q.n GROUP BY ALL)
SELECT CAST(draw AS INT) AS draw, round(avg(mu), 6) AS mean FROM s GROUP BY draw"""
)
def a18_bootstrap(spark, d):
    units = _metric(spark, d).groupBy("source", "graph").agg(F.count(F.lit(1)).cast("double").alias("x"))
    return stats.bootstrap(units, "source", "graph", "x", 100, 1979).select("draw", F.round("mean", 6).alias("mean"))


@query()
def a18_bootstrap_interval(spark, d):
    """Ten thousand draws over all graphs of all sources, with the 95 % interval."""
    units = _metric(spark, d).groupBy("source", "graph").agg(F.count(F.lit(1)).cast("double").alias("x"))
    return stats.bootstrap_interval(units, "source", "graph", "x")


@query("WITH s AS (SELECT c_nationkey AS source, quantile_cont(c_acctbal, 0.5) AS m FROM customer GROUP BY source) SELECT round(greatest(1.0::DOUBLE, quantile_cont(m, 0.5)), 4) AS scale FROM s")
def a26_median_scale(spark, d):
    s = table(spark, d, "customer").groupBy("c_nationkey").agg(F.percentile("c_acctbal", F.lit(0.5)).alias("m"))
    return s.agg(F.round(F.greatest(F.lit(1.0), F.percentile("m", F.lit(0.5))), 4).alias("scale"))


@query(f"WITH {_L} SELECT k, CASE WHEN count(DISTINCT f) = 3 THEN avg(x) END AS mean, CASE WHEN count(DISTINCT f) = 3 THEN min(x) END AS low, CASE WHEN count(DISTINCT f) = 3 THEN max(x) END AS high FROM l GROUP BY k")
def a25_seed_range(spark, d):
    return stats.seed_range(_supplier_flags(spark, d), ["k"], "f", "x", 3)


@query("SELECT o_custkey AS source, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY source HAVING count(DISTINCT o_orderstatus) > 1")
def a27_leakage(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.countDistinct("o_orderstatus").alias("splits")).where("splits > 1")


# Windows and admission ------------------------------------------------------------------------------------------------


@query(f"WITH {CONTACTS}, x AS (SELECT ant, s < max(e) OVER (PARTITION BY ant ORDER BY s, cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM c) SELECT ant, count(*) FILTER (hit) AS overlaps, count(*) AS n FROM x GROUP BY ant")
def w01_running_overlaps(spark, d):
    return windows.running_overlaps(contacts(spark, d), ["ant"])


@query(f"WITH {CONTACTS}, x AS (SELECT owner, cid, s - lag(e) OVER (PARTITION BY owner ORDER BY s, cid) AS gap FROM c) SELECT * FROM x WHERE gap < {OWNER_GAP}")
def w02_setup_check(spark, d):
    return windows.setup_violations(contacts(spark, d), "owner", OWNER_GAP)


@query(
    f"""WITH {RUNS}, x AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, id) AS n FROM r)
SELECT run, coalesce(max(value) FILTER (n <= 1), 0) AS top1, coalesce(max(value) FILTER (n <= 2), 0) AS top2, coalesce(max(value) FILTER (n <= 4), 0) AS top4 FROM x GROUP BY run"""
)
def w06_ranked_gain(spark, d):
    return windows.ranked_gain(_runs(spark, d), ["run"], [F.desc("value"), F.col("id")], "value", [1, 2, 4])


@query(
    """WITH r AS (SELECT l_suppkey AS state, l_orderkey AS action, l_linenumber AS cap, CAST(l_quantity AS BIGINT) AS idx, l_returnflag AS f FROM lineitem), s AS (SELECT DISTINCT state, action, cap, idx FROM r WHERE f = 'R'),
t AS (SELECT state, action, count(*) AS turns FROM s GROUP BY state, action),
x AS (SELECT r.state, r.action, r.cap, r.idx, coalesce(turns, 0) AS turns FROM r LEFT JOIN t USING (state, action) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.state = r.state AND s.action = r.action AND s.cap = r.cap AND s.idx = r.idx))
SELECT *, CAST(row_number() OVER (PARTITION BY state ORDER BY turns, action, cap, idx) AS INT) AS place FROM x"""
)
def w07_round_robin(spark, d):
    r = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("state"), F.col("l_orderkey").alias("action"), F.col("l_linenumber").alias("cap"), F.col("l_quantity").cast("long").alias("idx"), F.col("l_returnflag").alias("f")
    )
    return windows.round_robin(r.drop("f"), r.where("f = 'R'").drop("f").distinct())


@query("WITH x AS (SELECT user_id AS k, event_id AS id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events) SELECT k, id, value FROM x WHERE n = 1")
def w09_first_minimum(spark, d):
    return windows.first_minimum(table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), "value"), ["k"], "id", "value")


@query("WITH x AS (SELECT conv_id, turn, length(text) AS t, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, t FROM x WHERE t IS NULL OR p > t")
def t07_clock_guard(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("t"))
    return windows.backwards(rows, ["conv_id"], "turn", "t")


@query(
    f"""WITH {CONTACTS}, a AS (SELECT ant, s, e, row_number() OVER (PARTITION BY ant ORDER BY s, e) AS p FROM c), b AS (SELECT ant, s, e, row_number() OVER (PARTITION BY ant ORDER BY s, e) AS p FROM (SELECT ant, s + cid % 3 + CASE WHEN cid % 200 = 0 THEN 9000 ELSE 0 END AS s, e FROM c))
SELECT ant, count(a.s) AS n1, count(b.s) AS n2, max(greatest(abs(a.s - b.s), abs(a.e - b.e))) AS error, (count(a.s) = count(b.s) AND coalesce(max(greatest(abs(a.s - b.s), abs(a.e - b.e))), 0) <= 5000) AS agrees FROM a FULL JOIN b USING (ant, p) GROUP BY ant"""
)
def r07_positional(spark, d):
    c = contacts(spark, d)
    moved = c.select("ant", F.expr("s + cid % 3 + case when cid % 200 = 0 then 9000 else 0 end").alias("s"), "e")  # some beyond the tolerance
    return windows.positional_match(c.select("ant", "s", "e"), moved, ["ant"], 5000)


def _runs(spark, d):
    from conflux.sources.contacts import micros

    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), micros("ts").alias("t"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    return rows.withColumn("deadline", F.min("t").over(Window.partitionBy("run")) + 864_000_000_000)


@query(
    f"""WITH {RUNS} SELECT run, t, id, t < deadline AS on_time, CASE WHEN t < deadline THEN value ELSE 0.0 END AS counted,
max(CASE WHEN t < deadline THEN value END) OVER (PARTITION BY run ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM r"""
)
def t01_admitted(spark, d):
    return admission.admitted(_runs(spark, d)).select("run", "t", "id", "on_time", "counted", "best")


@query(
    f"""WITH {RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, t, id) AS n FROM r WHERE t < deadline)
SELECT r.run, greatest(coalesce(max(r.value) FILTER (r.t < r.deadline), 0), 0) AS delivered, count(*) FILTER (r.t < r.deadline) AS on_time, count(*) FILTER (r.t >= r.deadline) AS late, any_value(o.id) AS winner FROM r LEFT JOIN o ON o.run = r.run AND o.n = 1 GROUP BY r.run"""
)
def t02_final_incumbents(spark, d):
    return admission.final_incumbents(_runs(spark, d))


@query(f"""WITH {RUNS}, k AS (SELECT * FROM r WHERE t < deadline), a AS (SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY t DESC, id DESC) AS n FROM k), b AS (SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY t DESC, id DESC) AS n FROM k WHERE kind = 'view')
SELECT a.run, b.value AS prefix_value, a.value AS final_value FROM a LEFT JOIN b ON b.run = a.run AND b.n = 1 WHERE a.n = 1""")
def t06_prefix_split(spark, d):
    return admission.prefix_split(_runs(spark, d), "view")


def _afford(op: str) -> str:
    return f"""WITH r AS (SELECT l_orderkey AS action, l_linenumber AS cap, l_linestatus AS workpoint, l_quantity AS expected, l_quantity + l_linenumber AS amount, CASE WHEN l_tax > 0.04 THEN 'seconds' ELSE 'nodes' END AS kind, l_returnflag AS f FROM lineitem),
s AS (SELECT DISTINCT action, cap, workpoint FROM r WHERE f = 'R') SELECT action, cap, workpoint, expected FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.action = r.action AND s.cap = r.cap AND s.workpoint = r.workpoint) AND expected {op} 25 AND (kind <> 'seconds' OR amount {op} 25)"""


def _requests(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("action"), F.col("l_linenumber").alias("cap"), F.col("l_linestatus").alias("workpoint"), F.col("l_quantity").alias("expected"), (F.col("l_quantity") + F.col("l_linenumber")).alias("amount"),
        F.when(F.col("l_tax") > 0.04, "seconds").otherwise("nodes").alias("kind"), F.col("l_returnflag").alias("f"),
    )


@query(_afford("<="))
def f05_affordable(spark, d):
    r = _requests(spark, d)
    return admission.affordable(r, r.where("f = 'R'").select("action", "cap", "workpoint").distinct(), 25).select("action", "cap", "workpoint", "expected")


@query(_afford("<"))
def f06_affordable_strict(spark, d):
    r = _requests(spark, d)
    return admission.affordable(r, r.where("f = 'R'").select("action", "cap", "workpoint").distinct(), 25, strict=True).select("action", "cap", "workpoint", "expected")


@query(
    """WITH r AS (SELECT o_custkey AS run, o_orderkey AS idx, o_totalprice AS predicted, CAST(o_orderkey % 13 + 1 AS DOUBLE) AS cost FROM orders)
SELECT run, idx, CAST(row_number() OVER (PARTITION BY run ORDER BY greatest(0.0::DOUBLE, predicted - 100000.0) / cost DESC, greatest(0.0::DOUBLE, predicted) / cost DESC, idx) AS INT) AS turn FROM r"""
)
def f12_fixed_call_order(spark, d):
    return policy.fixed_call_order(_calls(spark, d), 100000.0).select("run", "idx", "turn")


def _calls(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("predicted"), (F.col("o_orderkey") % 13 + 1).cast("double").alias("cost"))


@query(
    """WITH r AS (SELECT o_custkey AS state, o_orderkey AS idx, o_totalprice AS predicted, CAST(o_orderkey % 101 AS DOUBLE) AS truth, CAST(o_orderkey % 13 + 1 AS DOUBLE) AS cost FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY greatest(predicted, 0.0) / cost DESC, idx) AS a, row_number() OVER (PARTITION BY state ORDER BY greatest(truth, 0.0) / cost DESC, idx) AS b FROM r)
SELECT state, max(truth) FILTER (a = 1) AS chosen, max(truth) FILTER (b = 1) AS oracle, max(truth) FILTER (b = 1) - max(truth) FILTER (a = 1) AS regret FROM p GROUP BY state"""
)
def l19_offline_regret(spark, d):
    return policy.offline_regret(_calls(spark, d).withColumnRenamed("run", "state").withColumn("truth", (F.col("idx") % 101).cast("double")))


@query(
    """WITH r AS (SELECT o_custkey AS state, o_orderkey AS idx, CAST(o_orderkey % 17 AS DOUBLE) AS predicted, greatest(CAST(o_orderkey % 101 AS DOUBLE) - 20.0::DOUBLE, 0.0::DOUBLE) AS wanted FROM orders),
p AS (SELECT a.state, CASE WHEN (a.predicted - b.predicted) * (a.wanted - b.wanted) > 0 THEN 1.0 WHEN a.predicted = b.predicted THEN 0.5 ELSE 0.0 END AS x FROM r a JOIN r b ON a.state = b.state AND a.idx < b.idx AND a.wanted <> b.wanted),
n AS (SELECT state, count(*) AS unequal_pairs, round(avg(x), 9) AS accuracy FROM p GROUP BY state)
SELECT state, coalesce(unequal_pairs, 0) AS unequal_pairs, accuracy FROM (SELECT DISTINCT state FROM r) LEFT JOIN n USING (state)"""
)
def l19_pair_accuracy(spark, d):
    rows = _calls(spark, d).select(F.col("run").alias("state"), (F.col("idx") % 17).cast("double").alias("predicted"), (F.col("idx") % 101).cast("double").alias("truth"))
    return policy.pair_accuracy(rows, F.lit(20.0)).withColumn("accuracy", F.round("accuracy", 9))


#: Layers with small whole weights, so that sums are exact.
OWN, EDGE, FACTOR, BIAS = [[1, 0, -1], [0, 2, 0], [1, 1, 1]], [[0, 1, 0], [1, -1, 0], [0, 0, 2]], [[1, 0, 0], [0, 0, 1], [-1, 1, 0]], [1, -2, 0]


def _linear_sql(matrix, h, k, bias=(0, 0, 0)):
    return " + ".join(f"{w} * {h}[{j + 1}]" for j, w in enumerate(matrix[k])) + f" + {bias[k]}"


def _mean_sql(h):
    return "[" + ", ".join(f"avg({h(k)})" for k in range(3)) + "]"


@query(
    f"""{GRAPH}, n AS MATERIALIZED (SELECT cid AS node, ant, [cid % 5, owner % 3, (w // 10000) % 7]::DOUBLE[] AS h FROM c), arcs AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
m AS (SELECT v AS node, {_mean_sql(lambda k: _linear_sql(EDGE, "h", k))} AS x FROM arcs JOIN n ON n.node = u GROUP BY v), g AS (SELECT ant, {_mean_sql(lambda k: f"h[{k + 1}]")} AS x FROM n GROUP BY ant),
f AS (SELECT node, h, m.x AS m, g.x AS g FROM n LEFT JOIN m USING (node) LEFT JOIN g USING (ant))
SELECT node, {", ".join(f"round(greatest(0.0::DOUBLE, {_linear_sql(OWN, 'h', k, BIAS)} + coalesce(m[{k + 1}], 0) + coalesce({_linear_sql(FACTOR, 'g', k)}, 0)), 6) AS h{k}" for k in range(3))} FROM f"""
)
def l07_message_round(spark, d):
    """A round over the conflict graph, with the antennas' cliques as factors."""
    g = Graph(spark, d)
    h = F.array(*(x.cast("double") for x in (F.col("cid") % 5, F.col("owner") % 3, F.expr("w div 10000") % 7)))
    nodes = g.c.select(F.col("cid").alias("node"), h.alias("h"))
    # messages are whole numbers, so their sums over neighbours can be counted
    sent = [F.get(vectors.linear(h, EDGE), F.lit(k)).cast("long") for k in range(len(EDGE))]
    bound = g.c.agg(F.count(F.lit(1)) * F.max(F.greatest(*(F.abs(x) for x in sent))), F.count_if(F.col("owner").isNull())).first()
    counted = g.distinct and not bound[1] and (bound[0] or 0) < 1 << 31
    near = conflict.neighbour_means(g.c, g.rule, sent).select(F.col("cid").alias("node"), F.col("means").alias("message")) if counted else None
    out = vectors.message_round(nodes, None if counted else g.adj, g.c.where("ant is not null").select(F.col("cid").alias("node"), F.col("ant").alias("factor")), OWN, EDGE, FACTOR, BIAS, near)
    return out.select("node", *(F.round(F.get("h", F.lit(k)), 6).alias(f"h{k}") for k in range(3)))


@query("SELECT l_orderkey AS k, l_linenumber AS i, l_extendedprice AS lower, greatest(0.0::DOUBLE, l_extendedprice + (l_extendedprice * 2 - l_extendedprice) * l_discount - l_quantity * 1000) AS score FROM lineitem")
def l09_residual(spark, d):
    """The bounded residual over rows with a lower and an upper bound and a fraction between them."""
    x = F.col("l_extendedprice")
    _, _, score = vectors.residual(-F.col("l_quantity") * 1000, x, x * 2, F.col("l_discount"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), x.alias("lower"), score.alias("score"))


@query(
    f"""WITH {RUNS}, last AS (SELECT run, arg_max(id % 100, struct_pack(t := t, id := id)) AS told FROM r WHERE kind = 'purchase' AND id % 3 = 0 GROUP BY run), seen AS (SELECT run, count(*) FILTER (kind = 'click') AS seen FROM r GROUP BY run)
SELECT run, coalesce(told, seen) AS calls, told IS NOT NULL AS known FROM seen LEFT JOIN last USING (run)"""
)
def r05_observed_calls(spark, d):
    """Clicks are requests; every third purchase finishes a log and tells its calls."""
    finished = (F.col("kind") == "purchase") & (F.col("id") % 3 == 0)
    kind = F.when(F.col("kind") == "click", "request_started").when(finished, "finished").otherwise("other")
    return admission.call_counts(_runs(spark, d).select("run", "t", "id", kind.alias("kind"), (F.col("id") % 100).alias("calls")))


@query(
    """WITH RECURSIVE r AS (SELECT o_custkey AS run, o_orderkey AS idx, o_totalprice AS predicted, CAST(o_orderkey % 13 + 1 AS DOUBLE) AS cost FROM orders),
c AS MATERIALIZED (SELECT run, idx, cost, row_number() OVER (PARTITION BY run ORDER BY greatest(0.0::DOUBLE, predicted - 100000.0) / cost DESC, greatest(0.0::DOUBLE, predicted) / cost DESC, idx) AS turn FROM r),
w(run, turn, lft, n, idx) AS (SELECT DISTINCT run, 0::BIGINT, 20.0::DOUBLE, 0, NULL::BIGINT FROM c
  UNION ALL SELECT c.run, c.turn, CASE WHEN lft >= cost AND n < 4 THEN lft - cost ELSE lft END, CASE WHEN lft >= cost AND n < 4 THEN n + 1 ELSE n END, CASE WHEN lft >= cost AND n < 4 THEN c.idx END FROM w JOIN c ON c.run = w.run AND c.turn = w.turn + 1),
z AS (SELECT run, min(lft) AS "left" FROM w GROUP BY run)
SELECT run, "left", CAST(n - 1 AS INT) AS place, idx FROM w JOIN z USING (run) WHERE idx IS NOT NULL"""
)
def t05_admission_quota(spark, d):
    ranked = policy.fixed_call_order(_calls(spark, d), 100000.0)
    return policy.admission_quota(ranked, 20.0, 4)


# Scalars --------------------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey AS k, CAST(round_even(p_retailprice * 10, 0) AS BIGINT) AS ticks, bit_count(CAST(p_size AS INT)) AS bits, regexp_extract(p_name || '-r12-R3-g0170', '(r[0-9]+)-(R[0-9]+)-g([0-9]+)$', 3) AS gap,
abs(p_size - 20) / greatest(1.0::DOUBLE, p_size, 20) AS distance, CASE WHEN p_size > 20 THEN 1 WHEN p_size < 20 THEN -1 ELSE 0 END AS sign FROM part"""
)
def x_scalars(spark, d):
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("k"), F.bround(F.col("p_retailprice") * 10, 0).cast("long").alias("ticks"), F.bit_count(F.col("p_size").cast("int")).cast("tinyint").alias("bits"),
        F.regexp_extract(F.concat("p_name", F.lit("-r12-R3-g0170")), r"(r[0-9]+)-(R[0-9]+)-g([0-9]+)$", 3).alias("gap"),
        X.relative_distance(F.col("p_size").cast("double"), F.lit(20.0)).alias("distance"), X.sign(F.col("p_size") - 20).alias("sign"),
    )


@query("SELECT o_orderkey AS k, sha256('{\"a\":' || o_orderkey::VARCHAR || ',\"s\":\"' || o_orderstatus || '\"}') AS sha FROM orders")
def x12_canonical_sha(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), X.canonical_sha({"s": F.col("o_orderstatus"), "a": F.col("o_orderkey")}).alias("sha"))


@query(
    """WITH o AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS flat FROM lineitem GROUP BY k), g AS (SELECT k, flat, [0, len(flat) // 2, len(flat)] AS p FROM o)
SELECT k, CAST(g AS INT) AS g, CAST(i AS INT) AS i, flat[p[g + 1] + i + 1] AS v FROM g, (SELECT unnest(range(0, 2)) AS g), LATERAL (SELECT unnest(range(0, p[g + 2] - p[g + 1])) AS i)"""
)
def s04_ragged(spark, d):
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    o = o.select("k", F.col("x.l_partkey").alias("flat"), F.array(F.lit(0), F.expr("cast(size(x) div 2 as int)"), F.size("x")).alias("ptr"))
    return decode_ragged(o, "flat", "ptr")


# Iterative and grouped ------------------------------------------------------------------------------------------------


@query()
def g01_greedy(spark, d):
    """The whole sequential greedy selection, in parallel rounds; tested against a scan."""
    g = Graph(spark, d)
    chosen = greedy.greedy_windows(g.c, g.rule) if g.distinct and g.forward else greedy.greedy(g.c, g.e)
    return chosen.join(g.c.select("cid", "w"), "cid")


@query()
def g01_greedy_by_degree(spark, d):
    g = Graph(spark, d)
    rows, key = g.c.join(g.degrees, "cid"), greedy.degree_key(0.5)
    chosen = greedy.greedy_windows(rows, g.rule, key) if g.distinct and g.forward else greedy.greedy(rows, g.e, key)
    return chosen.join(g.c.select("cid", "w"), "cid")


@query(
    f"""{GRAPH.replace("WITH", "WITH RECURSIVE", 1)}, both_ AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(cid, c) AS (SELECT cid, cid FROM c UNION SELECT b.v, r.c FROM r JOIN both_ b ON b.u = r.cid WHERE r.c < b.v)
SELECT cid, min(c) AS component FROM r GROUP BY cid"""
)
def g03_components(spark, d):
    g = Graph(spark, d)
    return greedy.components(g.c, conflict.linked(g.c, g.rule) if g.distinct and g.forward else g.e)


def _scopes(spark, d):
    """Whole scopes to be read once, and the rule by which their windows conflict; none where they come with their neighbours."""
    g = Graph(spark, d)
    if g.distinct:
        return g.found, g.rule
    return recover.scoped(g.weighed, g.e), None


@query()
def g02_greedy_recovery(spark, d):
    return recover.recovered_scopes(*_scopes(spark, d), lambda w, n: (recover.portfolio(w, n), False))


@query()
def g05_scope_bounds(spark, d):
    return recover.scope_bounds(*_scopes(spark, d))


@query()
def g08_branch_and_bound(spark, d):
    return recover.recovered_scopes(*_scopes(spark, d), lambda w, n: recover.branch_and_bound(w, n, 500))


@query()
def g10_local_search(spark, d):
    return recover.recovered_scopes(*_scopes(spark, d), lambda w, n: (recover.local_search(w, n, None), False))


@query()
def g13_parent_fusion(spark, d):
    def fused(w, n):
        a, b = (recover.sweep(sorted(w, key=k), n) for k in (lambda v: (-w[v], v), lambda v: (-v,)))
        return recover.fuse(w, n, a, b), False

    return recover.recovered_scopes(*_scopes(spark, d), fused)


@query()
def g16_elimination(spark, d):
    return recover.recovered_scopes(*_scopes(spark, d), lambda w, n: recover.eliminate(w, n, 10))
