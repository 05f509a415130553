"""Registered queries of proposals, requests, labels and features, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from conflux.functions import scalars as X
from conflux.operators import admission, conflict, pairs, requests, selection
from conflux.shared import stored
from conflux.sources.contacts import contacts, micros, table
from pyspark.sql import Window
from pyspark.sql import functions as F

from .queries import BLOCKED, CONTACTS, ELIGIBLE, POOL, RUNS, SELECTED, Graph, _runs, query

PAIRS = f"""{BLOCKED}, sh AS (SELECT x.cid AS a, y.cid AS z, sum(x.bw) AS shared FROM blk x JOIN blk y ON x.b = y.b AND x.cid < y.cid GROUP BY ALL),
duo AS (SELECT a, z AS b, CAST(shared - p.d - q.d AS BIGINT) AS gain FROM sh JOIN d p ON p.cid = a JOIN d q ON q.cid = z WHERE shared - p.d - q.d > 0 AND NOT EXISTS (SELECT 1 FROM e WHERE u = a AND v = z))"""

# Choices --------------------------------------------------------------------------------------------------------------


@query(
    f"""{BLOCKED}, ones AS (SELECT cid, w, owner, -d AS gain FROM d ORDER BY -d DESC, cid LIMIT 64),
both_ AS (SELECT x.cid AS a, y.cid AS b, x.w + y.w - coalesce((SELECT sum(bw) FROM (SELECT DISTINCT b AS bb, bw FROM blk WHERE blk.cid IN (x.cid, y.cid))), 0) AS gain FROM ones x JOIN ones y ON x.cid < y.cid AND x.owner <> y.owner
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE u = x.cid AND v = y.cid)),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY gain DESC, a, b) AS n FROM (SELECT cid AS a, NULL::BIGINT AS b, gain, 1 AS kind FROM ones UNION ALL SELECT a, b, gain, 2 FROM both_)),
k AS (SELECT a, b, CAST(gain AS BIGINT) AS gain FROM r ORDER BY CASE WHEN kind = 1 AND n <= 6 THEN 0 WHEN kind = 2 THEN 1 ELSE 2 END, n LIMIT 12)
SELECT CAST(row_number() OVER (ORDER BY gain DESC, a, b NULLS FIRST) AS INT) AS place, a, b, gain FROM k"""
)
def o06_action_pool(spark, d):
    g = Graph(spark, d)
    out = requests.proposals(g.c, g.e, g.blk, g.sel)
    return out.withColumn("gain", F.col("gain").cast("long"))


@query(
    f"""{PAIRS}, n AS (SELECT coalesce(sum(k * (k - 1) // 2), 0) AS pairs FROM (SELECT count(*) AS k FROM blk GROUP BY b)), heavy AS (SELECT coalesce(sum(w), 0) AS loose FROM (SELECT w FROM c WHERE cid IN (SELECT cid FROM outs) ORDER BY w DESC, cid LIMIT 2))
SELECT CASE WHEN pairs <= 1000000000 THEN (SELECT coalesce(max(gain), 0) FROM duo) END::BIGINT AS lower, CASE WHEN pairs <= 1000000000 THEN (SELECT coalesce(max(gain), 0) FROM duo) ELSE loose END::BIGINT AS upper, pairs <= 1000000000 AS complete FROM n, heavy"""
)
def g22_pair_bounds(spark, d):
    g = Graph(spark, d)
    return requests.pair_bounds(g.c, g.e, g.blk, g.sel, 1_000_000_000)[0]


@query(
    f"""{BLOCKED}, g AS (SELECT cid, w, owner, -d AS gain, row_number() OVER (ORDER BY -d DESC, cid) AS n, md5('5:' || cid::VARCHAR) AS h FROM d), rest AS (SELECT *, row_number() OVER (ORDER BY h, cid) AS m FROM g WHERE n > 32),
ones AS (SELECT cid, w, owner, gain FROM g WHERE n <= 32 UNION ALL SELECT cid, w, owner, gain FROM rest WHERE m <= 32),
both_ AS (SELECT x.cid AS a, y.cid AS b, x.w + y.w - coalesce((SELECT sum(bw) FROM (SELECT DISTINCT b AS bb, bw FROM blk WHERE blk.cid IN (x.cid, y.cid))), 0) AS gain FROM ones x JOIN ones y ON x.cid < y.cid AND x.owner <> y.owner
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE u = x.cid AND v = y.cid)),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY gain DESC, a, b) AS n, md5('5:' || a::VARCHAR || ',' || coalesce(b::VARCHAR, '')) AS h FROM (SELECT cid AS a, NULL::BIGINT AS b, gain, 1 AS kind FROM ones UNION ALL SELECT a, b, gain, 2 FROM both_)),
z AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n > 4, CASE WHEN n > 4 THEN h END, n) AS place FROM r)
SELECT CAST(kind AS INT) AS kind, CAST(place AS INT) AS place, a, b, CAST(gain AS BIGINT) AS gain FROM z WHERE place <= 8"""
)
def o07_diverse_pool(spark, d):
    g = Graph(spark, d)
    return requests.diverse_proposals(g.c, g.e, g.blk, g.sel, 5).withColumn("gain", F.col("gain").cast("long"))


@query(
    f"""{PAIRS}, k AS (SELECT b, count(*) AS k, count(*) * (count(*) - 1) // 2 AS pairs FROM blk GROUP BY b), g AS (SELECT *, pairs <= (SELECT avg(pairs) FROM k) AS complete FROM k),
best AS (SELECT x.b, max(shared - p.d - q.d) AS gain FROM blk x JOIN blk y ON x.b = y.b AND x.cid < y.cid JOIN sh ON sh.a = x.cid AND sh.z = y.cid JOIN d p ON p.cid = x.cid JOIN d q ON q.cid = y.cid
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE u = x.cid AND v = y.cid) GROUP BY x.b),
h AS (SELECT b, sum(w) AS loose FROM (SELECT b, w, row_number() OVER (PARTITION BY b ORDER BY w DESC, cid) AS n FROM blk JOIN c USING (cid)) WHERE n <= 2 GROUP BY b)
SELECT b, k, pairs, CASE WHEN complete THEN greatest(coalesce(gain, 0), 0) END::BIGINT AS lower, CASE WHEN complete THEN greatest(coalesce(gain, 0), 0) ELSE loose END::BIGINT AS upper, complete FROM g LEFT JOIN best USING (b) JOIN h USING (b)"""
)
def r02_guarded_pairs(spark, d):
    """Per blocker, under a limit taken from the data: the best pair of its list, or unknown with a loose bound."""
    g = Graph(spark, d)
    return pairs.guarded_pairs(g.c, g.e, g.blk, g.sel)


@query(
    f"""{PAIRS}, xs AS (SELECT p.cid AS a, q.cid AS b, CAST(-p.d - q.d AS BIGINT) AS gain FROM d p JOIN d q ON p.cid < q.cid AND p.d + q.d < 0
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE u = p.cid AND v = q.cid) AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.a = p.cid AND sh.z = q.cid)),
every AS (SELECT cid AS a, NULL::BIGINT AS b, CAST(-d AS BIGINT) AS gain FROM d WHERE d < 0 UNION ALL SELECT * FROM duo UNION ALL SELECT * FROM xs), best AS (SELECT * FROM every ORDER BY gain DESC, b IS NOT NULL, a, b LIMIT 1)
SELECT (SELECT count(*) FROM d WHERE d < 0) AS singles, (SELECT CAST(coalesce(sum(k * (k - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM blk GROUP BY b)) AS occurrences,
(SELECT count(*) FROM duo) AS shared_pairs, (SELECT count(*) FROM xs) AS apart_pairs, coalesce((SELECT gain FROM best), 0) AS lower, (SELECT a FROM best) AS a, (SELECT b FROM best) AS b, coalesce((SELECT gain FROM best), 0) AS upper, true AS complete"""
)
def r01_pair_audit(spark, d):
    """All changes by one or two outsiders, pairs without a shared blocker (J-11) included."""
    g = Graph(spark, d)
    return pairs.pair_audit(g.c, g.e, g.blk, g.sel)


@query(f"{PAIRS} SELECT a, b, gain FROM (SELECT cid AS a, NULL::BIGINT AS b, CAST(-d AS BIGINT) AS gain FROM d WHERE d < 0 UNION ALL SELECT * FROM duo) ORDER BY gain DESC, b IS NOT NULL, a, b LIMIT 1")
def o11_pair_witness(spark, d):
    g = Graph(spark, d)
    singles = pairs.deficits(g.c, g.blk, g.sel).select(F.col("cid").alias("a"), (-F.col("d")).cast("long").alias("gain"))
    two = pairs.two_hop_pairs(g.c, g.e, g.blk, g.sel)
    return requests.witness(singles, two.withColumn("gain", F.col("gain").cast("long")))


SKETCHES = f"""{PAIRS}, g AS MATERIALIZED (SELECT c.cid, count(adj.v) AS deg FROM c LEFT JOIN adj ON adj.u = c.cid GROUP BY c.cid),
mt AS (SELECT a, duo.b, x.b AS blocker, x.bw, count(*) AS h, min(x.cid) AS one FROM duo JOIN blk x ON x.cid IN (duo.a, duo.b) GROUP BY ALL),
ch AS (SELECT a, b, sum(CASE WHEN h = 2 OR one = a THEN bw // h ELSE 0 END) AS ca, sum(CASE WHEN h = 2 OR one = b THEN bw // h ELSE 0 END) AS cb, sum(CASE WHEN h = 2 THEN bw ELSE 0 END) AS credit, sum(1 + deg) AS work FROM mt JOIN g ON g.cid = blocker GROUP BY ALL),
sk AS (SELECT a, ch.b, CAST(greatest(0, -p.d, -q.d, credit - p.d - q.d) AS BIGINT) AS witness, CAST(greatest(0, p.w - ca) + greatest(0, q.w - cb) AS BIGINT) AS upper, CAST(credit AS BIGINT) AS credit, CAST(2 + x.deg + y.deg + work AS DOUBLE) AS work
  FROM ch JOIN d p ON p.cid = a JOIN d q ON q.cid = ch.b JOIN g x ON x.cid = a JOIN g y ON y.cid = ch.b),
sc AS (SELECT a, b, witness, upper, credit, (2.0::DOUBLE * witness::DOUBLE + 0.05::DOUBLE * upper::DOUBLE + 0.01::DOUBLE * credit::DOUBLE) / sqrt(work) AS score FROM sk)"""


def _sketches(g):
    two = pairs.two_hop_pairs(g.c, g.e, g.blk, g.sel)
    return requests.sketches(two, g.c, conflict.degrees(g.c, g.e), g.blk, g.sel)


@query(f"{SKETCHES} SELECT a, b, witness, upper, credit, round(score, 3) AS score FROM sc")
def g17_sketches(spark, d):
    """Charges, upper bound and witness of every pair that shares a blocker and pays."""
    return _sketches(Graph(spark, d)).withColumn("score", F.round("score", 3))


@query(f"{SKETCHES} SELECT a, b, witness, upper, CAST(row_number() OVER (ORDER BY score DESC, witness DESC, upper DESC, a, b) AS INT) AS place FROM sc ORDER BY score DESC, witness DESC, upper DESC, a, b LIMIT 50")
def o12_sketch_order(spark, d):
    """The fifty best sketches by (-score, -witness, -upper, ids): a top list."""
    best = _sketches(Graph(spark, d)).orderBy(F.desc("score"), F.desc("witness"), F.desc("upper"), "a", "b").limit(50)
    return best.select("a", "b", "witness", "upper", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("witness"), F.desc("upper"), "a", "b")).alias("place"))


@query(f"{BLOCKED}, sc AS (SELECT greatest(1.0::DOUBLE, sum(w)::DOUBLE / count(*)) AS scale FROM c) SELECT cid, w::DOUBLE / (scale + bw::DOUBLE) AS score FROM d, sc ORDER BY score DESC, cid LIMIT 128")
def o13_top_seeds(spark, d):
    """The 128 best seeds: a top list."""
    g = Graph(spark, d)
    return requests.seeds(g.c, g.blk, g.sel)


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS n FROM lineitem) SELECT l_orderkey AS k, l_linenumber AS place, l_quantity AS score FROM x WHERE n = 1")
def o10_comparator(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("place"), F.col("l_quantity").alias("score"))
    return requests.comparator(rows, ["k"], "score", "place")


@query(
    """WITH x AS (SELECT l_partkey AS case_id, l_orderkey AS graph, l_linenumber AS action, l_extendedprice AS gain, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT case_id, graph, action, gain FROM x WHERE n = 1"""
)
def o14_structural_cases(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("case_id"), F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("action"), F.col("l_extendedprice").alias("gain"))
    best = F.max_by(F.struct("graph", "action", "gain"), F.struct("gain", -F.col("graph"), -F.col("action")))
    return rows.groupBy("case_id").agg(best.alias("x")).select("case_id", "x.*")


# Requests and labels --------------------------------------------------------------------------------------------------

LABELS = """l AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_partkey AS state, l_suppkey % 4 AS domain, l_returnflag <> 'N' AS available, l_linestatus = 'F' AS launched, l_discount > 0.01 AS returned, l_quantity > 2 AS valid,
  l_partkey % 13 AS elapsed, 10 AS deadline, CAST(l_quantity AS DOUBLE) - 20 AS gain FROM lineitem)"""


def _labels(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_partkey").alias("state"), (F.col("l_suppkey") % 4).alias("domain"), (F.col("l_returnflag") != "N").alias("available"),
        (F.col("l_linestatus") == "F").alias("launched"), (F.col("l_discount") > 0.01).alias("returned"), (F.col("l_quantity") > 2).alias("valid"), (F.col("l_partkey") % 13).alias("elapsed"),
        F.lit(10).alias("deadline"), (F.col("l_quantity").cast("double") - 20).alias("gain"),
    )


@query(f"WITH {LABELS}, x AS (SELECT *, CASE WHEN state % 5 = 0 THEN 'nan'::DOUBLE WHEN state % 7 = 0 THEN NULL ELSE gain END AS g FROM l) SELECT key, coalesce(available AND valid AND isfinite(g), false) AS recorded FROM x")
def f03_recorded_labels(spark, d):
    g = F.when(F.col("state") % 5 == 0, F.lit(float("nan"))).when(F.col("state") % 7 == 0, F.lit(None)).otherwise(F.col("gain"))
    return _labels(spark, d).select("key", requests.recorded(F.col("available"), F.col("valid"), g).alias("recorded"))


@query(f"WITH {LABELS} SELECT key FROM l WHERE available AND valid AND gain > 1e-9 AND gain + 5 > 12 + 1e-9")
def f04_positive_witnesses(spark, d):
    ok = requests.recorded(F.col("available"), F.col("valid"), F.col("gain"))
    return _labels(spark, d).where(ok & (F.col("gain") > 1e-9) & (F.col("gain") + 5 > 12 + 1e-9)).select("key")


@query(f"WITH {LABELS} SELECT key, CASE WHEN gain > 1e-10 THEN gain ELSE 0.0 END AS gain FROM l")
def f13_clipped_gains(spark, d):
    return _labels(spark, d).select("key", requests.clipped(F.col("gain")).alias("gain"))


@query(f"WITH {RUNS} SELECT id, t <= deadline AS on_time FROM r")
def f09_inclusive(spark, d):
    return admission.admitted(_runs(spark, d), inclusive=True).select("id", "on_time")


@query(
    f"""WITH {LABELS}, x AS (SELECT *, available AND launched AS spent FROM l), y AS (SELECT *, spent AND returned AND valid AS ok FROM x), z AS (SELECT *, ok AND elapsed < deadline AS timely FROM y)
SELECT key, spent, ok AS membership_valid, ok AS raw_valid, timely AS on_time, CASE WHEN ok THEN greatest(gain, 0.0) ELSE 0.0 END AS returned_gain, CASE WHEN timely THEN greatest(gain, 0.0) ELSE 0.0 END AS accepted_gain,
CASE WHEN NOT available THEN 'unavailable' WHEN NOT spent THEN 'idle' WHEN NOT ok THEN 'failed' WHEN NOT timely THEN 'late' ELSE 'accepted' END AS status FROM z"""
)
def r16_execution_rows(spark, d):
    return requests.execution_rows(_labels(spark, d))


@query(f"WITH {LABELS} SELECT key, CASE WHEN available AND launched AND returned AND valid THEN 1.0 ELSE 0.0 END::DOUBLE AS validity, CASE WHEN available AND launched AND returned AND valid AND elapsed < deadline THEN greatest(gain, 0.0) ELSE 0.0 END::DOUBLE AS target FROM l")
def l17_execution_targets(spark, d):
    rows = requests.execution_rows(_labels(spark, d))
    return rows.select("key", F.col("membership_valid").cast("double").alias("validity"), F.col("accepted_gain").alias("target"))


@query(
    f"""WITH {LABELS}, v AS (SELECT domain, state, gain, count(*) AS c FROM l GROUP BY ALL), s AS (SELECT domain, state, sum(c) AS n, sum(c * c) AS same FROM v GROUP BY ALL),
o AS (SELECT domain, CAST(sum(n * n - same) AS BIGINT) AS unequal_pairs, count(*) FILTER (n * n > same) AS ranked_states FROM s GROUP BY domain)
SELECT domain, count(*) AS labels, count(gain) AS usable, count(*) FILTER (gain > 0) AS positive, sum(greatest(gain, 0.0) * 2) AS mass, any_value(unequal_pairs) AS unequal_pairs, any_value(ranked_states) AS ranked_states FROM l JOIN o USING (domain) GROUP BY domain"""
)
def r04_supervision(spark, d):
    return requests.supervision(_labels(spark, d).withColumn("weight", F.lit(2.0)), "domain", "state", "gain", "weight")


@query(
    f"""{POOL}, total AS (SELECT sum(w) AS x FROM c WHERE cid IN (SELECT cid FROM sel)), q AS (SELECT action, sum(x) AS q FROM (SELECT action, w AS x FROM act JOIN c USING (cid) UNION ALL SELECT action, -w FROM gone JOIN c USING (cid)) GROUP BY action),
t AS (SELECT action, w FROM pool WHERE pos = 1), best AS (SELECT greatest(max(q), 0) AS g FROM q)
SELECT action, CAST(q AS BIGINT) AS q, CAST(coalesce(w, 0) AS BIGINT) AS recovery, CAST(q + coalesce(w, 0) AS BIGINT) AS signed, CAST(greatest(0, q + coalesce(w, 0) - g) AS BIGINT) AS extra, true AS consistent FROM q LEFT JOIN t USING (action), best"""
)
def r11_request_rows(spark, d):
    """Requests that recover the heaviest eligible vertex of each scope."""
    g = Graph(spark, d)
    q = selection.immediate_gain(g.act, g.gone, g.c).select("action", F.col("gain").cast("long").alias("q"))
    # the heaviest one's weight is all that is needed of it, so eligible rows are summed up where they are found
    back = g.found.groupBy("action").agg(F.max("w").cast("long").alias("w"))
    back = stored(back, "back")
    total = g.c.join(g.sel, "cid", "left_semi").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("x")).first()["x"]
    # the value after, from the vertices that come and go
    come = g.act.select("action", "cid").distinct().join(g.c.select("cid", "w"), "cid").select("action", "w").union(back.select("action", "w")).groupBy("action").agg(F.sum("w").alias("plus"))
    go = g.gone.join(g.c.select("cid", "w"), "cid").groupBy("action").agg(F.sum("w").alias("minus"))
    scopes = q.join(come, "action").join(go, "action", "left").select("action", "q", F.lit(total).alias("original"), (F.lit(total) + F.col("plus") - F.coalesce("minus", F.lit(0))).alias("full"))
    known = q.agg(F.greatest(F.max("q"), F.lit(0)).alias("g")).first()["g"]
    return requests.request_rows(scopes, back, F.lit(known or 0))


@query("SELECT o_orderkey AS request, o_custkey AS action, c_nationkey AS scope FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def j14_scope_lookup(spark, d):
    scopes = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("action"), F.col("c_nationkey").alias("scope"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("action")).join(scopes, "action", "left").select("request", "action", "scope")


@query(
    """WITH b AS (SELECT o_custkey AS block, count(*) + CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS expected, bool_and(o_orderstatus <> 'P') AS complete FROM orders GROUP BY o_custkey)
SELECT o_orderkey AS k, o_custkey AS block FROM orders WHERE o_custkey IN (SELECT block FROM b JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) x ON x.o_custkey = block WHERE complete AND n = expected)"""
)
def r09_sealed_blocks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("block"), "o_orderstatus")
    n = F.count(F.lit(1)) + F.when(F.col("block") % 10 == 0, 1).otherwise(0)  # a summary that tells of a row too many
    blocks = o.groupBy("block").agg(n.alias("expected"), F.every(F.col("o_orderstatus") != "P").alias("complete"))
    return requests.sealed(blocks, o.select("k", "block"), "block").select("k", "block")


@query(
    """WITH x AS (SELECT c_mktsegment AS block, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) SELECT block, k, count(*) OVER (PARTITION BY block) AS n FROM x"""
)
def u07_block_union(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("block"), F.col("c_custkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("block"), F.col("s_suppkey").alias("k")))
    return rows.join(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block").select("block", "k", "n")


# Features -------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS k, sum(l_quantity) / greatest(count(*), 1) AS mean, sum(l_quantity * l_linenumber) / greatest(sum(l_linenumber), 1e-12) AS weighted FROM lineitem GROUP BY k")
def l08_pooled(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("w"))
    return requests.pooled(rows, ["k"], "x", "w")


@query(
    """WITH x AS (SELECT o_orderkey AS k, CAST(o_orderkey % 50 AS DOUBLE) - 1 AS lo, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS DOUBLE) - 1 - 1e-9 ELSE CAST(o_custkey % 60 AS DOUBLE) END AS hi FROM orders),
y AS (SELECT *, lo >= 0 AND lo <= hi + (1e-8 + 1e-10 * greatest(1.0, lo, hi)) AS valid FROM x) SELECT k, valid, CASE WHEN valid THEN greatest(lo, hi) END AS upper FROM y"""
)
def l10_interval_check(spark, d):
    lo = (F.col("o_orderkey") % 50).cast("double") - 1
    hi = F.when(F.col("o_orderkey") % 3 == 0, lo - 1e-9).otherwise((F.col("o_custkey") % 60).cast("double"))
    valid, upper = requests.checked_interval(lo, hi)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), valid.alias("valid"), upper.alias("upper"))


@query(f"WITH {CONTACTS} SELECT ant, greatest(1.0, sum(w)::DOUBLE / count(*)) AS scale FROM c GROUP BY ant")
def l11_scale(spark, d):
    return contacts(spark, d).groupBy("ant").agg(F.greatest(F.lit(1.0), F.sum("w").cast("double") / F.count(F.lit(1))).alias("scale"))


@query(
    """WITH x AS (SELECT o_orderkey AS request, (SELECT list(n ORDER BY n) FROM (SELECT unnest([o_custkey % 3, o_orderkey % 4]) AS n)) AS members, o_orderstatus AS warm FROM orders), u AS (SELECT members, warm, min(request) AS unit FROM x GROUP BY ALL)
SELECT request, unit FROM x JOIN u USING (members, warm)"""
)
def l12_units(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.array_sort(F.array(F.col("o_custkey") % 3, F.col("o_orderkey") % 4)).alias("members"), F.col("o_orderstatus").alias("warm"))
    return requests.units(rows, "request", "members", "warm")


@query(
    f"""{ELIGIBLE}, q AS (SELECT action, sum(x) AS q FROM (SELECT action, w AS x FROM act JOIN c USING (cid) UNION ALL SELECT action, -w FROM gone JOIN c USING (cid)) GROUP BY action), a AS (SELECT action, sum(w) AS x FROM elig JOIN c USING (cid) GROUP BY action)
SELECT action, CAST(q AS BIGINT) AS immediate, CAST(q + coalesce(x, 0) AS BIGINT) AS with_all FROM q LEFT JOIN a USING (action)"""
)
def r18_surrogates(spark, d):
    g = Graph(spark, d)
    out = requests.surrogates(g.found, selection.immediate_gain(g.act, g.gone, g.c))
    return out.select("action", F.col("immediate").cast("long").alias("immediate"), F.col("with_all").cast("long").alias("with_all"))


@query("SELECT l_orderkey AS segment, max(l_extendedprice) AS largest FROM lineitem GROUP BY segment")
def w05_segment_max(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("segment")).agg(F.max("l_extendedprice").alias("largest"))


@query(
    """WITH x AS (SELECT o_custkey AS state, o_orderkey % 5 AS regret, o_custkey % 4 AS weight, o_orderkey % 3 AS pr, o_orderkey % 2 * 4 AS pa FROM orders)
SELECT count(state) AS states, sum(regret * weight)::DOUBLE / sum(weight) AS regret, round(avg(CASE WHEN pa > 0 THEN pr / pa END), 9) AS accuracy, count(*) FILTER (pa > 0) AS ranked_states FROM x"""
)
def l20_split_evaluation(spark, d):
    n = lambda c: c.cast("double")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("state"), n(F.col("o_orderkey") % 5).alias("regret"), n(F.col("o_custkey") % 4).alias("weight"), n(F.col("o_orderkey") % 3).alias("pr"), n(F.col("o_orderkey") % 2 * 4).alias("pa")
    )
    return requests.evaluated(rows, "state", "regret", "weight", "pr", "pa").withColumn("accuracy", F.round("accuracy", 9))


@query(
    """WITH x AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, CAST(floor(l_quantity) AS BIGINT) // 8 AS w, (1 << CAST(l_partkey % 5 AS INT)) | (1 << CAST(l_suppkey % 5 AS INT)) AS mask FROM lineitem),
u AS (SELECT *, w - bit_count(mask) AS alone FROM x),
o AS (SELECT k, count(*) AS items, greatest(0, max(alone)) AS best_single, sum(greatest(0, alone)) AS additive, greatest(0, coalesce(sum(w) FILTER (alone > 0) - bit_count(bit_or(mask) FILTER (alone > 0)), 0)) AS additive_gain FROM u GROUP BY k),
t AS (SELECT a.k, max(a.w + b.w - bit_count(a.mask | b.mask)) AS two FROM u a JOIN u b ON a.k = b.k AND a.i < b.i GROUP BY a.k),
g AS (SELECT k, list(struct_pack(i := i, w := w, mask := mask) ORDER BY i) AS v FROM x GROUP BY k HAVING count(*) <= 12),
s AS (SELECT k, list_filter(v, lambda y: (m >> y.i) & 1 = 1) AS c FROM g, LATERAL (SELECT unnest(range(1, 1 << len(v))) AS m)),
y AS (SELECT k, len(c) AS size, list_sum(list_transform(c, lambda z: z.w))::BIGINT - bit_count(list_aggregate(list_transform(c, lambda z: z.mask::BIGINT), 'bit_or')) AS value FROM s),
e AS (SELECT k, greatest(0, max(value)) AS best_any, min(size) FILTER (value > 0) AS least FROM y GROUP BY k), z AS (SELECT o.*, greatest(best_single, coalesce(two, 0)) AS best_pair, best_any, least FROM o LEFT JOIN t USING (k) LEFT JOIN e USING (k))
SELECT k, items, best_single::BIGINT AS best_single, best_pair::BIGINT AS best_pair, additive::BIGINT AS additive, additive_gain::BIGINT AS additive_gain, best_any::BIGINT AS best_any,
CASE WHEN items <= 12 THEN least WHEN best_single > 0 THEN 1 WHEN best_pair > 0 THEN 2 END::INT AS least_paying, CASE WHEN items <= 12 THEN least WHEN best_single > 0 THEN 1 WHEN best_pair > 0 THEN 2 ELSE 3 END::INT AS least_lower FROM z"""
)
def r19_coalitions(spark, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long") - 1
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} % 5 as int))")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), place.alias("i"), F.expr("cast(floor(l_quantity) as bigint) div 8").alias("w"), bit("l_partkey").bitwiseOR(bit("l_suppkey")).alias("mask")
    )
    return requests.coalitions(rows, ["k"])


# State and hashes -----------------------------------------------------------------------------------------------------


@query(
    f"""WITH {RUNS}, x AS (SELECT *, max(value) OVER (PARTITION BY run ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r WHERE t < deadline) SELECT run, id, value FROM x WHERE best IS NULL OR value > best"""
)
def t04_warm_updates(spark, d):
    return requests.warm_updates(_runs(spark, d)).select("run", "id", "value")


@query(
    """WITH RECURSIVE v AS MATERIALIZED (SELECT user_id AS run, epoch_us(ts) AS t, event_id AS id, event_type = 'purchase' AS better, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS first FROM events),
s(run, n, improved, opened, spent, went, id) AS (SELECT DISTINCT run, 0::BIGINT, first, NULL::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM v
  UNION ALL SELECT x.run, x.n, CASE WHEN better THEN t ELSE improved END, CASE WHEN go THEN t ELSE opened END, CASE WHEN go THEN spent + 21600000000 ELSE spent END, CASE WHEN go THEN t END, CASE WHEN go THEN x.vid END
  FROM (SELECT v.run, v.n, v.t, v.id AS vid, v.better, s.improved, s.opened, s.spent, (NOT v.better AND v.t - v.first >= 86400000000 AND v.t - s.improved >= 43200000000 AND (s.opened IS NULL OR v.t - s.opened >= 172800000000)
    AND 0.2::DOUBLE * (v.t - v.first) - s.spent >= 21600000000) AS go FROM s JOIN v ON v.run = s.run AND v.n = s.n + 1) x)
SELECT run, went AS t, id FROM s WHERE id IS NOT NULL"""
)
def t08_gate(spark, d):
    hour = 3_600_000_000
    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), micros("ts").alias("t"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("better"))
    return requests.gated(rows, 24 * hour, 12 * hour, 48 * hour, 0.2, 6 * hour)


@query("SELECT l_orderkey AS k, sha256(unhex(string_agg(CASE WHEN i IN (SELECT l_linenumber - 1 FROM lineitem x WHERE x.l_orderkey = g.l_orderkey) THEN '01' ELSE '00' END, '' ORDER BY i))) AS sha FROM (SELECT DISTINCT l_orderkey FROM lineitem) g, range(8) r(i) GROUP BY k")
def x13_mask_sha(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).cast("long").alias("v"))
    return requests.mask_sha(rows, ["k"], "v", F.lit(8))


_LE = "regexp_replace(lpad(hex({x}::BIGINT), 16, '0'), '(..)(..)(..)(..)(..)(..)(..)(..)', '\\8\\7\\6\\5\\4\\3\\2\\1')"


#: The 64 bits of a positive double from its exponent g (put right where the logarithm was rounded) and its fraction.
_BITS = "((g + 1023) * 4503599627370496 + (((x / pow(2.0::DOUBLE, g)) - 1) * 4503599627370496)::BIGINT)"


@query(
    f"""WITH l AS (SELECT *, l_extendedprice::DOUBLE AS x, floor(log2(l_extendedprice::DOUBLE))::BIGINT AS h FROM lineitem), m AS (SELECT *, CASE WHEN x < pow(2.0::DOUBLE, h) THEN h - 1 WHEN x >= pow(2.0::DOUBLE, h + 1) THEN h + 1 ELSE h END AS g FROM l)
SELECT l_orderkey AS k, sha256(unhex(string_agg({_LE.format(x=_BITS)}, '' ORDER BY l_linenumber, l_partkey, l_suppkey) || string_agg({_LE.format(x='l_suppkey')}, '' ORDER BY l_linenumber, l_partkey, l_suppkey))) AS sha FROM m GROUP BY k"""
)
def x14_content_sha(spark, d):
    """Prices as doubles, then suppliers as longs."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return requests.content_sha(rows, ["k"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_extendedprice", "l_suppkey"])


@query(
    f"""WITH m AS (SELECT l_orderkey AS k, list(DISTINCT l_linenumber - 1) AS held FROM lineitem GROUP BY k),
h AS (SELECT k, len(held) AS n, list_reduce(list_prepend({requests.FNV_BASIS}::HUGEINT, list_transform(range(8), lambda i: list_contains(held, i)::INT::HUGEINT)), lambda h, b: (xor(h, b) * {requests.FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM m)
SELECT k, n, CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END::BIGINT AS signature FROM h"""
)
def x20_signature(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("v"))
    return requests.signature(rows, ["k"], "v", F.lit(8))


@query(
    """SELECT event_id AS k, epoch_us(ts) * 1000 AS ns, CAST(round_even(value * 100, 0) AS BIGINT) * 10000 AS tick, strftime(ts, '%d %b %Y %H:%M:%S') || '.000000' AS shown, CASE WHEN user_id < 9223372036854775807 // 100000 - 1 THEN user_id * 100000 + event_id % 1000 END AS code,
abs(value - round(value, 1)) <= 0.03 AS near, epoch_us(ts) + event_id % 2000 // 1000 + CASE WHEN event_id % 1000 > 500 OR (event_id % 1000 = 500 AND (epoch_us(ts) + event_id % 2000 // 1000) % 2 = 1) THEN 1 ELSE 0 END AS micros, round(0.5::DOUBLE * pow(10.0::DOUBLE, -(1 + event_id % 6)) + 1e-6::DOUBLE, 12) AS tolerance FROM events"""
)
def x_times(spark, d):
    """Scalars of times, codes and tolerances, through the functions that hold their rules."""
    rows = table(spark, d, "events")
    ns = X.seconds_to_ns((micros("ts").cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(38,9)"))
    cents = F.round(F.col("value") * 100, 0).cast("decimal(38,0)")
    shown = X.utcg(X.parse_utc(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return rows.select(
        F.col("event_id").alias("k"), ns.alias("ns"), X.ticks((cents / F.lit(100).cast("decimal(3,0)")).cast("decimal(30,9)")).alias("tick"), shown.alias("shown"),
        X.edge_code(F.col("user_id"), F.col("event_id") % 1000, F.lit(100_000)).alias("code"), X.is_close(F.col("value"), F.round("value", 1), 0.0, 0.03).alias("near"),
        X.half_even_micros((micros("ts") * 1000 + F.col("event_id") % 2000).cast("decimal(38,0)")).alias("micros"), F.round(X.fraction_tolerance(F.expr("concat('00:00:12.', left('123456', cast(1 + event_id % 6 as int)))")), 12).alias("tolerance"),
    )
