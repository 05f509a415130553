"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document's size is its number of words.  Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3, ...; together
they share 100 % of all words by weight, but no target exceeds three times its source's size, and the excess is shared
again by weight until none does.  That fixed point is found in closed form: sources sorted by cap / weight are filled
up to their caps from the smallest ratio on, and the first prefix whose remaining share fits decides.

Every document of a source is expected in rate = target / source size copies.  Its expected copies are prefix-summed
within the source, one random offset in [0, 1) is added, and the document is emitted once for each integer boundary
crossed.  Documents are summed in the order (cell, size, doc_id), where cells are hashed groups of about ``CELL``
documents: each cell runs through all sizes, which keeps the taken words near the target.

Equal rows are counted first, and only (size, doc_id, count) is ranked: a row repeated a million times is one row of its
cell.  Prefix sums over sources and over cells are taken in ranges (``_running``), so no task holds all of them.

Rates are whole multiples of 2^-30.  Whole copies and the fraction are kept apart and the running fraction is known
modulo one, so no number of documents overflows; reruns agree and no document has over three copies.

Defined cases: a null text has size 0; a source without words has target 0 and takes nothing; repeated rows are separate
documents (a tie between equal rows does not change the result); a null source is a source of its own, a null doc_id
sorts first; an empty table gives an empty result; extra columns are ignored by ``mixed`` and kept by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, stored

CELL = 2048
WEIGHTS = 3
CAP = 3
UNIT = 1 << 30
SEED = "mix"
SOURCES_BROADCAST = 100_000  # rows of the per-source table, about 100 bytes each
SALTS = 64
CHUNK = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _running(rows: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """``rows`` with prefix sums of columns (the row itself left out) in the given order.

    Rows are dealt by ranges of the order and summed in each; what precedes a range is the sum of the ranges before it,
    one row per partition.
    """
    named = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    ranged = rows.select("*", *named)
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = stored(ranged.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{k}") for k, c in sums.items()))
    summed = summed.join(F.broadcast(totals), "_range")  # one row per shuffle partition
    return summed.select(*rows.columns, *((F.col(f"_in_{k}") + F.col(f"_{k}")).cast("long").alias(k) for k in sums))


def targets(sizes: DataFrame) -> DataFrame:
    """source, n_docs, source_size, target, rate (in units of 2^-30), cells, shift and the number of documents of earlier sources; one row per source."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    # bytes of UTF-8 sort as code points
    per = per.select("*", F.lit(1).alias("one"), F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise("m").cast("binary"), F.coalesce(F.encode("source", "UTF-8"), F.lit("").cast("binary"))).alias("name"))
    per = _running(per, ["name"], place="one", earlier="n_docs").withColumn("weight", (1 + F.col("place") % WEIGHTS).cast("long"))
    # sources whose share is largest against their cap come first; source_size / weight as a fraction that compares exactly
    per = per.withColumn("ratio", (F.col("source_size").cast("decimal(30,0)") * 6 / F.col("weight")).cast("decimal(32,0)")).withColumn("cap", F.col("source_size") * CAP)
    per = stored(_running(per, ["ratio", "place"], full_words="cap", full_weight="weight", rank="one"), "sources")
    words, weight = (per.agg(F.sum("source_size"), F.sum("weight")).first() or (0, 0))[:2]
    words, weight = words or 0, weight or 0
    # does this source stay under its cap, if all before it are full?
    fits = (F.lit(words) - F.col("full_words")).cast("decimal(30,0)") * F.col("weight") <= F.col("cap").cast("decimal(30,0)") * (F.lit(weight) - F.col("full_weight"))
    level = per.where(fits).agg(F.min(F.struct("rank", "full_words", "full_weight")).alias("x")).first()["x"]
    if level is None:
        target = F.col("cap").cast("double")
    else:
        share = F.col("weight") * F.lit(float(words - level["full_words"])) / F.lit(float(weight - level["full_weight"]))
        target = F.when(F.col("rank") < level["rank"], F.col("cap").cast("double")).otherwise(share)
    per = per.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target))
    rate = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size") * UNIT))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), _source_key())), 1, 15), 16, 10).cast("long")
    return per.select(
        "source", "n_docs", "source_size", "target", F.least(rate.cast("long"), F.lit(CAP * UNIT)).alias("rate"),
        F.ceil(F.col("n_docs") / CELL).cast("long").alias("cells"), (offset % UNIT).alias("shift"), "earlier",
    )


def _spread() -> Column:
    return F.pmod(F.coalesce("doc_id", F.lit(0)).cast("long"), F.lit(1 << 31)) * 2654435761 % 4294967291


def _salted(per: DataFrame) -> DataFrame:
    return per.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _repeated(rows: DataFrame, n: str, place: str) -> DataFrame:
    """Every row ``n`` times (n > 0), numbered from 0; no array grows beyond CHUNK or n / CHUNK."""
    chunks = F.floor((F.col(n) - 1) / CHUNK).cast("long")
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks)))
    last = F.least(F.col(n), (F.col("_chunk") + 1) * CHUNK) - 1
    return rows.withColumn(place, F.explode(F.sequence(F.col("_chunk") * CHUNK, last))).drop("_chunk")


def _groups(docs: DataFrame, by: list[str]) -> DataFrame:
    """Groups of equal rows of ``docs`` (doc_id, source, size and ``by``): number of rows, whole copies of each, and how many have one more."""
    per = stored(targets(docs.select("source", "size")).withColumn("_key", _source_key()).drop("source"), "targets")
    # without a shuffle of the documents by source, which would put a hot one into one task
    small = per.select("_key", "cells")
    small = F.broadcast(small) if per.count() <= SOURCES_BROADCAST else _salted(small)
    docs = docs.withColumn("_key", _source_key()).withColumn("_salt", _spread() % SALTS).join(small, ["_key", "_salt"] if "_salt" in small.columns else "_key")
    docs = docs.withColumn("_cell", F.pmod(_spread(), F.col("cells")))
    groups = docs.groupBy("_key", "_cell", "size", "doc_id", *by).agg(F.count(F.lit(1)).alias("n"))
    counts = groups.groupBy("_key", "_cell").agg(F.sum("n").alias("_n"))
    # documents before a cell, in all sources and then in its own
    counts = _running(counts, ["_key", "_cell"], _earlier="_n")
    first = counts.groupBy("_key").agg(F.min("_earlier").alias("_first"))
    per = per.join(first, "_key").select("_key", "source_size", "target", "rate", "shift", "_first")
    per = F.broadcast(per) if "_salt" not in small.columns else per
    counts = counts.join(per, "_key").withColumn("_before", F.col("_earlier") - F.col("_first")).drop("_earlier", "_first", "_n")
    inside = Window.partitionBy("_key", "_cell").orderBy("size", "doc_id", *by).rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.withColumn("_place", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(counts, ["_key", "_cell"])
    part = F.col("rate") % UNIT
    reached = (F.col("shift") + (F.col("_place") + F.col("_before")) % UNIT * part) % UNIT
    return ranked.select(
        "doc_id", *by, "size", "source_size", "target", "n", F.shiftright("rate", 30).alias("whole"), F.shiftright(reached + F.col("n") * part, 30).alias("more")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (and copies) for every document."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"))
    sized = stored(sized, "sizes")
    rows = _repeated(_groups(sized, []), "n", "_i").withColumn("copies", F.col("whole") + (F.col("_i") < F.col("more")).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixture(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it is emitted, with the columns of ``docs``."""
    keys = [F.xxhash64(F.lit(i), *(F.col(f"`{c}`") for c in docs.columns)).alias(f"_h{i}") for i in (1, 2)]  # of the whole row
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"), *keys)
    sized = stored(sized, "sizes")
    emitted = _groups(sized, ["_h1", "_h2"]).withColumn("_emit", F.col("n") * F.col("whole") + F.col("more")).where("_emit > 0")
    emitted = stored(emitted.select("_h1", "_h2", "n", "_emit"), "emitted")
    dropped(sized)
    rows = docs.select(*keys, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    out = _repeated(rows.join(emitted.where("n = 1"), ["_h1", "_h2"]), "_emit", "_i").select("_row.*")
    if emitted.where("n > 1").limit(1).count():  # equal rows: one of them stands for all
        many = rows.join(emitted.where("n > 1"), ["_h1", "_h2"]).groupBy("_h1", "_h2").agg(F.first("_row").alias("_row"), F.first("_emit").alias("_emit"))
        out = out.unionByName(_repeated(many, "_emit", "_i").select("_row.*"))
    return out
