"""Rounds of message passing over vectors held as arrays, and the bounded residual that reads them out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = list[list[float]]


def linear(h: Column, matrix: Matrix, bias: list[float] | None = None) -> Column:
    """matrix * h + bias, of arrays as long as the matrix is wide."""
    rows = [reduce(Column.__add__, [F.lit(float(w)) * F.get(h, F.lit(j)) for j, w in enumerate(row)]) for row in matrix]
    return F.array(*(r + F.lit(float(b)) for r, b in zip(rows, bias or [0.0] * len(rows), strict=True)))


def means(rows: DataFrame, key: str, h: str, width: int, name: str) -> DataFrame:
    """(key, name): the mean vector of each key, summed index by index and so combined before it is shuffled."""
    return rows.groupBy(key).agg(F.array(*(F.avg(F.get(F.col(h), F.lit(i))) for i in range(width))).alias(name))


def message_round(
    nodes: DataFrame, arcs: DataFrame | None, incidence: DataFrame, own: Matrix, edge: Matrix, factor: Matrix, bias: list[float] | None = None, near: DataFrame | None = None
) -> DataFrame:
    """(node, h) after a round: relu of own * h + bias, the mean of edge * h over neighbours and of factor * g over factors.

    ``arcs`` (u, v) are both directions of every edge, ``incidence`` (node, factor) the members of cliques or other
    factors, g the mean of h over a factor's members.  A node without neighbours or factors gets zeros from there.
    ``near`` (node, message) has the means over neighbours where they are known without arcs.
    """
    width = len(own)
    zero = F.array(*(F.lit(0.0) for _ in range(width)))
    if near is None:
        sent = arcs.select(F.col("u").alias("node"), F.col("v").alias("to")).join(nodes, "node").select("to", linear(F.col("h"), edge).alias("h"))
        near = means(sent, "to", "h", width, "message").withColumnRenamed("to", "node")
    pooled = means(incidence.join(nodes, "node").select("factor", "h"), "factor", "h", len(factor[0]), "g")
    relayed = incidence.join(pooled, "factor").select("node", linear(F.col("g"), factor).alias("h"))
    relay = means(relayed, "node", "h", width, "relay")
    rows = nodes.join(near, "node", "left").join(relay, "node", "left")
    total = F.zip_with(linear(F.col("h"), own, bias), F.coalesce("message", zero), lambda a, b: a + b)
    total = F.zip_with(total, F.coalesce("relay", zero), lambda a, b: F.greatest(F.lit(0.0), a + b))
    return rows.select("node", total.alias("h"))


def residual(immediate: Column, lower: Column, upper: Column, fraction: Column) -> tuple[Column, Column, Column]:
    """(recovery, raw, score): lower plus a fraction of the gap, with the immediate gain, and not below 0."""
    recovery = lower + (upper - lower) * fraction
    raw = immediate + recovery
    return recovery, raw, F.greatest(F.lit(0.0), raw)
