"""Scopes read one after the other from sorted rows, each with the conflicts of its own windows.

Rows are dealt by scope and sorted by Spark; a task holds one batch and the scope that it is in, and no conflict is shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Columns = dict[str, np.ndarray]

#: Pairs of windows that are looked at in one step, unless a scope alone has more.
STEP = 1 << 20


def _wholes(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[Columns]:
    """Columns of whole groups; the last group of a batch waits for the next one."""
    rest: Columns | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if rest is not None:
            now = {n: np.concatenate([rest[n], now[n]]) for n in now}
        cut = int(np.searchsorted(now[key], now[key][-1]))
        rest = {n: c[cut:] for n, c in now.items()}
        if cut:
            yield {n: c[:cut] for n, c in now.items()}
    if rest is not None:
        yield rest


def _steps(whole: Columns, key: str) -> Iterator[tuple[Columns, np.ndarray]]:
    """Runs of groups with up to ``STEP`` pairs, and the bounds of the groups in them."""
    ends = np.append(np.flatnonzero(whole[key][1:] != whole[key][:-1]) + 1, len(whole[key]))
    starts = np.append(0, ends[:-1])
    pairs = np.cumsum((ends - starts) * (ends - starts - 1) // 2)
    first = 0
    while first < len(ends):
        done = pairs[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(pairs, done + STEP, "right")))
        at, to = starts[first], ends[last - 1]
        yield {n: c[at:to] for n, c in whole.items()}, np.append(starts[first:last], to) - at
        first = last


def clashing(part: Columns, bounds: np.ndarray, rule: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two windows of each conflict inside a group, the earlier one first; rows are in the order of (s, cid).

    The windows of one resource that conflict with one and come later follow it in that order, so no other pair is made.
    """
    n = int(bounds[-1])
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = []
    for at, (r, gap) in enumerate(rule.items()):
        rows = np.flatnonzero(part[f"has_{r}"])
        rows = rows[np.lexsort((rows, part[r][rows], group[rows]))]
        own, where = part[r][rows], group[rows]
        run = np.cumsum(np.append(0, (own[1:] != own[:-1]) | (where[1:] != where[:-1]))) if len(rows) else rows
        times, until = part["s"][rows], part["e"][rows] + gap
        known = np.unique(times)
        line = run * (len(known) + 1) + np.searchsorted(known, times)
        last = np.searchsorted(line, run * (len(known) + 1) + np.searchsorted(known, until))
        number = np.maximum(last - np.arange(len(rows)) - 1, 0)
        first = np.repeat(np.arange(len(rows)), number)
        later = np.arange(len(first)) - np.repeat(np.cumsum(number) - number, number) + first + 1
        i, j = rows[first], rows[later]
        for q, other in list(rule.items())[:at]:  # made there
            new = ~((part[q][i] == part[q][j]) & part[f"has_{q}"][i] & part[f"has_{q}"][j] & (part["s"][j] < part["e"][i] + other))
            i, j = i[new], j[new]
        found.append(i * n + j)
    places = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    return places // max(n, 1), places % max(n, 1)


Told = Callable[[Columns, np.ndarray, np.ndarray, np.ndarray], list[tuple]]


def by_scope(rows: DataFrame, rule: dict[str, int], told: Told, schema: str, key: str = "action") -> DataFrame:
    """Rows that ``told`` makes of scopes (key, cid, s, e, the resources of ``rule``, ...), from columns, bounds of scopes and conflicts.

    Resources and owner come as 0 where they are null, with ``has_`` telling; other columns must not be null.  Ids must be distinct.
    """
    marked = dict.fromkeys((*rule, "owner")) if "owner" in rows.columns else rule
    plain = [c for c in rows.columns if c not in marked]
    rows = rows.select(*plain, *(F.coalesce(r, F.lit(0)).cast("long").alias(r) for r in marked), *(F.col(r).isNotNull().alias(f"has_{r}") for r in marked))
    out = rows.sparkSession.createDataFrame([], schema).schema

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for whole in _wholes(batches, key):
            for part, bounds in _steps(whole, key):
                found = told(part, bounds, *clashing(part, bounds, rule))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, "s", "cid").mapInArrow(stream, schema)


def window_conflicts(scope: DataFrame, vertices: DataFrame, rule: dict[str, int], key: str = "action") -> DataFrame:
    """``conflict.scope_conflicts`` of scopes (key, cid) that fit a task, u < v; each row once, shuffled once."""

    def told(part, bounds, i, j):
        cid, own = part["cid"], part[key][i].tolist()
        return list(zip(own, np.minimum(cid[i], cid[j]).tolist(), np.maximum(cid[i], cid[j]).tolist(), strict=True))

    rows = scope.select(key, "cid").join(vertices.select("cid", "s", "e", *rule), "cid")
    return by_scope(rows, rule, told, f"{key} {scope.schema[key].dataType.simpleString()}, u long, v long", key)


def graphs(part: Columns, bounds: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, dict[int, int], dict[int, set[int]]]]:
    """(first row, weight, near) of each scope."""
    cid = part["cid"].tolist()
    near: list[set[int]] = [set() for _ in cid]
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        near[x].add(cid[y])
        near[y].add(cid[x])
    weight = part["w"].tolist()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield a, dict(zip(cid[a:b], weight[a:b], strict=True)), dict(zip(cid[a:b], near[a:b], strict=True))


def bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def covers(part: Columns, bounds: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int, list[int], list[int], list[int]]]:
    """(first row, end, ids, weights, cliques) of each scope, by (-w, -degree, cid); a clique is the places of its members as bits.

    From each vertex with neighbours a clique takes, again and again, the best vertex adjacent to all its members; edges in none follow.
    """
    n, sizes = int(bounds[-1]), np.diff(bounds)
    degree = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    scope = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((part["cid"], -degree, -part["w"], scope))
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    near, start = [0] * n, bounds[:-1][scope]
    for x, y, base in zip(at[i].tolist(), at[j].tolist(), start[i].tolist(), strict=True):
        near[x] |= 1 << (y - base)
        near[y] |= 1 << (x - base)
    ids, weights = part["cid"][order].tolist(), part["w"][order].tolist()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        around = near[a:b]
        found = set()
        for seed, open_ in enumerate(around):
            if open_:
                clique = 1 << seed
                while open_:
                    low = open_ & -open_
                    clique |= low
                    open_ &= around[low.bit_length() - 1]
                found.add(clique)
        held = [0] * (b - a)
        for clique in found:
            for x in bits(clique):
                held[x] |= clique
        loose = [1 << x | 1 << y for x, own in enumerate(around) for y in bits(own & ~held[x]) if x < y]
        yield a, b, ids[a:b], weights[a:b], [*found, *loose]
