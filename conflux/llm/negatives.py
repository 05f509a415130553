"""Hard negatives by distributed radix selection over integer scores.

A row's score is its integer inner product with an anchor.  A *window* is an anchor with a range of scores, and asks for
its k best rows (highest score, then smallest vec_id): first one window per anchor over the rows of its own label, which
finds its positives; then one per anchor and positive over the rows of other labels, between two shares of the positive's
score.

Selection never ranks a window's rows.  A pass over all rows counts the scores of each window in 2^DIGIT buckets; running
sums from the top locate the bucket of the kth score; the next pass looks into that bucket alone, digit by digit, until it
is one score.  The last pass gathers what lies above it, k rows less what is left to take at that score itself, where each
task hands on only the smallest ids that could be taken.  A task counts no more of a window than its own best rows that
could still be asked for: the kth score of all rows is never below that of some, so the located bucket is the same.

All windows are a table in the shared folder; tasks hold a block of rows and read windows in batches, so neither grows
with the other, and the rows are never shuffled or copied.  Scores are matrix products of exact whole numbers: in single
precision while no sum can pass 2^24, in double precision below 2^53, else in Python's integers.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component take no part; vectors of
another length than the anchor's are no rows of its windows; an anchor id that comes repeatedly is one anchor (of the
smallest label, then vector), while repeated rows are found as often as they come, and rows with the anchor's own id never;
components and scores beyond 2^61 count as that; a negative positive score leaves no room for negatives; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, parquet_batches, stored

SCALE = 256
DIGIT = 9
ROWS, WINDOWS = 32_768, 128  # of a block of scores
EDGE = 1 << 61
POSITIVES, NEGATIVES = 5, 10

_HELD = ["anchor_id", "w", "label", "vec", "top", "lo", "hi", "need", "shift"]


def whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * x.astype(np.float64)), -EDGE, EDGE)


def matrices(ids: pa.Array, labels: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, whole components) of the usable rows, by length of the vector."""
    usable = pc.and_(pc.and_(ids.is_valid(), labels.is_valid()), vectors.is_valid())
    ids, labels, vectors = (x.filter(usable) for x in (ids, labels, vectors))
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        own = pa.array(size == n)
        x = vectors.filter(own).flatten().to_numpy(zero_copy_only=False).reshape(int((size == n).sum()), n)  # null becomes NaN
        good = np.isfinite(x).all(axis=1)
        yield ids.filter(own).to_numpy()[good], labels.filter(own).to_numpy()[good], whole(x[good])


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole rows whose squares sum to at most ``most``, and so bound every sum on the way."""
    if most < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 1 << 53:
        return a @ b.T
    big = np.array([[int(x) for x in row] for row in a], dtype=object).reshape(a.shape)
    return np.clip(big @ np.array([[int(x) for x in row] for row in b], dtype=object).reshape(b.shape).T, -EDGE, EDGE).astype(np.int64) if a.shape[1] else a @ b.T


def _scored(rows: DataFrame, windows: DataFrame, same: bool, most: float, found: Callable[..., tuple[np.ndarray, np.ndarray]], names: list[str]) -> DataFrame:
    """(anchor_id, w, two numbers that ``found`` gives for a window) over blocks of rows and batches of windows."""
    files, most_rows, most_windows = windows.inputFiles(), ROWS, WINDOWS

    def answers(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in parquet_batches(files, most_windows, _HELD):
            own = batch.filter(pc.equal(pc.list_value_length(batch.column("vec")), x.shape[1]))
            if not own.num_rows:
                continue
            anchors, label, w, *window = (own.column(k).to_numpy() for k in ("anchor_id", "label", "w", "top", "lo", "hi", "need", "shift"))
            once, first, spot = np.unique(anchors, return_index=True, return_inverse=True)
            scores = products(own.column("vec").flatten().to_numpy().reshape(own.num_rows, x.shape[1])[first], x, most)
            fits = [((labels == label[i]) == same) & (ids != anchors[i]) for i in first.tolist()]
            out = [found(scores[i], fits[i], ids, *numbers) for i, *numbers in zip(spot.tolist(), *(c.tolist() for c in window), strict=True)]
            number = [len(a) for a, _ in out]
            if sum(number):
                columns = [np.repeat(anchors, number), np.repeat(w, number), np.concatenate([a for a, _ in out]).astype(np.int64), np.concatenate([b for _, b in out]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "w", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def block(n: int) -> Iterator[pa.RecordBatch]:
            yield from answers(*(np.concatenate(c) for c in zip(*held.pop(n), strict=True)))

        for batch in batches:
            for part in matrices(*batch.columns):
                n = part[2].shape[1]
                held.setdefault(n, []).append(part)
                if sum(len(p[0]) for p in held[n]) >= most_rows:
                    yield from block(n)
        for n in sorted(held):
            yield from block(n)

    return rows.mapInArrow(run, f"anchor_id long, w int, {names[0]} long, {names[1]} long")


def _counted(s: np.ndarray, fits: np.ndarray, ids: np.ndarray, top: int, lo: int, hi: int, need: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    if lo == hi:  # settled
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = s[(s >= lo) & (s <= hi) & fits]
    if len(own) > need:
        own = np.partition(own, len(own) - need)[len(own) - need :]
    return np.unique((own.astype(np.int64) - lo) >> shift, return_counts=True)


def _gathered(s: np.ndarray, fits: np.ndarray, ids: np.ndarray, top: int, lo: int, hi: int, need: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    above = np.flatnonzero((s > lo) & (s <= top) & fits)
    ties = np.flatnonzero((s == lo) & fits)
    if len(ties) > need:
        ties = ties[np.argpartition(ids[ties], need - 1)[:need]]
    own = np.concatenate([above, ties])
    return ids[own], s[own]


def _windows(df: DataFrame) -> DataFrame:
    """Stores windows with the shift that leaves ``DIGIT`` bits of their range."""
    wide = F.col("hi") - F.col("lo")
    df = df.withColumn("shift", F.greatest(F.lit(0), F.length(F.bin(wide)) - DIGIT))
    return stored(df.select(*_HELD).sortWithinPartitions("anchor_id", "w"), "windows")


def selected(rows: DataFrame, windows: DataFrame, same: bool, most: float, k: int) -> DataFrame:
    """The k best rows of each window (anchor_id, w, label, vec, lo, hi): anchor_id, w, vec_id, score and rank."""
    windows = _windows(windows.withColumns({"top": F.col("hi"), "need": F.lit(k)}))
    while (windows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0) > 0:
        counts = _scored(rows, windows, same, most, _counted, ["bucket", "n"]).groupBy("anchor_id", "w", "bucket").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("anchor_id", "w").orderBy(F.desc("bucket"))
        counts = counts.withColumn("above", F.sum("n").over(down) - F.col("n")).join(windows.select("anchor_id", "w", "need"), ["anchor_id", "w"])
        there = counts.where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))).select("anchor_id", "w", "bucket", "above")
        both = windows.join(there, ["anchor_id", "w"], "left").withColumn("from", F.expr("lo + shiftleft(bucket, shift)"))
        both = both.withColumns({
            # fewer rows than asked for: all of them, from the lowest score on
            "hi": F.when(F.col("bucket").isNull(), F.col("lo")).otherwise(F.least(F.col("hi"), F.expr("from + shiftleft(1L, shift) - 1"))),
            "lo": F.coalesce("from", "lo"),
            "need": F.col("need") - F.coalesce("above", F.lit(0)).cast("int"),
        })
        before, windows = windows, _windows(both)
        dropped(before)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id"))
    return _scored(rows, windows, same, most, _gathered, ["vec_id", "score"]).withColumn("rank", rank).where(F.col("rank") <= k)


def _largest(rows: DataFrame) -> float:
    """The largest sum of a row's squares; by Cauchy and Schwarz no score is beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            for _, _, x in matrices(*batch.columns):
                most = max(most, float((x * x).sum(axis=1).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    return rows.mapInArrow(run, "most double").agg(F.max("most")).first()[0] or 0.0


def relabelled(rows: DataFrame) -> DataFrame:
    """vec_id, label and embedding; every seventh id gets the next of ten labels."""
    label = F.col("label").cast("long")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")


def mined(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of the rows where ``anchors``: anchor_id, positive_id, rank, negative_id and both scores."""
    rows = rows.select("vec_id", "label", "embedding")
    most = _largest(rows)
    edge = int(min(most, EDGE)) + 1
    usable = F.col("label").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    asking = rows.where(anchors & usable).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "embedding")).alias("x"))
    scaled = F.transform(F.col("x.embedding").cast("array<double>"), lambda x: F.greatest(F.least(F.floor(x * SCALE).cast("double"), F.lit(float(EDGE))), F.lit(-float(EDGE))))
    asking = stored(asking.select("anchor_id", F.col("x.label").alias("label"), scaled.alias("vec")), "anchors")
    first = asking.withColumns({"w": F.lit(0), "lo": F.lit(-edge), "hi": F.lit(edge)})
    near = stored(selected(rows, first, True, most, positives).select("anchor_id", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    # 3 / 10 and 9 / 10 of the score, rounded inwards
    low, high = F.expr("positive_score div 10 * 3 + (positive_score % 10 * 3 + 9) div 10"), F.expr("positive_score - (positive_score + 9) div 10")
    second = near.where(p >= 0).join(asking, "anchor_id").withColumns({"lo": low, "hi": high}).where("lo <= hi")
    far = selected(rows, second, False, most, negatives)
    return far.join(near, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
