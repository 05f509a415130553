"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other text, toxic or not, is unlabelled, and no label 0 is learned from.
With the class prior p, a classifier g and the logistic loss l, the risk is p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p *
E_pos[l(-g)]): the second part is what negatives alone would cost, and as it cannot be negative a step that would push it
below 0 goes back instead, or the classifier would learn the unlabelled rows by heart.

Features: each lower-cased run of letters and its prefixes of 3 to 5 bytes, present in a document or not, known by a 64-bit
hash.  Those of at least ``LEAST_SUPPORT`` positives (the ``CANDIDATES`` most frequent) are candidates, and the documents
that have them are counted over all texts not held out.  Candidates with a log-likelihood ratio of at least ``LEAST_G``
of which, by the prior, at least ``LEAST_SHARE`` of the documents that have them are toxic (``SELECTED`` at most) are the
inputs of ``MODELS`` linear classifiers in numpy, each trained on its own draw of the sample; g is their mean.

Bounds: ``POSITIVES`` confirmed documents and about ``UNLABELLED`` others (by hash of the id) give the rows for
training; the counts of features cover every document.  The driver gets the candidates' counts and the sample's selected
features, no text.

Defined cases: a null or empty text has no feature and scores as the model's bias says (below 0.5 unless most texts are
toxic); with several labels a document is confirmed only if all say 1; null labels and null ids confirm nothing; without
a positive every score is 0; repeated rows count as often as they come; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .tables import bounded

SLOTS = 22  # bits
PREFIXES = (3, 4, 5)
CANDIDATES, SELECTED = 1 << 16, 1024
LEAST_SUPPORT, LEAST_G, LEAST_SHARE = 3, 12.0, 0.7
POSITIVES, UNLABELLED = 4000, 12_000
MODELS, STEPS, RATE, DECAY = 3, 400, 0.05, 2e-4

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(texts: tc.Texts) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hashes of the word and its prefixes for every word, and the rows of each document."""
    w = tc.spans(texts, _LETTER[texts.data])
    span = tc.SpanHash(texts, tc.LOWER_CODES)
    size = w.end - w.start
    each = np.empty((len(size), 1 + len(PREFIXES)), dtype=np.uint64)
    each[:, 0] = tc.mix(span(w.start, w.end) ^ np.uint64(0x5BD1E995))
    for k, n in enumerate(PREFIXES, 1):
        each[:, k] = span(w.start, w.start + np.minimum(size, n))
    return each, list(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True))


class Vocabulary:
    """Numbers of known features.  Where two share a slot, the first stays and the other is unknown."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes.astype(np.uint64)
        self.slots = np.full(1 << SLOTS, -1, np.int32)
        self.slots[(self.hashes >> np.uint64(64 - SLOTS))[::-1]] = np.arange(len(hashes) - 1, -1, -1)

    def of(self, texts: tc.Texts) -> Iterator[np.ndarray]:
        """The distinct numbers in each document, rising."""
        each, rows = features(texts)
        place = self.slots[each >> np.uint64(64 - SLOTS)]
        if len(self.hashes):
            place[(place >= 0) & (self.hashes[place] != each)] = -1
        for lo, hi in rows:
            own = place[lo:hi]
            yield np.unique(own[own >= 0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Labels:
    """Confirmed ids (sorted, a sample of bounded size) and the share of toxic ones among labelled documents."""

    positive: np.ndarray
    prior: float


def confirmed(labels: DataFrame, bound: int = POSITIVES) -> Labels:
    each = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    each = each.agg(F.min(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"), F.max(F.col("toxic").isNotNull()).alias("told"))
    number = each.agg(F.count_if("toxic").alias("toxic"), F.count_if("told").alias("told")).first()
    rows = each.where("toxic").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()
    toxic, told = (number.toxic, number.told) if number else (0, 0)
    return Labels(np.array(sorted(r.doc_id for r in rows), dtype=np.int64), min(max(toxic / max(told, 1), 1e-4), 0.9))


def _training_rows(docs: DataFrame) -> DataFrame:
    return bounded(docs).where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _is_positive(ids: pa.Array, positive: np.ndarray) -> np.ndarray:
    return np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), positive) & ids.is_valid().to_numpy(zero_copy_only=False)


def candidates(docs: DataFrame, positive: np.ndarray, most: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the positives' features and how many positives have them, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array(_is_positive(batch.column(0), positive)))
            for _, _, texts in tc.chunks(rows.column(1)):
                each, own = features(texts)
                found, number = np.unique(np.concatenate([np.unique(each[lo:hi]) for lo, hi in own]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(number.astype(np.int64))], names=["feature", "toxic"])

    each = _training_rows(docs).mapInArrow(run, "feature long, toxic long").groupBy("feature").agg(F.sum("toxic").alias("toxic"))
    rows = each.where(F.col("toxic") >= LEAST_SUPPORT).orderBy(F.desc("toxic"), "feature").limit(most).toArrow()
    return rows.column("feature").to_numpy().view(np.uint64), rows.column("toxic").to_numpy().astype(np.float64)


def counted(docs: DataFrame, positive: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, int, int]:
    """How many of all documents have each candidate; and the number of positives and of documents."""
    n = len(vocabulary.hashes)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # 2^SLOTS ints, CANDIDATES hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros(n + 2, np.int64)
        for batch in batches:
            every[n] += int(_is_positive(batch.column(0), positive).sum())
            every[n + 1] += batch.num_rows
            for _, _, texts in tc.chunks(batch.column(1)):
                for own in shared.value.of(texts):
                    every[own] += 1
        seen = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(every[seen])], names=["number", "every"])

    rows = _training_rows(docs).mapInArrow(run, "number int, every long").groupBy("number").agg(F.sum("every").alias("every")).toArrow()
    every = np.zeros(n + 2)
    every[rows.column("number").to_numpy()] = rows.column("every").to_numpy()
    return every[:n], int(every[n]), int(every[n + 1])


def selected(toxic: np.ndarray, every: np.ndarray, n_toxic: int, n_every: int, prior: float) -> np.ndarray:
    """Numbers of the candidates that tell toxic documents from all, the most telling ``SELECTED`` of them."""
    expected = np.maximum(every, toxic) * n_toxic / max(n_every, 1)
    g = 2 * (toxic * np.log(toxic / expected) - (toxic - expected))
    # one that has lost its slot was never counted
    g = np.where((every > 0) & (toxic > expected) & (prior * toxic >= LEAST_SHARE * expected), g, 0)
    best = np.argsort(-g, kind="stable")[:SELECTED]
    return best[g[best] >= LEAST_G]


def _sample(docs: DataFrame, positive: np.ndarray, vocabulary: Vocabulary, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Presence of the selected features in the positives and in the sampled share of all texts not held out."""
    drawn = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("unlabelled")), F.lit(1 << 30)) < int(share * (1 << 30))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.append_column("toxic", pa.array(_is_positive(batch.column(0), positive)))
            rows = rows.filter(pc.or_(rows.column("toxic"), rows.column("drawn")))
            for lo, hi, texts in tc.chunks(rows.column("text")):
                own = [x.astype(np.int16).tobytes() for x in shared.value.of(texts)]
                yield pa.RecordBatch.from_arrays([*(rows.column(k).slice(lo, hi - lo) for k in ("doc_id", "toxic", "drawn")), pa.array(own, pa.binary())], names=["doc_id", "toxic", "drawn", "own"])

    rows = _training_rows(docs).withColumn("drawn", drawn).mapInArrow(run, "doc_id long, toxic boolean, drawn boolean, own binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "own").limit(POSITIVES + 2 * UNLABELLED).toArrow()
    present = np.zeros((rows.num_rows, len(vocabulary.hashes)), dtype=np.float32)
    for i, own in enumerate(rows.column("own").to_pylist()):
        present[i, np.frombuffer(own, np.int16)] = 1
    toxic, drawn = (rows.column(k).to_numpy() for k in ("toxic", "drawn"))
    return present[toxic], present[drawn]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk_gradients(g_pos: np.ndarray, g_unl: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the non-negative risk by the outputs for positives and unlabelled rows, and what negatives cost."""
    n_pos, n_unl = max(len(g_pos), 1), max(len(g_unl), 1)
    negatives = float(np.logaddexp(0, g_unl).sum() / n_unl - prior * np.logaddexp(0, g_pos).sum() / n_pos)
    by_pos, by_unl = -prior * _sigmoid(g_pos) / n_pos, _sigmoid(g_unl) / n_unl  # of the negatives' part
    if negatives < 0:
        return -by_pos, -by_unl, negatives
    return by_pos - prior * _sigmoid(-g_pos) / n_pos, by_unl, negatives


def train(pos: np.ndarray, unl: np.ndarray, prior: float, models: int = MODELS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias: the mean of linear classifiers, each by Adam on its own bootstrap draw."""
    weights, bias = np.zeros(pos.shape[1]), 0.0
    for seed in range(models):
        rnd = np.random.default_rng(seed)
        p, u = pos[rnd.integers(len(pos), size=len(pos))], unl[rnd.integers(len(unl), size=len(unl))]
        w = np.zeros(pos.shape[1] + 1)
        w[-1] = np.log(prior / (1 - prior))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            a, b, _ = risk_gradients(p @ w[:-1].astype(np.float32) + w[-1], u @ w[:-1].astype(np.float32) + w[-1], prior)
            grad = np.append(a.astype(np.float32) @ p + b.astype(np.float32) @ u + DECAY * w[:-1], a.sum() + b.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights + w[:-1] / models, bias + w[-1] / models
    return weights, float(bias)


@dataclass
class Model:
    """The selected features, their weights in units of 2^-20, and the bias; ``vocabulary`` is None where nothing was learned."""

    vocabulary: Vocabulary | None
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    nothing = Model(None, np.zeros(0, np.int64), 0.0)
    told = confirmed(labels, positives)
    if not len(told.positive):
        return nothing
    hashes, toxic = candidates(docs, told.positive)
    known = Vocabulary(hashes)
    every, n_toxic, n_every = counted(docs, told.positive, known)
    if not n_toxic:
        return nothing
    known = Vocabulary(hashes[selected(toxic, every, n_toxic, n_every, told.prior)])
    pos, unl = _sample(docs, told.positive, known, min(1.0, unlabelled / n_every))
    if not len(pos) or not len(unl):
        return nothing
    w, bias = train(pos, unl, told.prior)
    return Model(known, np.round(w * (1 << 20)).astype(np.int64), bias)


def scores(texts: tc.Texts, model: Model) -> np.ndarray:
    if model.vocabulary is None:
        return np.zeros(len(texts))
    total = np.array([int(model.weights[own].sum()) for own in model.vocabulary.of(texts)], dtype=np.float64)
    return _sigmoid(total / (1 << 20) + model.bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^SLOTS ints, SELECTED features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in tc.chunks(batch.column(2)):
                score = scores(texts, shared.value)
                predicted = pa.array((score >= 0.5).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score), predicted], names=["doc_id", "held_out", "score", "predicted"])

    rows = bounded(docs).select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
