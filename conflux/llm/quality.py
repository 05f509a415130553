"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus, beside base rules.

Two multinomials over hashed byte n-grams are compared: the *target* counts documents labelled good, the *raw* one
counts every document.  A document's score is the mean over its n-grams of log p_target - log p_raw (add-one smoothed),
so it does not depend on length, and it is kept if the score is at least a fixed threshold.  Byte n-grams are used, not
word n-grams: junk here differs in form (symbol runs, shouting, tables) while its words are mostly seen once.

Corpus counts cover every document.  The target is fitted on at most ``TRUSTED`` labelled documents (those of smallest
hash), so that their ids have a bounded size and no text is shuffled to meet its label; see the parameter ``trusted``.
Each task returns one row per n-gram bucket it saw, at most ``BUCKETS``; the summed table of ``BUCKETS`` rows is the
whole model that reaches the driver.

Defined cases: a null text is empty; a text without words fails the base rules; with no trusted label or no text at all
every score is 0; duplicated label rows are trusted only if all of them are good; a null doc_id is never trusted; extra
columns of the input are ignored by ``measured`` and kept by ``good_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .tables import bounded

BUCKETS = 1 << 16
NGRAM = 4
TRUSTED = 50_000
THRESHOLD = -0.25
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_STARTS_POINT = (np.arange(256) & 0xC0) != 0x80


def buckets_of(texts: tc.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram inside one document, and the bounds of each document's."""
    size = np.diff(texts.bounds)
    number = np.maximum(size - NGRAM + 1, 0)
    first = np.concatenate([[0], np.cumsum(number)])
    n = max(len(texts.data) - NGRAM + 1, 0)
    word = np.zeros(n, dtype=np.uint32)
    for k in range(NGRAM):
        word |= texts.data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    keep = np.ones(n, dtype=bool)
    for k in range(1, NGRAM):  # n-grams that would reach into the next document
        cut = texts.bounds[1:-1] - k
        cut = cut[(cut >= 0) & (cut < n)]
        keep[cut] = False
    word = word[keep]
    return ((word * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), first


def _counts(docs: DataFrame, trusted: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), trusted) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, texts in tc.chunks(batch.column(1)):
                grams, first = buckets_of(texts)
                raw += np.bincount(grams, minlength=BUCKETS)
                if good[lo:hi].any():
                    target += np.bincount(grams[np.repeat(good[lo:hi], np.diff(first))], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(target[seen]), pa.array(raw[seen])], names=["bucket", "target", "raw"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def trusted_ids(labels: DataFrame, bound: int = TRUSTED) -> np.ndarray:
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q")).where("q = 1")
    rows = good.select(F.col("doc_id").cast("long").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()
    return np.array(sorted(r.doc_id for r in rows), dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRUSTED) -> np.ndarray:
    """log p_target - log p_raw of every bucket (float64, ``BUCKETS`` values)."""
    trusted = trusted_ids(labels, bound)
    rows = _counts(docs, trusted).toArrow()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows.column("bucket").to_numpy()
    target[at], raw[at] = rows.column("target").to_numpy(), rows.column("raw").to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def base_measures(texts: tc.Texts) -> dict[str, np.ndarray]:
    w = tc.words(texts)
    counts, n = w.counts, len(texts)
    inside = tc.NON_SPACE[texts.data]
    span = tc.SpanHash(texts)

    ln = tc.lines(texts)
    held = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    full = held[ln.end] > held[ln.start]
    owner = ln.owner()[full]
    key = span(ln.start[full], ln.end[full])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    again = np.zeros(len(key), dtype=bool)
    again[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])

    h, at, first = tc.windows(span(w.start, w.end), w, WINDOW)
    key = tc.mix(h ^ np.repeat(tc.mix(np.arange(1, n + 1, dtype=np.uint64)), np.diff(first)))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(w.start) + 1, dtype=np.int64)
    if len(twice):
        spot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        hit = at[twice[spot] == key]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": tc.per_document(inside & _STARTS_POINT[texts.data], texts.bounds),
        "n_symbols": tc.per_document(_IS_SYMBOL[texts.data], texts.bounds),
        "n_dup_lines": np.bincount(owner[again], minlength=n).astype(np.int64),
        "n_repeat_words": tc.per_document(np.cumsum(covered[:-1]) > 0, w.first),
    }


def scores(texts: tc.Texts, model: np.ndarray) -> np.ndarray:
    grams, first = buckets_of(texts)
    total = np.concatenate([[0.0], np.cumsum(model[grams])])
    # n-gram by n-gram sums of one document must not depend on its neighbours in the batch
    exact = np.round(model * 2**40).astype(np.int64) if len(grams) else np.zeros(BUCKETS, np.int64)
    total = np.concatenate([[0], np.cumsum(exact[grams])])
    number = np.diff(first)
    return (total[first[1:]] - total[first[:-1]]) / 2.0**40 / np.maximum(number, 1)


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def judged(batch_text: pa.Array, model: np.ndarray, threshold: float) -> Iterator[tuple[int, int, list[pa.Array]]]:
    for lo, hi, texts in tc.chunks(batch_text):
        m = base_measures(texts)
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])
        score = scores(texts, model)
        yield lo, hi, [*(pa.array(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]


def measured(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """doc_id, the base measures, base_failed, llr and kept, for every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, trusted))  # BUCKETS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(x.split()[0] for x in RESULT.split(", "))]
        for batch in batches:
            for lo, hi, columns in judged(batch.column(1), model.value, threshold):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=names)

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + RESULT)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, trusted))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [columns[-1] for _, _, columns in judged(batch.column(at), model.value, threshold)]
            if kept:
                yield batch.filter(pa.concat_arrays(kept))

    return bounded(docs).mapInArrow(run, docs.schema)
