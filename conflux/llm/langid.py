"""Language ID of words in code-switched text by a linear-chain conditional random field.

The chain runs over all words of a text.  Runs of ``RUN`` consecutive words are worked on side by side: each run's product
of transition and score matrices carries the forward and backward messages over its borders, so the probabilities are
those of the whole text's chain.  A word's label scores are the sum of hashed feature weights: its byte trigrams
with word borders (n-gram), its first and last three bytes (affix), and itself (lexicon).  Transitions between labels
are learned with them.  Training maximises the conditional likelihood (AdaGrad on mini-batches) over sequences put
together from pieces of different documents, so that switches occur; a word's label is its document's language.

A document's language is the label with the largest sum of posterior probabilities over its words that have letters,
its score that label's mean probability.

The model is fitted on a bounded sample of labelled rows (parameters of ``fit``): at most ``per_lang`` documents of each
language and ``in_all`` together, those of smallest hash, of at most ``longest`` bytes each and ``size`` bytes in all.  Where a language has fewer
texts of that length, longer ones follow, each by a window of a quarter as many code points from its middle.  Training
takes ``runs`` runs of words put together from them.  Prediction sees the whole text and nothing else.

Defined cases: a null, empty or letterless text is ``und`` with score 0; with no labelled row every text with letters is
``und``; equal scores give the label that sorts first; repeated rows are predicted one by one, and rows that repeat a
doc_id and language teach once, by the text that sorts first; rows with a null doc_id teach nothing and are not held
out; an empty table gives an empty result; extra columns are ignored by ``predicted``, kept by ``known``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .tables import bounded

PER_LANG = 300
LONGEST = 20_000
IN_ALL = 30_000
SIZE = 32 << 20
RUN = 64
FEATURES = 1 << 16
PASSES, STEP, BATCH, DECAY = 3, 0.3, 128, 1e-6
TRAIN_RUNS = 6_000
SALTS = 64

_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (FEATURES, labels) float32
    transitions: np.ndarray  # (labels, labels)
    start: np.ndarray


def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    return ((x ^ np.uint32(salt)) * np.uint32(0x9E3779B1) ^ (x >> np.uint32(13)) * np.uint32(0x85EBCA77)) >> np.uint32(16)


class Emitter:
    """Features of the words of one run of documents."""

    def __init__(self, texts: tc.Texts, w: tc.Words):
        data = tc.LOWER[texts.data].astype(np.uint32)
        n = len(data)
        inside = np.zeros(n, dtype=bool)
        inside[:] = tc.NON_SPACE[texts.data]
        first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        first[w.start], last[w.end - 1] = True, True
        before, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        before[1:], after[:-1] = data[:-1], data[1:]
        before[first], after[last] = 32, 32
        self.grams = _spread(before | data << np.uint32(8) | after << np.uint32(16), 0x51).astype(np.int64)
        self.start, self.end = w.start, w.end
        length = w.end - w.start
        self.affix = []
        for k, sign in ((2, 0xA1), (3, 0xA2)):
            head, tail = np.zeros(len(length), np.uint32), np.zeros(len(length), np.uint32)
            for j in range(k):
                there = length > j
                head[there] |= data[w.start[there] + j] << np.uint32(8 * j)
                tail[there] |= data[w.end[there] - 1 - j] << np.uint32(8 * j)
            self.affix += [_spread(head, sign << 24).astype(np.int64), _spread(tail, sign + 8 << 24).astype(np.int64)]
        span = tc.SpanHash(texts, tc.LOWER_CODES)
        self.affix.append((span(w.start, w.end) >> np.uint64(48)).astype(np.int64))
        self.scale = 1.0 / np.sqrt(length + len(self.affix)).astype(np.float32)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(words, labels)"""
        out = np.zeros((len(self.start), weights.shape[1]), dtype=np.float32)
        for k in range(weights.shape[1]):
            column = np.ascontiguousarray(weights[:, k])
            total = np.concatenate([[0.0], np.cumsum(column[self.grams], dtype=np.float64)])
            one = total[self.end] - total[self.start]
            for f in self.affix:
                one += column[f]
            out[:, k] = one * self.scale
        return np.round(out, 3)  # a word's scores do not depend on what precedes it in the batch

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of chosen words, one after another: (position in ``which``, feature, value)."""
        length = (self.end - self.start)[which]
        owner = np.repeat(np.arange(len(which)), length)
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.start[which], length)
        owners, feats = [owner], [self.grams[at]]
        for f in self.affix:
            owners.append(np.arange(len(which)))
            feats.append(f[which])
        owner = np.concatenate(owners)
        return owner, np.concatenate(feats), self.scale[which][owner]


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (runs, time, labels) and expected transition counts, for runs sorted by falling length.

    ``enter`` are the weights of each run's first label in place of ``start``, ``leave`` those of what follows its last.
    """
    n, most, k = scores.shape
    lift = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions)
    alpha, beta = np.zeros_like(lift), np.ones_like(lift)
    if leave is not None:
        beta[np.arange(n), lengths - 1] = leave
    alpha[:, 0] = lift[:, 0] * (np.exp(start) if enter is None else enter)
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    here = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(most)]  # runs longer than t
    for t in range(1, most):
        m = here[t]
        a = (alpha[:m, t - 1] @ move) * lift[:m, t]
        alpha[:m, t] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(most - 2, -1, -1):
        m = here[t + 1]
        b = beta[:m, t + 1] * lift[:m, t + 1]
        back = b @ move.T
        scale = (alpha[:m, t] * back).sum(axis=1, keepdims=True)
        pairs += ((alpha[:m, t] / scale).T @ b) * move
        beta[:m, t] = back / back.sum(axis=1, keepdims=True)
    post = alpha * beta
    total = post.sum(axis=2, keepdims=True)
    return np.divide(post, total, out=np.zeros_like(post), where=total > 0), pairs


def _runs(w: tc.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, length, place in its text and text of every run, long runs first."""
    counts = w.counts
    number = -(-counts // RUN)
    place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    first = np.repeat(w.first[:-1], number) + place * RUN
    length = np.minimum(np.repeat(w.first[1:], number) - first, RUN)
    order = np.argsort(-length, kind="stable")
    return first[order], length[order], place[order], np.repeat(np.arange(len(counts)), number)[order]


def _messages(scores: np.ndarray, length: np.ndarray, place: np.ndarray, text: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each run from the words before it, and what it leaves to those after it, up to a factor."""
    n, most, k = scores.shape
    enter, leave = np.tile(np.exp(start), (n, 1)), np.ones((n, k))
    if not place.any():
        return enter, leave
    lift, move = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(transitions)
    through = np.tile(np.eye(k), (n, 1, 1))  # from the first label of a run to its last
    for t in range(1, most):
        m = int(np.searchsorted(-length, -t, side="left"))
        step = (through[:m].reshape(-1, k) @ move).reshape(m, k, k) * lift[:m, t, None, :]
        through[:m] = step / step.sum(axis=(1, 2), keepdims=True)
    order = np.lexsort((text, place))  # all first runs, all second runs and so on, each by text
    cuts = np.searchsorted(place[order], np.arange(int(place.max()) + 2))
    steps = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    before = [np.searchsorted(text[a], text[b]) for a, b in zip(steps[:-1], steps[1:], strict=True)]  # a run's predecessor
    for a, b, at in zip(steps[:-1], steps[1:], before, strict=True):
        left = a[at]
        out = np.einsum("ni,nij->nj", enter[left] * lift[left, 0], through[left]) @ move
        enter[b] = out / out.sum(axis=1, keepdims=True)
    for a, b, at in zip(reversed(steps[:-1]), reversed(steps[1:]), reversed(before), strict=True):
        back = (np.einsum("nij,nj->ni", through[b], leave[b]) * lift[b, 0]) @ move.T
        leave[a[at]] = back / back.sum(axis=1, keepdims=True)
    return enter, leave


def _padded(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = first[:, None] + np.arange(int(length.max()))[None, :]
    there = np.arange(int(length.max()))[None, :] < length[:, None]
    return np.where(there[:, :, None], values[np.minimum(at, len(values) - 1)], 0)


def word_posteriors(texts: tc.Texts, w: tc.Words, model: Model) -> np.ndarray:
    """(words, labels) probabilities by forward-backward over every text."""
    out = np.zeros((len(w.start), len(model.labels)))
    if not len(w.start):
        return out
    scores = Emitter(texts, w).scores(model.weights)
    first, length, place, text = _runs(w)
    padded = _padded(scores, first, length)
    post, _ = forward_backward(padded, length, model.transitions, model.start, *_messages(padded, length, place, text, model.transitions, model.start))
    there = np.arange(post.shape[1])[None, :] < length[:, None]
    out[(first[:, None] + np.arange(post.shape[1])[None, :])[there]] = post[there]
    return out


def train(samples: list[tuple[str, str]], seed: int = 7, number: int = TRAIN_RUNS) -> Model:
    """samples: (text, language)."""
    labels = sorted({lang for _, lang in samples})
    k = max(len(labels), 1)
    model = Model(labels, np.zeros((FEATURES, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if len(labels) < 2:
        return model
    rnd = np.random.default_rng(seed)
    _, _, texts = next(tc.chunks(pa.array([t for t, _ in samples], pa.large_string()), 1 << 40))
    w = tc.words(texts)
    code = {x: i for i, x in enumerate(labels)}
    truth = np.array([code[lang] for _, lang in samples])[w.owner()]
    emit = Emitter(texts, w)
    first, length, _, _ = _runs(w)
    by_label = [np.flatnonzero(truth[first] == i) for i in range(k)]
    by_label = [x for x in by_label if len(x)]
    runs = []
    for _ in range(number):  # one to three pieces, of any languages, in one sequence
        parts, left = [], RUN
        for piece in range(int(rnd.integers(1, 4))):
            pick = by_label[int(rnd.integers(len(by_label)))]
            r = pick[int(rnd.integers(len(pick)))]
            size = int(min(length[r], rnd.integers(1, left + 1)))
            at = first[r] + int(rnd.integers(length[r] - size + 1))
            parts.append(np.arange(at, at + size))
            left -= size
            if left <= 0:
                break
        runs.append(np.concatenate(parts))
    g_w, g_t = np.full((FEATURES, k), 1e-6), np.full((k, k), 1e-6)
    g_s = np.full(k, 1e-6)
    weights, transitions, start = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    for _ in range(PASSES):
        for lo in range(0, len(runs), BATCH):
            batch = sorted((runs[i] for i in range(lo, min(lo + BATCH, len(runs)))), key=len, reverse=True)
            lens = np.array([len(x) for x in batch])
            which = np.concatenate(batch)
            owner, feat, value = emit.rows(which)
            scores = np.stack([np.bincount(owner, weights=weights[feat, j] * value, minlength=len(which)) for j in range(k)], axis=1)
            begin = np.cumsum(lens) - lens
            post, pairs = forward_backward(_padded(scores, begin, lens), lens, transitions, start)
            there = np.arange(post.shape[1])[None, :] < lens[:, None]
            gold = np.zeros((len(which), k))
            gold[np.arange(len(which)), truth[which]] = 1
            delta = gold - post[there]
            seen = np.zeros((k, k))
            inner = np.ones(len(which), dtype=bool)
            inner[begin + lens - 1] = False
            np.add.at(seen, (truth[which][np.flatnonzero(inner)], truth[which][np.flatnonzero(inner) + 1]), 1)
            used, spot = np.unique(feat, return_inverse=True)
            grad = np.stack([np.bincount(spot, weights=delta[owner, j] * value, minlength=len(used)) for j in range(k)], axis=1) / len(batch)
            grad -= DECAY * weights[used]
            g_w[used] += grad**2
            weights[used] += STEP * grad / np.sqrt(g_w[used])
            grad = (seen - pairs) / len(batch) - 1e-4 * transitions
            g_t += grad**2
            transitions += STEP * grad / np.sqrt(g_t)
            grad = (gold[begin] - post[:, 0]).sum(axis=0) / len(batch)
            g_s += grad**2
            start += STEP * grad / np.sqrt(g_s)
    return Model(labels, weights.astype(np.float32), np.round(transitions, 6), np.round(start, 6))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, in_all: int = IN_ALL, longest: int = LONGEST, runs: int = TRAIN_RUNS, size: int = SIZE) -> Model:
    """Learns from text and lang of the rows that are not held out; collects at most ``in_all`` texts of ``longest`` bytes, ``size`` bytes together."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") > 0))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", (F.octet_length("text") > longest).alias("long"), F.least(F.octet_length("text"), F.lit(longest)).alias("size"))
    order = ["long", F.xxhash64("doc_id"), "doc_id"]
    each = usable.select("doc_id", "lang", "long", "size").groupBy("doc_id", "lang").agg(F.min("long").alias("long"), F.max("size").alias("size"))
    # ranked in shares of each language first, for one may have most of the rows
    each = each.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    each = each.withColumn("n", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("n") <= per_lang)
    each = each.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("n") <= per_lang)
    first = each.orderBy("n", "lang").limit(in_all).select("doc_id", "lang", "long", "size").collect()
    keys = [(r.doc_id, r.lang, r.long) for r, total in zip(first, accumulate(r.size for r in first), strict=True) if total <= size]
    if not keys:
        return train([], number=runs)
    chosen = docs.sparkSession.createDataFrame(keys, "doc_id long, lang string, long boolean")
    window = longest // 4  # a code point has at most four bytes
    middle = F.substring("text", F.greatest(F.lit(1), F.expr(f"(char_length(text) - {window}) div 2 + 1").cast("int")), F.lit(window))
    text = F.when(F.col("long"), middle).otherwise(F.col("text"))
    rows = usable.join(F.broadcast(chosen), ["doc_id", "lang", "long"], "left_semi").groupBy("doc_id", "lang").agg(F.min(text).alias("text")).collect()  # in_all rows
    return train([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang))], number=runs)


def _has_letters(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def labelled(column: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, label number or -1, score)"""
    for lo, hi, texts in tc.chunks(column):
        if not model.labels:
            yield lo, hi, np.full(hi - lo, -1), np.zeros(hi - lo)
            continue
        w = tc.words(texts)
        post = word_posteriors(texts, w, model)
        letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[texts.data] | (texts.data >= 128))])
        counts = (letters[w.end] > letters[w.start]).astype(np.float64)
        post *= counts[:, None]
        number = tc.per_document(counts, w.first)
        total = np.concatenate([np.zeros((1, post.shape[1]), np.int64), np.cumsum(np.round(post * 2**30).astype(np.int64), axis=0)])
        total = (total[w.first[1:]] - total[w.first[:-1]]) / 2.0**30
        best = total.argmax(axis=1)
        score = np.clip(total[np.arange(len(best)), best] / np.maximum(number, 1), 0, 1)
        plain = tc.per_document(_ASCII_LETTER[texts.data], texts.bounds) > 0
        for i in np.flatnonzero(~plain):
            plain[i] = _has_letters(texts.text(i))
        yield lo, hi, np.where(plain, best, -1), np.where(plain, score, 0.0)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows
    names = pa.array([*model.labels, "und"], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, label, score in labelled(batch.column(2), shared.value):
                lang = names.take(pa.array(np.where(label < 0, len(names) - 1, label)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lang, pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = bounded(docs).select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a score of at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [pa.array((label >= 0) & (score >= least)) for _, _, label, score in labelled(batch.column(at), shared.value)]
            if kept:
                yield batch.filter(pa.concat_arrays(kept))

    return bounded(docs).mapInArrow(run, docs.schema)
