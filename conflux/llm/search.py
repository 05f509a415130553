"""Exact top-k search: BM25 over an inverted index with block-max WAND dynamic pruning, per shard, merged exactly.

Global statistics (number of documents, mean length, document frequency of each term) are aggregated first, so every
shard scores with the same weights and the union of the shards' top k holds the global top k.

A shard is some documents of one task.  Its index is built once and asked all queries; it holds for every term its
postings and largest BM25 contribution.  Documents are numbered in blocks of ``BLOCK`` of similar words and length, and
terms of at least one document in ``HEAD`` have their contributions laid out by block, with the largest of each block.

A query comes with a threshold that its k-th best score is known to reach.  Its frequent terms in the order of their
upper bounds are passed over while these sum to less than the threshold (a share of it): no document is a candidate for
them alone, which is WAND's choice of the pivot, made once for the whole shard.  The postings of rare terms are summed.
Then blocks are skipped: where a block's best sum and its maxima of all frequent terms stay below the threshold, none of
its contributions is read.  In the others the frequent terms that were not passed over are added, documents that cannot
reach the threshold with the block's maxima of the terms passed over are skipped, and only the rest is looked up in those.
All documents of a shard take these steps together in array operations, instead of one cursor movement after another, and
so do up to ``TOGETHER`` queries whose bounds of the blocks are alike: the blocks that any of them opens are read once.

Thresholds come from the documents themselves, by hash: those of the first of ``SHARES`` are searched without one, the
next with the k-th best score so far, and the rest with the best of both.  So a shard returns only documents that are
among the best of a known share, and rows returned grow with queries * k, not with shards.  The early shares are few
documents, so their terms are written once, by shard, and each task reads one shard and blocks of ``ASKED`` queries; of
the last share each task indexes what it reads, and texts are not shuffled.

A term is a lower-cased word (see textcore) and is known by its 64-bit hash.  Scores: sum over the query's distinct
terms of count in the query * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length)), with
idf = ln(1 + (N - df + 0.5) / (df + 0.5)), rounded to 1e-6; equal scores rank by smaller doc_id.  Bounds are in single
precision with a margin; what is returned is scored again in double precision, term after term.

Defined cases: null and empty texts are found by nothing and find nothing, null doc_ids are not searched; repeated rows
are separate documents, and as queries one; fewer than k documents with a shared term give fewer rows; an empty table of
documents or queries gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .tables import bounded, parquet_batches, stored

K1, B = 1.2, 0.75
BLOCK = 64
HEAD = 32
K = 10
SHARD_WORDS = 3_000_000  # postings of a shard, about 60 bytes each
TERM_WORDS = 1_000_000
PASSED = 0.25  # of the threshold, at most, may be left to terms that are passed over
MARGIN = 1e-4  # relative error allowed to single precision
PARTS = 64
ASKED = 2048
TASKS = 256  # of an early share; beyond that a task asks several blocks of queries
TOGETHER = 64  # queries in one product, at most
OPENED = 32  # blocks in one product
CELLS = 1 << 20  # of an array over queries and places, or postings read at once
SHARES = (1, 8, PARTS)  # documents are searched in these steps, in units of 1 / PARTS


def _terms(texts: tc.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) triples sorted by document and term, and the length of every document."""
    w = tc.words(texts)
    h = tc.SpanHash(texts, tc.LOWER_CODES)(w.start, w.end)
    owner = w.owner()
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h))), w.counts


def _text_rows(docs: DataFrame) -> DataFrame:
    return bounded(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df, words) summed per task first; the row of term null counts documents and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = number = words = 0

        def flush() -> pa.RecordBatch:
            term, df = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df.astype(np.int64)), pa.array(np.zeros(len(df), np.int64))], names=["term", "df", "words"])

        for batch in batches:
            for lo, hi, texts in tc.chunks(batch.column(1)):
                _, h, _, counts = _terms(texts)
                held.append(h)
                size, number, words = size + len(h), number + hi - lo, words + int(counts.sum())
                if size > TERM_WORDS:
                    yield flush()
                    size = 0
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([number]), pa.array([words])], names=["term", "df", "words"])

    return _text_rows(docs).mapInArrow(run, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, count)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in tc.chunks(batch.column(1)):
                owner, h, count, _ = _terms(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array(count.astype(np.int64))], names=["query_id", "term", "count"])

    return _text_rows(queries).mapInArrow(run, "query_id long, term long, count long")


class Shard:
    """Inverted index of some documents, and the terms of each for exact scores."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, mean: float):
        n = len(ids)
        self.ids, self.n = ids, n
        self.norm = K1 * (1 - B + B * length / mean)
        # owner rises and terms of one document rise: the forward index is as given
        self.own_tf, self.own = tf.astype(np.int32), np.searchsorted(owner, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        by_term = term[order]
        new = np.flatnonzero(np.concatenate([[True], by_term[1:] != by_term[:-1]])) if len(term) else np.zeros(0, np.int64)
        self.terms, self.first = by_term[new], np.append(new, len(term))
        del by_term
        self.own_term = np.empty(len(term), np.int32)  # place in terms
        self.own_term[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(self.first))
        self.weight = np.zeros(len(new))  # of the query at hand
        impact = (tf * (K1 + 1) / (tf + self.norm[owner]))[order].astype(np.float32)
        self.most = np.maximum.reduceat(impact, new) if len(new) else np.zeros(0, np.float32)
        frequent = np.flatnonzero(np.diff(self.first) * HEAD >= n)
        self.head = np.full(len(new), -1, np.int32)
        self.head[frequent] = np.arange(len(frequent))
        doc = owner[order].astype(np.int32)
        self.blocks = -(-n // BLOCK)
        dense = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        for i, t in enumerate(frequent.tolist()):
            at = slice(self.first[t], self.first[t + 1])
            dense[i, doc[at]] = impact[at]
        # blocks of documents led by the same frequent term, by length
        lead = dense[:, :n].argmax(axis=0) if len(frequent) else np.zeros(n, np.int64)
        self.given = np.lexsort((length, lead))  # the document at each place
        place = np.empty(n, np.int32)
        place[self.given] = np.arange(n, dtype=np.int32)
        dense[:, :n] = dense[:, self.given]
        self.dense = dense.reshape(len(frequent), self.blocks, BLOCK)
        self.block_most = self.dense.max(axis=2, initial=0)
        # a posting is a place and its impact
        self.postings = np.empty((len(term), 2), np.int32)
        self.postings[:, 0] = place[doc]
        self.postings[:, 1] = impact.view(np.int32)

    def exact(self, docs: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of documents, summed in the order of their terms."""
        size = self.own[docs + 1] - self.own[docs]
        own = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.own[docs], size)
        owner = np.repeat(np.arange(len(docs)), size)
        self.weight[at] = weight
        share = self.weight[self.own_term[own]]
        self.weight[at] = 0
        there = np.flatnonzero(share)
        own, owner = own[there], owner[there]
        tf = self.own_tf[own].astype(np.float64)
        return np.round(np.bincount(owner, weights=share[there] * (tf * (K1 + 1) / (tf + self.norm[docs[owner]])), minlength=len(docs)), 6)

    def places(self, term: np.ndarray) -> np.ndarray:
        """Places of terms in the index, -1 for those that it lacks."""
        if not len(self.terms):
            return np.full(len(term), -1)
        once, spot = np.unique(term, return_inverse=True)
        at = np.minimum(np.searchsorted(self.terms, once), len(self.terms) - 1)
        return np.where(self.terms[at] == once, at, -1)[spot]

    def summed(self, owner: np.ndarray, lists: np.ndarray, by: np.ndarray, number: int) -> np.ndarray:
        """Sums over the postings of some terms of each of ``number`` queries, for every block and place."""
        first, width = self.first[lists], self.blocks * BLOCK
        size = self.first[lists + 1] - first
        spot = np.repeat((first - np.cumsum(size) + size), size)
        spot += np.arange(len(spot))
        found = self.postings.view(np.int64).ravel()[spot].view(np.int32).reshape(-1, 2)
        at = np.repeat(owner * width, size)
        at += found[:, 0]
        part = np.repeat(by, size)
        part *= found[:, 1].view(np.float32)
        return np.bincount(at, weights=part, minlength=number * width).astype(np.float32).reshape(number, self.blocks, BLOCK)

    def top(self, at: np.ndarray, weight: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents and their scores, of those with a score of at least ``least``, for terms at ``places``."""
        for _, docs, scores in self.tops(np.array([0, len(at)]), at, weight, k, np.array([least])):
            return docs, scores
        return np.zeros(0, np.int64), np.zeros(0)

    def tops(self, cut: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``top`` of many queries, those that find something; the terms of query i are from cut[i] to cut[i + 1]."""
        step = max(1, CELLS // max(self.blocks, 1))
        for lo in range(0, len(least), step):
            hi = min(lo + step, len(least))
            terms = slice(cut[lo], cut[hi])
            for i, docs, scores in self._tops(cut[lo : hi + 1] - cut[lo], at[terms], weight[terms], k, least[lo:hi]):
                yield lo + i, docs, scores

    def _tops(self, cut: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        number = len(least)
        owner = np.repeat(np.arange(number), np.diff(cut))
        floor = (least * (1 - MARGIN)).astype(np.float32)
        there = at >= 0
        bound = np.zeros(len(at), np.float32)
        bound[there] = weight[there].astype(np.float32) * self.most[at[there]]
        total = np.bincount(owner, weights=bound, minlength=number)
        there &= ((total > 0) & (total * (1 + MARGIN) >= least))[owner]
        owner, at, weight, bound = owner[there], at[there], weight[there], bound[there]
        order = np.lexsort((bound, owner))  # the pivot of each query
        owner, at, weight, bound = owner[order], at[order], weight[order], bound[order]
        by, head = weight.astype(np.float32), self.head[at]
        frequent = np.flatnonzero(head >= 0)
        run = np.cumsum(bound[frequent], dtype=np.float64)
        who = owner[frequent]
        run -= np.concatenate([[0.0], run])[np.searchsorted(who, who)]
        over = np.zeros(len(at), bool)
        over[frequent] = run <= PASSED * floor[who]
        cut = np.searchsorted(owner, np.arange(number + 1))
        held = [np.arange(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        low, high = (np.zeros((number, self.blocks), np.float32) for _ in "ab")
        for i in np.flatnonzero(np.diff(cut)).tolist():
            for most, chosen in ((low[i], held[i][over[held[i]]]), (high[i], held[i][(head[held[i]] >= 0) & ~over[held[i]]])):
                if len(chosen):
                    np.matmul(by[chosen], self.block_most[head[chosen]], out=most)
        alike = low + high
        alike /= np.maximum(np.linalg.norm(alike, axis=1, keepdims=True), 1e-30)
        read = np.bincount(owner, weights=np.where(head < 0, self.first[at + 1] - self.first[at], 0), minlength=number)
        together = max(1, min(TOGETHER, CELLS // max(self.blocks * BLOCK, 1)))
        left = np.flatnonzero(np.diff(cut))
        while len(left):
            left = left[np.argsort(-(alike[left] @ alike[left[0]]), kind="stable")]
            size = min(together, max(1, int(np.searchsorted(np.cumsum(read[left]), CELLS, side="right"))))
            group, left = left[:size], left[size:]
            mine = np.concatenate([held[i] for i in group])
            spot = np.repeat(np.arange(size), np.diff(cut)[group])
            yield from self._group(group, spot, at[mine], weight[mine], by[mine], head[mine], over[mine], low[group], high[group], k, floor[group], least[group])

    def _group(self, group, owner, at, weight, by, head, over, low, high, k, floor, least) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Queries that open similar blocks are asked in one product of their weights and the blocks' contributions."""
        number, rare = len(group), head < 0
        total = self.summed(owner[rare], at[rare], by[rare], number)
        open_ = total.max(axis=2) + low + high >= floor[:, None]
        kept = np.flatnonzero(~rare & ~over)
        used, column = np.unique(head[kept], return_inverse=True)
        share = np.zeros((number, len(used)), np.float32)
        share[owner[kept], column] = by[kept]
        limit = np.where(open_, floor[:, None] - low, np.inf).astype(np.float32)
        blocks = np.flatnonzero(open_.any(axis=0))
        if not len(blocks):
            return
        hits: list[tuple[np.ndarray, ...]] = []
        for some in np.split(blocks, range(OPENED, len(blocks), OPENED)):
            opened = total[:, some]
            if len(used):
                opened += (share @ self.dense[used[:, None], some].reshape(len(used), -1)).reshape(opened.shape)
            who, block, spot = np.nonzero((opened > 0) & (opened >= limit[:, some, None]))
            hits.append((who, some[block] * BLOCK + spot, opened[who, block, spot]))
        who, found, total = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(who, kind="stable")
        found, total = found[order], total[order]
        cut, own = np.searchsorted(who[order], np.arange(number + 1)), np.searchsorted(owner, np.arange(number + 1))
        flat = self.dense.reshape(len(self.dense), self.blocks * BLOCK)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            mine, terms = slice(cut[i], cut[i + 1]), slice(own[i], own[i + 1])
            docs, scores, passed = found[mine], total[mine], np.flatnonzero(over[terms]) + own[i]
            if len(passed):
                scores = scores + by[passed] @ flat[head[passed, None], docs]
            good = scores >= floor[i]
            docs, scores = docs[good], scores[good]
            if len(docs) > k:
                docs = docs[scores >= np.partition(scores, len(scores) - k)[len(scores) - k] * (1 - MARGIN)]
            if not len(docs):
                continue
            docs = self.given[docs]
            scores = self.exact(docs, at[terms], weight[terms])
            good = np.flatnonzero(scores >= least[i])
            good = good[np.lexsort((self.ids[docs[good]], -scores[good]))[:k]]
            if len(good):
                yield int(group[i]), docs[good], scores[good]


def _indexed(column: pa.Array, ids: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    for lo, hi, texts in tc.chunks(column):
        owner, h, tf, counts = _terms(texts)
        yield ids.slice(lo, hi - lo).to_numpy(), owner, h, tf, counts


def _term_rows(docs: DataFrame) -> DataFrame:
    """doc_id, terms and counts of documents, as bytes of their arrays, and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, owner, h, tf, counts in _indexed(batch.column(1), batch.column(0)):
                cut = np.searchsorted(owner, np.arange(len(ids) + 1))
                held = [[x[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)] for x in (h, tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(x, pa.binary()) for x in held), pa.array(counts)], names=["doc_id", "terms", "tf", "length"])

    return docs.mapInArrow(run, "doc_id long, terms binary, tf binary, length long")


def _from_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    terms, tf = batch.column("terms"), batch.column("tf")
    number = pc.binary_length(terms).to_numpy() // 8
    whole = [np.frombuffer(b"".join(x.to_pylist()), kind) for x, kind in ((terms, np.uint64), (tf, np.int32))]
    return batch.column("doc_id").to_numpy(), np.repeat(np.arange(batch.num_rows), number), *whole, batch.column("length").to_numpy()


def _searched(docs: DataFrame, asked: DataFrame, known: DataFrame | None, mean: float, k: int, shards: int = 0) -> DataFrame:
    """query_id, doc_id and score: the best documents of each shard, at least as good as the query's known threshold.

    With ``shards`` the documents are few: their terms are written in so many shards, and a task is one of these and one
    block of queries (a file of ``asked``), or several where these would make more than ``TASKS``, as each task builds its
    shard anew; else a shard is what a task reads.
    """
    files, known_files = asked.inputFiles(), known.inputFiles() if known is not None else []
    most_words = SHARD_WORDS
    names = ["query_id", "doc_id", "score"]

    def read_bounds() -> tuple[np.ndarray, np.ndarray]:
        least = list(parquet_batches(known_files, 1 << 16, ["query_id", "least"]))
        who = np.concatenate([np.zeros(0, np.int64), *(b.column("query_id").to_numpy() for b in least)])
        floors = np.concatenate([np.zeros(0), *(b.column("least").to_numpy() for b in least)])
        order = np.argsort(who)
        return who[order], floors[order]

    def answers(parts: list[tuple], who: np.ndarray, floors: np.ndarray, own_files: list[str]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([p[0] for p in parts])
        bases = np.cumsum([0, *(len(p[0]) for p in parts)])
        columns = [np.concatenate([p[i] + (base if i == 1 else 0) for p, base in zip(parts, bases[:-1], strict=True)]) for i in (1, 2, 3, 4)]
        parts.clear()
        shard = Shard(ids, *columns, mean)
        del columns
        for batch in parquet_batches(own_files, 256, ["query_id", "term", "weight"]):
            rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            queries = batch.column("query_id").to_numpy()
            spot = np.searchsorted(who, queries)
            there = np.minimum(spot, max(len(who) - 1, 0))
            least = np.where(who[there] == queries, floors[there], 0.0) if len(who) else np.zeros(len(queries))
            terms, weights = batch.column("term"), batch.column("weight").flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())])
            places = shard.places(terms.flatten().to_numpy().view(np.uint64))
            for i, d, s in shard.tops(bounds, places, weights, k, least):
                rows.append((np.full(len(d), queries[i]), shard.ids[d], s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=names)

    def search(found: Iterator[tuple[np.ndarray, ...]], own_files: list[str]) -> Iterator[pa.RecordBatch]:
        limits = read_bounds()
        parts: list[tuple] = []
        size = 0
        for part in found:
            parts.append(part)
            size += len(part[2])
            if size > most_words:
                yield from answers(parts, *limits, own_files)
                size = 0
        if parts:
            yield from answers(parts, *limits, own_files)

    schema = "query_id long, doc_id long, score double"
    if not shards:
        return docs.mapInArrow(lambda batches: search((p for b in batches for p in _indexed(b.column(1), b.column(0))), files), schema)
    index = stored(_term_rows(docs).repartition(shards), "index").inputFiles()
    span = max(1, min(len(files), len(index) * len(files) // TASKS))
    each = -(-len(files) // span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                rows = parquet_batches([index[task // each]], 256, ["doc_id", "terms", "tf", "length"])
                first = task % each * span
                yield from search((_from_rows(b) for b in rows), files[first : first + span])

    tasks = len(index) * each
    return docs.sparkSession.range(0, tasks, 1, max(tasks, 1)).mapInArrow(run, schema)


def top_k(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), doc_id and score of the k best documents for each query."""
    df = stored(frequencies(docs), "frequencies")
    total = df.where("term is null").first()
    number, mean = (total.df or 0, max((total.words or 0) / max(total.df or 0, 1), 1e-9)) if total else (0, 1.0)
    idf = F.log(1 + (F.lit(float(number)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = query_terms(queries).distinct().join(df.where("term is not null").select("term", "df"), "term").select("query_id", "term", (F.col("count") * idf).alias("weight"))
    # in the order of the hashes as unsigned numbers
    asked = terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((F.col("term") < 0).alias("high"), "term", "weight"))).alias("t"))
    blocks = max(1, -(-queries.where("doc_id is not null").count() // ASKED))
    asked = stored(asked.select("query_id", F.col("t.term").alias("term"), F.col("t.weight").alias("weight")).repartition(blocks), "queries")
    rank: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    postings = df.where("term is not null").agg(F.sum("df")).first()[0] or 0
    rows = _text_rows(docs).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    best, known, lo = None, None, 0
    for hi in SHARES:
        part = rows.where((F.col("_part") >= lo) & (F.col("_part") < hi)).drop("_part")
        found = _searched(part, asked, known, mean, k, 0 if hi == PARTS else max(1, -(-postings * (hi - lo) // PARTS // SHARD_WORDS)))
        found = (found if best is None else found.unionByName(best)).withColumn("rank", rank).where(F.col("rank") <= k)
        if hi == PARTS:
            return found.select("query_id", "rank", "doc_id", "score")
        best, lo = stored(found.select("query_id", "doc_id", "score", "rank"), "best"), hi
        known = stored(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")), "thresholds")
        best = best.drop("rank")
    raise AssertionError("the last share is PARTS")
