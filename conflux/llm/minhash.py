"""MinHash near-duplicate grouping with SuperMinHash signatures.

Method
------
1. One Arrow pass turns every whole text into its set of distinct word shingles and a SuperMinHash signature: element
   j draws, step by step, a rank ``i + r`` and a slot from its own lazily shuffled permutation, so the ranks of one
   element are correlated across slots.  Steps stop as soon as every slot of the document holds a value below the next
   step's ranks (early stopping): later steps cannot change it.
2. Documents with equal sets are one class (a 128-bit set sum is the key), so copies are grouped by an aggregation.
   Classes of very many documents (at most ``HOT_CLASSES`` can be that large) are broadcast to their members, the others
   joined.
3. Class signatures are banded.  In every bucket each class is paired with the bucket's smallest class (a star, linear
   in the bucket); pairs whose signatures agree enough are verified on the full sets.
4. Verified links are grouped: union-find inside tasks, then large-star / small-star rounds across them.
5. Buckets whose classes are still in several groups get further stars, each from the smallest class of a group that had
   none, while stars find links.  So a family of near copies that is far from its bucket's smallest class is one star too.
6. What is still apart is certified exactly: the classes are compared in blocks, by signature agreement and then by
   bitmaps that bound the overlap from above, and the pairs of different groups that can still reach the threshold are
   verified on full sets.

No bucket, pair list or component is collected into one task or the driver, and none is capped.  Whole texts are not
shuffled to find the few whose sets are needed, nor to drop copies: a bitmap (see ``sieve``) holds the others back.

Defined cases: a null or word-less text has an empty set, is linked with nothing and keeps itself; a null doc_id is
given its class's component, else null, and is not kept; rows that repeat a doc_id count as one document and get one
component; extra columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .sieve import Sieve, found
from .tables import bounded, dropped, stored

SLOTS, ROWS = 96, 4  # 24 bands of 4: a pair at similarity 0.8 shares none with probability 3e-6
AGREEMENT = 0.6  # least share of equal slots; at similarity 0.8 fewer agree with probability below 1e-6
ELEMENTS = 60_000
BLOCK = 512
HOT, HOT_CLASSES = 1000, 100_000  # a class is hot from HOT documents and a share of 1 / HOT_CLASSES of all on
STARS = 1  # rounds of further stars; the blocks settle what is left


def shingle_sets(texts: tc.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and their bounds."""
    w = tc.words(texts)
    span = tc.SpanHash(texts, tc.LOWER_CODES)
    h, _, first = tc.windows(span(w.start, w.end), w, size, short_whole=True)
    sets, bounds = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i in range(len(texts)):
        one = np.sort(h[first[i] : first[i + 1]])
        if len(one) > 1:
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        sets.append(one)
        bounds[i + 1] = bounds[i] + len(one)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def super_minhash(sets: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """(documents, slots) signature values as uint16; 0 everywhere for an empty set."""
    out = np.zeros((len(bounds) - 1, slots), dtype=np.uint16)
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + ELEMENTS, side="right")) - 1)
        hi = min(hi, len(bounds) - 1)
        out[lo:hi] = _signatures(sets[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], slots)
        lo = hi
    return out


def _signatures(elements: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    n = len(bounds) - 1
    least = np.full(n * slots, np.inf)
    open_doc = np.diff(bounds) > 0
    owner = np.repeat(np.arange(n), np.diff(bounds))
    if len(elements) > 4 * ELEMENTS:  # one very long text: its permutations in pieces
        for part in np.array_split(np.arange(len(elements)), len(elements) // ELEMENTS + 1):
            _steps(elements[part], owner[part], least, open_doc.copy(), slots)
    else:
        _steps(elements, owner, least, open_doc, slots)
    bits = np.where(np.isinf(least), 0, least).view(np.uint64)
    return (tc.mix(bits + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(48)).astype(np.uint16).reshape(n, slots)


def _steps(elements: np.ndarray, owner: np.ndarray, least: np.ndarray, open_doc: np.ndarray, slots: int) -> None:
    n = len(open_doc)
    places = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(elements), slots)).copy().ravel()
    live = np.arange(len(elements))
    for i in range(slots):
        draw = tc.mix(elements[live] + np.uint64((i + 1) * 0x9FB21C651E98DF25 & (2**64 - 1)))
        rank = (draw >> np.uint64(32)).astype(np.float64) * 2.0**-32 + i
        other = i + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - i)) >> np.uint64(32)).astype(np.int64)
        row = live * slots
        slot = places[row + other]
        places[row + other] = places[row + i]
        cell = owner[live] * slots + slot
        new = least[cell] > rank
        np.minimum.at(least, cell[new], rank[new])
        done = open_doc & (least.reshape(n, slots).max(axis=1) < i + 1)
        if done.any():
            open_doc &= ~done
            live = live[open_doc[owner[live]]]
            if not len(live):
                return


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def features(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, two set sums, and the signature as one long for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in tc.chunks(batch.column(1)):
                sets, bounds = shingle_sets(texts, shingle)
                sig = super_minhash(sets, bounds)
                sums = []
                for salt in (0x1234567, 0x89ABCDEF01):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(tc.mix(sets ^ np.uint64(salt)))])
                    sums.append(_signed(total[bounds[1:]] - total[bounds[:-1]]))
                bands = np.ascontiguousarray(sig).view(np.int64).reshape(-1)
                each = SLOTS // ROWS
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(bounds)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * each), pa.array(bands)),
                    ],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands"],
                )

    chosen = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def sets_of(docs: DataFrame, wanted: Sieve, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full sets and their bitmaps of the documents whose ids are in the sieve (and of a few others)."""
    load = wanted.loader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = load() if words is None else words
            batch = batch.filter(pa.array(found(words, batch.column(2).to_numpy())))
            for lo, hi, texts in tc.chunks(batch.column(1)):
                sets, bounds = shingle_sets(texts, shingle)
                maps = [bitmap(sets[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in maps])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(_signed(sets))),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_signed(np.concatenate(maps)))),
                    ],
                    names=["doc_id", "shingles", "bits"],
                )

    chosen = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return chosen.withColumn("spot", wanted.spot(F.col("doc_id"))).mapInArrow(run, "doc_id long, shingles array<long>, bits array<long>")


def local_forest(edges: DataFrame) -> DataFrame:
    """Union-find over the edges of each task; a task returns (root, member) links that join the same vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        def flush() -> pa.RecordBatch:
            found = [(root(x), x) for x in list(parent)]
            found = [(r, x) for r, x in found if r != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 200_000:  # bounded memory; what was joined so far is passed on
                yield flush()
        yield flush()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(member, component) of every vertex that has a link; component is the smallest vertex reachable.

    Each round hangs all neighbours of a vertex on the smallest one: first the larger neighbours (large star), then the
    smaller ones (small star).  It ends when every vertex hangs on its component's smallest one, after a number of
    rounds logarithmic in the diameter.
    """
    now = stored(local_forest(edges.select("a", "b").where("a <> b")).distinct(), "forest")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = stored(large, "large")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        # b's smaller neighbours and b itself hang on the smallest of them
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("x")).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        small = stored(small, "small")
        roots = small.select("a").distinct()
        again = small.join(roots.withColumnRenamed("a", "b"), "b", "left_semi").limit(1).count()
        many = small.groupBy("b").count().where("count > 1").limit(1).count()
        now = small
        if not again and not many:
            return now.select(F.col("b").alias("member"), F.col("a").alias("component")).unionByName(roots.select(F.col("a").alias("member"), F.col("a").alias("component")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets overlap by at least ``percent`` of their union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(right, "b").join(left, "a")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    of = F.size("sa") + F.size("sb")
    enough = F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent
    return joined.where(enough & (both * 100 >= (of - both) * percent)).select("a", "b").distinct()


def agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough bands' slots to be near: signatures differ in few slots at the threshold."""
    joined = pairs.join(signatures.toDF("b", "sb"), "b").join(signatures.toDF("a", "sa"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.ascontiguousarray(batch.column(c).flatten().to_numpy()).view(np.uint16).reshape(-1, SLOTS) for c in (2, 3))
            good = (sa == sb).sum(axis=1) >= int(np.ceil(AGREEMENT * SLOTS))
            yield batch.select([0, 1]).filter(pa.array(good))

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def bitmap_words(n: int) -> int:
    """Length, in 64-bit words, of the bitmap of a set of ``n``: about 16 bits an element, a power of two."""
    return 1 << max(0, (n // 4).bit_length())


def bitmap(elements: np.ndarray) -> np.ndarray:
    out = np.zeros(bitmap_words(len(elements)), dtype=np.uint64)
    bit = elements & np.uint64(64 * len(out) - 1)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _possible(x: int, others: np.ndarray, size: np.ndarray, bits: dict[int, np.ndarray], row: np.ndarray, width: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` can reach the threshold with x.

    An element whose bit the other set lacks is not shared, so bitmaps bound the intersection from above.
    """
    keep = np.zeros(len(others), dtype=bool)
    for w in np.unique(width[others]).tolist():
        here = np.flatnonzero(width[others] == w)
        words = min(w, int(width[x]))
        theirs = _folded(bits[w][row[others[here]]], words)
        mine = _folded(bits[int(width[x])][row[x : x + 1]], words)
        lost = np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
        extra = np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64)
        shared = np.minimum(size[x] - lost, size[others[here]] - extra)
        keep[here] = 100 * shared >= percent * (size[x] + size[others[here]] - shared)
    return keep


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def _close(rows: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Compares the classes of each block pair by signature, those of one component left out.

    Input rows: key, i, j, own (the row's block), pos (the band), rep, comp, bands and, with ``pairs``, size and bits;
    rows of one (key, i, j) are together.  Returns the classes that have a close one, or the close pairs whose bitmaps
    leave the threshold possible; a pair counts in the first band that it shares, so it is found once.
    """
    least = int(np.ceil(AGREEMENT * SLOTS))

    def found(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
        bands = _flat(t.column("bands")).flatten().to_numpy().reshape(-1, SLOTS // ROWS)
        sig = np.ascontiguousarray(bands).view(np.uint16).reshape(-1, SLOTS)
        rep, comp, own, pos = (t.column(c).to_numpy() for c in ("rep", "comp", "own", "pos"))
        if pairs:
            size, raw = t.column("size").to_numpy(), _flat(t.column("bits"))
            flat, ends = raw.flatten().to_numpy().view(np.uint64), raw.offsets.to_numpy() - raw.offsets[0].as_py()
            width, row, bits = np.diff(ends), np.zeros(len(rep), np.int64), {}
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                row[at] = np.arange(len(at))
                bits[w] = flat[ends[at][:, None] + np.arange(w)[None, :]]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            crossing = key[lo, 1] != key[lo, 2]
            for x in range(lo, hi):
                if crossing and own[x] != key[lo, 1]:
                    continue
                other = np.arange(lo if crossing else x + 1, hi)
                other = other[(comp[other] != comp[x]) & ((own[other] != own[x]) if crossing else True)]
                other = other[(sig[other] == sig[x]).sum(axis=1) >= least]
                if not len(other):
                    continue
                if pairs:
                    other = other[~(bands[other, : pos[x]] == bands[x, : pos[x]]).any(axis=1)]
                    other = other[_possible(x, other, size, bits, row, width, percent)]
                yield np.full(len(other), rep[x]), rep[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            got = list(found(t))
            a, b = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
            if pairs:
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([a, b])))], names=["rep"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            key = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if len(ends):
                yield out(held.slice(0, ends[-1]))
                held = held.slice(ends[-1])
        if held is not None and held.num_rows:
            yield out(held)

    return rows.mapInArrow(run, "a long, b long" if pairs else "rep long")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Deals the rows of each key to all pairs of its blocks of about ``BLOCK`` rows."""
    spark = rows.sparkSession
    blocks = F.ceil(F.col("bucket_size") / BLOCK).cast("long")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).drop("with", "bucket_size")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Links are pairs with 100 * intersection >= percent * union of their distinct shingles.
    """
    features_of = stored(features(docs, shingle, id_col, text_col), "signatures")
    classes = features_of.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    classes = stored(classes, "all-classes")
    # at most HOT_CLASSES classes can have that many members
    hot = F.col("members") > max(HOT, features_of.count() // HOT_CLASSES)
    of_hot = F.broadcast(classes.where(hot).select("fp1", "fp2", F.col("rep").alias("hot_rep")))
    marked = features_of.select("doc_id", "n_shingles", "fp1", "fp2").join(of_hot, ["fp1", "fp2"], "left")
    columns = ["doc_id", "n_shingles", "rep"]
    cold = marked.where("hot_rep is null").join(classes.where(~hot), ["fp1", "fp2"], "left").select(*columns)
    named = stored(cold.unionByName(marked.where("hot_rep is not null").withColumnRenamed("hot_rep", "rep").select(*columns)), "classes")
    reps = named.where("doc_id = rep").select("doc_id").distinct()
    signatures = stored(features_of.join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "bands").distinct(), "representatives")
    dropped(features_of, classes)
    banded = signatures.select("rep", F.posexplode("bands").alias("pos", "value")).select("rep", "pos", F.xxhash64("pos", "value").alias("key"))
    counted = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("rep").alias("bucket_size")).where("bucket_size > 1")
    buckets = stored(banded.join(counted, "key"), "buckets")
    wanted = Sieve(buckets.select("rep").distinct())
    sets = stored(sets_of(docs, wanted, shingle, id_col, text_col), "sets")

    def near(pairs: DataFrame) -> DataFrame:
        close = stored(agreeing(pairs.distinct(), signatures), "agreeing")
        return stored(verified(close, sets, percent), "links")

    links = near(buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    grouped = components(links)
    tried = buckets.select("key", F.col("pivot").alias("rep")).distinct()
    for turn in range(STARS + 1):
        rest = buckets.where("bucket_size > 2").join(grouped.withColumnRenamed("member", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        torn = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        rest = stored(rest.join(torn, "key", "left_semi").select("key", "pos", "rep", "comp", "bucket_size"), "unsettled")
        if turn == STARS or not rest.limit(1).count():
            break
        reached = rest.join(tried, ["key", "rep"]).select("key", "comp").distinct()
        new = stored(rest.join(reached, ["key", "comp"], "left_anti").groupBy("key").agg(F.min(F.struct("rep", "comp")).alias("p")).select("key", "p.rep", F.col("p.comp").alias("own")), "pivots")
        more = near(rest.join(new.withColumnRenamed("rep", "pivot"), "key").where("comp <> own").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")))
        if not more.limit(1).count():
            break
        tried = tried.unionByName(new.select("key", "rep"))
        links = links.unionByName(more)
        grouped = components(links)
    if rest.limit(1).count():
        close = stored(_close(_in_blocks(rest.join(signatures, "rep")), percent, pairs=False).distinct(), "near")
        sketches = sets.select(F.col("doc_id").alias("rep"), F.size("shingles").cast("long").alias("size"), "bits")
        rest = rest.join(close, "rep", "left_semi").join(signatures, "rep").join(sketches, "rep")
        more = stored(_close(_in_blocks(rest), percent, pairs=True).distinct(), "close")
        more = stored(verified(more, sets, percent), "links")
        if more.limit(1).count():
            grouped = components(links.unionByName(more))
    dropped(buckets, sets, signatures)

    out = named.join(grouped.withColumnRenamed("member", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the one of smallest id.

    Rows that repeat that id count as one document, of which the smallest text stays; rows without an id stay.  Only
    rows that may have to go, or whose id is repeated, are joined with the verdicts; the others pass as they are read.
    """
    verdicts = near_duplicates(docs, shingle, percent, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    doubtful = Sieve(verdicts.where("not kept or n > 1").select("doc_id"))
    verdicts = stored(verdicts, "verdicts")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    asked = doubtful.split(rows, "_id", hit=True).join(verdicts.where("kept").select(F.col("doc_id").alias("_id"), "n"), "_id")
    out = doubtful.split(rows, "_id", hit=False).select("_row.*").unionByName(asked.where("n = 1").select("_row.*"))
    if verdicts.where("kept and n > 1").limit(1).count():
        first = asked.where("n > 1").groupBy("_id").agg(F.min_by("_row", "_text").alias("_row"), F.first("_row", ignorenulls=True).alias("_any"))
        out = out.unionByName(first.select(F.coalesce("_row", "_any").alias("_row")).select("_row.*"))
    return out.unionByName(rows.where("_id is null").select("_row.*"))
