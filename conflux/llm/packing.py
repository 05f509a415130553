"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenised, end with an end id, and only those longer than a sequence are cut.  Pieces are dealt to
partitions of about ``PART`` pieces; each is packed by best-fit decreasing.  Dual-feasible functions give lower bounds
on the bins a partition's lengths need: a partition that meets its bound is certified and done.  A partition with a gap
exchanges documents and packs again: first among its own bins (groups of bins are released, some of the emptiest and
some drawn from the others, and their pieces are packed anew by best-fit decreasing and by fullest bins; the fewer bins
stay), then with other partitions (the bins that are still not full are dealt to new partitions).  Rounds go on while
they save bins, at every size, and every partition stays of bounded size.  ``part_bins`` and ``part_bound`` of a piece
say how many bins its last partition used and how many it needs at least.

Tokenising: the vocabulary's pre-tokeniser never joins across white space, nor a letter with a stop after it, and lowers
all letters, so a text's ids are those of its lowered words and of the stops behind them one after another.  Each
distinct word is encoded once by the tokenizers library and found again by its hash, and its bytes are compared.  A worker keeps its words from task to task; beyond ``WORDS_HELD`` it forgets those not seen for longest.

Defined cases: a null or empty text is one piece holding the end id alone; repeated rows are packed as separate
documents; a null doc_id is kept; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .tables import bounded, dropped, stored

CAPACITY = 4096
PART = 32_768
END_ID = 1
WORDS_HELD = 600_000  # about 60 bytes each
RECENT = 30_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, part_bins long, part_bound long"


def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[first[i] : first[i] + size[i]] of all i, one after another."""
    total = np.cumsum(size)
    return flat[np.arange(total[-1] if len(total) else 0) - np.repeat(total - size - first, size)]


class _Rows:
    """Growing rows of values of different lengths."""

    def __init__(self, kind: type):
        self.flat, self.bounds, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), 0

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        used = int(self.bounds[self.n])
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(size) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[used : used + len(flat)] = flat
        self.bounds[self.n + 1 : self.n + 1 + len(size)] = used + np.cumsum(size)
        self.n += len(size)

    def sizes(self, which: np.ndarray) -> np.ndarray:
        return self.bounds[which + 1] - self.bounds[which]

    def take(self, which: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.bounds[which], self.sizes(which))

    def only(self, which: np.ndarray) -> _Rows:
        out = _Rows(self.flat.dtype.type)
        out.add(self.take(which), self.sizes(which))
        return out


#: Words of these bytes are one lower-case run of letters, which normalising and pre-tokenising leave as it is.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
STOPS = np.isin(np.arange(256), list(b".,;:!?"))
ASCII_WORD = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def lowered(texts: tc.Texts) -> tc.Texts:
    """ASCII letters lowered, except before characters from U+0180 on: a mark there may combine with one case only."""
    data = texts.data
    after = np.zeros_like(data)
    after[:-1] = data[1:]
    return tc.Texts(np.where(after < 0xC6, tc.LOWER[data], data), texts.bounds)


def parts(texts: tc.Texts) -> tc.Words:
    """Words, with the stops behind a letter or digit as words of their own."""
    w, data = tc.words(texts), texts.data
    if not len(w.start):
        return w
    last = np.maximum.accumulate(np.where(STOPS[data], -1, np.arange(len(data))))  # the last byte that is no stop
    cut = np.maximum(last[w.end - 1] + 1, w.start)
    before, lead = data[cut - 1], data[np.maximum(cut - 2, 0)]
    letter = (lead == 0xC3) & (before >= 0x80) & (cut - 2 >= w.start) & (before != 0x97) & (before != 0xB7)  # of Latin-1
    split = (cut > w.start) & (cut < w.end) & (ASCII_WORD[before] | letter)
    place = np.arange(len(split)) + np.cumsum(split) - split
    start, end = np.zeros(len(split) + int(split.sum()), np.int64), np.zeros(len(split) + int(split.sum()), np.int64)
    start[place], end[place] = w.start, np.where(split, cut, w.end)
    start[place[split] + 1], end[place[split] + 1] = cut[split], w.end[split]
    return tc.Words(start, end, np.append(place, len(start))[w.first])


class WordEncoder:
    """Token ids of whole texts through a table of the ids of words.

    Words are found by sorted hashes, in a large array and a small one of words learned lately, which is merged into the
    large one from time to time.
    """

    def __init__(self, path: str, held: int = WORDS_HELD, recent: int = RECENT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.held, self.most_recent = Tokenizer.from_file(path), held, recent
        self.model, self.letters = self.tokenizer.model, str.maketrans(byte_letters())
        self.turn = 0
        self.ids, self.raw = _Rows(np.uint32), _Rows(np.uint8)
        self.seen = np.zeros(0, np.int64)  # the turn in which each word was last met
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]  # hashes and word numbers

    def _merged(self, level: int, keys: np.ndarray, number: np.ndarray) -> None:
        held_keys, held_number = self.levels[level]
        at = np.searchsorted(held_keys, keys)
        self.levels[level] = (np.insert(held_keys, at, keys), np.insert(held_number, at, number))

    def _evict(self) -> None:
        keys, number = self.levels[0]
        kept = np.sort(np.argsort(self.seen, kind="stable")[-(self.held // 2) :])
        new = np.full(len(self.seen), -1, np.int64)
        new[kept] = np.arange(len(kept))
        self.ids, self.raw, self.seen = self.ids.only(kept), self.raw.only(kept), self.seen[kept]
        there = new[number] >= 0
        self.levels[0] = (keys[there], new[number[there]])

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.model.tokenize, self.letters
        found = [[x.id for x in tokenize(w.decode("latin-1").translate(letters))] if PLAIN.fullmatch(w) else [] for w in words]
        rest = [i for i, ids in enumerate(found) if not ids]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum())), size

    def __call__(self, texts: tc.Texts) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and each text's bounds in them."""
        whole, texts = texts, lowered(texts)
        w = parts(texts)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        self.turn += 1
        if len(self.levels[1][0]) > self.most_recent:
            self._merged(0, *self.levels[1])
            self.levels[1] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if self.ids.n > self.held:
                self._evict()
        key, where, spot = np.unique(tc.SpanHash(texts)(w.start, w.end), return_index=True, return_inverse=True)
        number = np.full(len(key), -1, dtype=np.int64)
        for keys, numbers in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                number = np.where(keys[at] == key, numbers[at], number)
        first, size = w.start[where], w.end[where] - w.start[where]
        new = np.flatnonzero(number < 0)
        if len(new):
            flat, sizes = self._encoded([texts.data[a : a + n].tobytes() for a, n in zip(first[new].tolist(), size[new].tolist(), strict=True)])
            number[new] = np.arange(self.ids.n, self.ids.n + len(new))
            self.ids.add(flat, sizes)
            self.raw.add(_gathered(texts.data, first[new], size[new]), size[new])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
            self._merged(1, key[new], number[new])
        self.seen[number] = self.turn
        entry = number[spot]
        length = w.end - w.start
        if (self.raw.sizes(entry) != length).any() or (self.raw.take(entry) != _gathered(texts.data, w.start, length)).any():
            flat, sizes = self._encoded([whole.text(i) for i in range(len(whole))])  # two words with one hash
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        return self.ids.take(entry), np.concatenate([[0], np.cumsum(self.ids.sizes(entry))])[w.first]


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for lo, hi, texts in tc.chunks(batch.column(1)):
                ids, bounds = encode(texts)
                ids = ids.astype("<u4")
                rows: list[tuple[int, int, int, int, int]] = []
                kept = []
                for i in range(hi - lo):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((lo + i, piece, at, len(part), zlib.crc32(part.tobytes())))
                        if with_ids:
                            kept.append(part)
                where, piece, at, size, crc = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
                columns = [batch.column(0).take(pa.array(where)), pa.array(piece.astype(np.int32)), pa.array(at), pa.array(size), pa.array(crc)]
                names = [x.split()[0] for x in PIECES.split(", ")]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest of several dual-feasible-function bounds on the number of bins."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    words = np.cumsum(count * size)
    number = np.cumsum(count)
    for eps in range(1, capacity // 2 + 1):  # longer than capacity - eps counts 1, shorter than eps counts 0
        whole = number[capacity] - number[capacity - eps]
        rest = words[capacity - eps] - words[eps - 1]
        best = max(best, int(whole) + -(-int(rest) // capacity))
    for k in range(1, 51):  # rounds shares of the capacity down to multiples of 1 / k
        scaled = (k + 1) * size
        share = np.where(scaled % capacity == 0, scaled * k, scaled // capacity * (k + 1) * capacity)  # times k (k + 1) capacity
        best = max(best, -(-int((count * share).sum()) // (k * (k + 1) * capacity)))
    there = np.flatnonzero(count)
    units = np.unique(np.concatenate([there, capacity - there + 1, capacity // np.arange(2, 40)]))
    for unit in units[(units > 0) & (2 * units <= capacity)].tolist():  # counts whole units, long pieces by what they leave
        most = capacity // unit
        share = np.where(2 * there > capacity, 2 * (most - (capacity - there) // unit), np.where(2 * there == capacity, most, 2 * (there // unit)))
        best = max(best, -(-int((count[there] * share).sum()) // (2 * most)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of every length."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        room = mask >> size
        if room:
            free = (room & -room).bit_length() - 1 + size
            b = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - free
        if left := free - size:
            by_free[left].append(b)
            mask |= 1 << left
    return bins, offsets


#: Bins released in one try, kinds of lengths looked at for one bin, and tries without a saving before a partition gives up.
GROUP, WIDTH, PATIENCE = 48, 64, 6


def fullest(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bins filled one at a time: the longest piece left, and those of the next shorter ``WIDTH`` kinds that fill it most.

    The sums that pieces can reach are the bits of one number; its highest bit within the capacity is the fill.
    """
    left: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable").tolist():
        left.setdefault(int(lengths[i]), []).append(i)
    sizes = sorted(left)  # of the pieces left
    bins, used = np.zeros(len(lengths), np.int64), 0
    while sizes:
        room = capacity - sizes[-1]
        taken = [sizes[-1]]
        before: list[tuple[int, int]] = []
        reach, within = 1, (1 << (room + 1)) - 1
        top = bisect.bisect_right(sizes, room)
        for s in reversed(sizes[max(0, top - WIDTH) : top]):
            for _ in range(min(len(left[s]) - (s == taken[0]), room // s)):
                before.append((s, reach))
                reach |= reach << s & within
                if reach >> room:
                    break
            if reach >> room:
                break
        at = reach.bit_length() - 1
        for s, reached in reversed(before):
            if not reached >> at & 1:
                taken.append(s)
                at -= s
        for s in taken:
            bins[left[s].pop()] = used
            if not left[s]:
                del left[s], sizes[bisect.bisect_left(sizes, s)]
        used += 1
    return bins


def improved(lengths: np.ndarray, bins: np.ndarray, bound: int, seed: int, capacity: int = CAPACITY) -> np.ndarray:
    """Packs groups of bins again while that saves bins; bins stay numbered from 0 without gaps."""
    whole = fullest(lengths, capacity)
    if whole.max() < bins.max():
        bins = whole
    rnd, misses = np.random.default_rng(seed), 0
    while misses < PATIENCE and (used := int(bins.max()) + 1) > bound:
        fill = np.bincount(bins, weights=lengths, minlength=used)
        order = np.argsort(fill, kind="stable")
        near = order[: GROUP // 3]
        group = np.concatenate([near, rnd.permutation(order[len(near) :])[: GROUP - len(near)]])
        member = np.full(used, False)
        member[group] = True
        at = np.flatnonzero(member[bins])
        tries = [best_fit(lengths[at], capacity)[0], fullest(lengths[at], capacity)]
        best = min(tries, key=lambda b: int(b.max()))
        if best.max() + 1 < len(group):
            bins = bins.copy()
            bins[at] = used + best
            bins = np.unique(bins, return_inverse=True)[1]
            misses = 0
        else:
            misses += 1
    return bins


def _offsets(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    order = np.argsort(bins, kind="stable")
    total = np.cumsum(lengths[order]) - lengths[order]
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
    out = np.zeros(len(lengths), np.int64)
    out[order] = total - total[first][np.cumsum(first) - 1]
    return out


def _pack(pieces: DataFrame, turn: int, capacity: int) -> DataFrame:
    """Packs each ``part``; ``open`` marks the pieces it releases for exchange."""
    name = np.int64(turn) << np.int64(52)  # turn, part and bin

    def run(t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_numpy()
        part = t.column("part")[0].as_py()
        bins, bound = best_fit(lengths, capacity)[0], lower_bound(lengths, capacity)
        if bins.max() + 1 > bound:
            bins = improved(lengths, bins, bound, part * 1000 + turn, capacity)
        sequence, offsets = name + (np.int64(part) << np.int64(20)) + bins, _offsets(lengths, bins)
        if turn:
            seen, old = np.unique(t.column("sequence_id").to_numpy(), return_inverse=True)
            if bins.max() + 1 >= len(seen):  # nothing saved: the bins stay as they were
                bins, sequence, offsets = old, seen[old], t.column("offset").to_numpy()
        used = int(bins.max()) + 1
        opened = np.zeros(len(lengths), dtype=bool)
        if used > bound:
            fill = np.bincount(bins, weights=lengths, minlength=used)
            emptiest = np.argsort(fill, kind="stable")[: 8 * (used - bound) + 32]
            free = np.zeros(used, dtype=bool)
            free[emptiest] = fill[emptiest] < capacity
            opened = free[bins]
        t = t.select([x.split()[0] for x in PIECES.split(", ")])
        for column, values in (("sequence_id", sequence), ("offset", offsets), ("part_bins", np.full(len(bins), used)), ("part_bound", np.full(len(bins), bound)), ("open", opened)):
            t = t.append_column(column, pa.array(values))
        return t

    return pieces.groupBy("part").applyInArrow(run, PLACED + ", open boolean")


def packed(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins and part_bound of every piece."""
    columns = [x.split()[0] for x in PLACED.split(", ")]
    pieces = stored(pieces.select(*columns[:5]), "pieces")
    number = pieces.count()
    parts = max(1, -(-number // part))
    # dealt by row, for a document may be repeated a million times
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)))
    now = stored(_pack(dealt, 0, capacity), "packed-0")
    dropped(pieces)
    done, waiting, turn = now.where("not open"), now.where("open"), 0
    while True:
        turn += 1
        number, bins = (waiting.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first() or (0, 0))[:2]
        if not number:
            break
        # whole bins move, so that a partition can fall back on them
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(-(-number // part)))).drop("open")
        again = stored(_pack(dealt, turn, capacity), f"packed-{turn}")
        saved = bins - again.agg(F.countDistinct("sequence_id")).first()[0]
        done, waiting = done.unionByName(again.where("not open")), again.where("open")
        if saved <= 0:
            break
    return done.unionByName(waiting).select(*columns)
