"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Words here are lower-cased runs of letters, digits and non-ASCII bytes.  Hashes of ``GRAM`` consecutive words are
winnowed: in every window of ``WINDOW`` of them the smallest is kept, so a run of GRAM + WINDOW - 1 words shared with a
template always shares a fingerprint.  The templates' fingerprints form an inverted index (template, position) that
every task holds; a document's fingerprints are looked up in it.  Hits of one template on close diagonals (within the
band and half the template) and near each other are one candidate; it is aligned with the template by local alignment inside a band around its diagonals (match
+1, mismatch and gap -1).  Matches that cover at least ``COVERAGE`` of the template's words are reported.

Edits can leave no such run, so there are seeds besides.  A local alignment of more than one word begins with two words
that follow each other in text and template alike (a single match followed by anything else falls back to 0), and one
that covers COVERAGE begins within the first 1 - COVERAGE of the template.  Every pair of words there is indexed, none
winnowed, and every hit with enough words of the template behind it is aligned: in the same band around its diagonal and,
for templates of at most ``SHORT`` words, in one as wide as the template too.

Templates are a short list, so the index has a fixed size; documents are read whole and independently, with no shuffle.

Defined cases: a null or empty text matches nothing; repeated rows are scanned separately; overlapping matches of
different templates are all reported, of one template the better one (by score, then the first); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .tables import bounded

GRAM, WINDOW = 3, 3
BAND = 8
SHORT = 20
COVERAGE = 0.8

#: Notices of public licenses.
TEMPLATES = [
    ("MIT", "short", "Released under the MIT License."),
    ("Apache-2.0", "short", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "short", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "short", "Licensed under CC BY-NC 4.0."),
    (
        "MIT", "full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "Apache-2.0", "notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0", "notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "BSD-3-Clause", "full",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    ),
]

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STARTS_POINT = (np.arange(256) & 0xC0) != 0x80


def fingerprints(texts: tc.Texts) -> tuple[tc.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, and (position, hash) of the winnowed word grams of all documents."""
    w = tc.spans(texts, _IN_WORD[texts.data])
    span = tc.SpanHash(texts, tc.LOWER_CODES)
    h = span(w.start, w.end)
    grams, at, first = tc.windows(h, w, GRAM)
    number = np.diff(first)
    short = np.repeat((number > 0) & (number < WINDOW), number)
    kept = short.copy()  # fewer grams than a window: all are kept
    n = len(grams) - WINDOW + 1
    if n > 0:
        owner = np.repeat(np.arange(len(number)), number)
        whole = owner[:n] == owner[WINDOW - 1 :]
        least = grams[:n].copy()
        for k in range(1, WINDOW):
            np.minimum(least, grams[k : n + k], out=least)
        for k in range(WINDOW):
            kept[k : n + k] |= whole & (grams[k : n + k] == least)
    return w, h, at[kept], grams[kept]


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES):
        self.templates = templates
        _, _, texts = next(tc.chunks(pa.array([t for _, _, t in templates], pa.string()), 1 << 40))
        w, h, at, fp = fingerprints(texts)
        self.words = [h[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
        owner = np.searchsorted(w.first, at, side="right") - 1
        order = np.argsort(fp, kind="stable")
        self.fp, self.template, self.place = fp[order], owner[order], (at - w.first[owner])[order]
        self.near = _near(self.fp)
        self.need = [math.ceil(COVERAGE * len(x)) for x in self.words]
        pair, at, _ = tc.windows(h, w, 2)
        owner = np.searchsorted(w.first, at, side="right") - 1
        place = at - w.first[owner]
        first = np.flatnonzero(place <= np.array([len(x) - n for x, n in zip(self.words, self.need, strict=True)])[owner])
        order = first[np.argsort(pair[first], kind="stable")]
        self.pair, self.pair_template, self.pair_place = pair[order], owner[order], place[order]
        self.pair_near = _near(self.pair)

    def hits(self, at: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the text, template, position in the template) of every shared fingerprint."""
        at, entry = _met(at, fp, self.fp, self.near)
        return at, self.template[entry], self.place[entry]

    def seeds(self, w: tc.Words, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, template, start of the template in the text, band) of every place where a match may begin."""
        pair, at, _ = tc.windows(h, w, 2)
        at, entry = _met(at, pair, self.pair, self.pair_near)
        owner = np.searchsorted(w.first, at, side="right") - 1
        for t in np.unique(self.pair_template[entry]).tolist():
            mine = self.pair_template[entry] == t
            size, known = len(self.words[t]), np.sort(self.words[t])
            band = min(BAND, size // 2)
            reach = max(band, size) if size <= SHORT else band
            a, d, start = at[mine], owner[mine], at[mine] - self.pair_place[entry[mine]]
            for lo in range(0, len(a), 4096):
                b = a[lo : lo + 4096, None] + np.arange(size + reach)
                inside = b < np.minimum(w.first[d[lo : lo + 4096] + 1], start[lo : lo + 4096] + size + reach)[:, None]
                word = h[np.minimum(b, len(h) - 1)]
                shared = known[np.minimum(np.searchsorted(known, word), size - 1)] == word
                enough = (shared & inside).sum(axis=1) >= self.need[t]
                for doc, begin in sorted(set(zip(d[lo : lo + 4096][enough].tolist(), start[lo : lo + 4096][enough].tolist(), strict=True))):
                    yield from ((doc, t, begin, x) for x in sorted({band, reach}))


def _near(sorted_: np.ndarray) -> np.ndarray:
    near = np.zeros(1 << 16, dtype=bool)
    near[(sorted_ >> np.uint64(48)).astype(np.int64)] = True
    return near


def _met(at: np.ndarray, fp: np.ndarray, sorted_: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the text, entry of the index) of every hash that the index has."""
    maybe = near[(fp >> np.uint64(48)).astype(np.int64)]
    at, fp = at[maybe], fp[maybe]
    lo, hi = np.searchsorted(sorted_, fp, side="left"), np.searchsorted(sorted_, fp, side="right")
    number = hi - lo
    entry = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(lo, number)
    return np.repeat(at, number), entry


def align(template: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int, int]:
    """Best local alignment with text position - template position in low..high: (score, matched, first, past last word of text)."""
    width = high - low + 1
    best = (0, 0, 0, 0)
    above = [(0, 0, 0)] * (width + 1)  # score, matched, first word
    for i, word in enumerate(template):
        row = [(0, 0, 0)] * (width + 1)
        left = (0, 0, 0)
        for k in range(width):
            j = i + low + k
            if not 0 <= j < len(text):
                left = (0, 0, 0)
                continue
            score, matched, first = above[k] if above[k][0] > 0 else (0, 0, j)
            cell = (score + 1, matched + 1, first) if text[j] == word else (score - 1, matched, first)
            up = above[k + 1]
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] <= 0:
                cell = (0, 0, 0)
            elif cell[0] > best[0]:
                best = (*cell, j + 1)
            row[k] = left = cell
        above = row
    return best


def matches(texts: tc.Texts, index: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, template, matched words, first byte, past last byte, score) of every reported match."""
    w, h, at, fp = fingerprints(texts)
    at, template, place = index.hits(at, fp)
    owner = np.searchsorted(w.first, at, side="right") - 1
    order = np.lexsort((at, template, owner))
    at, template, place, owner = at[order], template[order], place[order], owner[order]
    sizes = np.array([len(x) for x in index.words])
    start = at - place  # where the template would begin
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (template[1:] != template[:-1]) | (np.abs(start[1:] - start[:-1]) > np.minimum(BAND, sizes[template[1:]] // 2)) | (at[1:] - at[:-1] > sizes[template[1:]] + BAND)
    cuts = np.append(np.flatnonzero(new), len(at))
    around = {}  # (document, template, least start, largest start, band), each once
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        t = int(template[lo])
        around[int(owner[lo]), t, int(start[lo:hi].min()), int(start[lo:hi].max()), min(BAND, int(sizes[t]) // 2)] = True
    around |= {(d, t, begin, begin, band): True for d, t, begin, band in index.seeds(w, h)}
    found: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for d, t, least, largest, band in around:
        size = int(sizes[t])
        begin = max(least - band, int(w.first[d]))
        end = min(largest + size + band, int(w.first[d + 1]))
        if end - begin < COVERAGE * size:
            continue
        score, matched, a, b = align(index.words[t].tolist(), h[begin:end].tolist(), least - begin - band, largest - begin + band)
        if matched >= COVERAGE * size:
            found.setdefault((d, t), []).append((score, matched, begin + a, begin + b))
    for (d, t), all_ in sorted(found.items()):
        kept: list[tuple[int, int, int, int]] = []
        for score, matched, a, b in sorted(all_, key=lambda x: (-x[0], x[2], -x[1])):
            if all(b <= c or e <= a for _, _, c, e in kept):
                kept.append((score, matched, a, b))
        for score, matched, a, b in sorted(kept, key=lambda x: x[2]):
            yield d, t, matched, int(w.start[a]), int(w.end[b - 1]), score


RESULT = "doc_id long, license string, template string, first long, past long, matched long, template_words long, coverage double"


def scanned(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """One row per match; first and past are code points of the text."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            for lo, _, texts in tc.chunks(batch.column(1)):
                points = np.concatenate([[0], np.cumsum(_STARTS_POINT[texts.data])])
                rows = [(lo + d, t, m, int(points[a] - points[texts.bounds[d]]), int(points[b] - points[texts.bounds[d]])) for d, t, m, a, b, _ in matches(texts, index)]
                if rows:
                    d, t, m, a, b = zip(*rows, strict=True)
                    size = [len(index.words[x]) for x in t]
                    columns = [
                        batch.column(0).take(pa.array(d)), pa.array([templates[x][0] for x in t]), pa.array([templates[x][1] for x in t]), pa.array(a), pa.array(b), pa.array(m), pa.array(size),
                        pa.array([x / y for x, y in zip(m, size, strict=True)]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
