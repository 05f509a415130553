"""Main-text extraction: gradient-boosted trees over DOM-node features and hierarchical decoding.

A page is read tag by tag in time linear in its length: a tag ends at the first ``>`` outside quoted values; a ``<`` that
meets another one or the page's end first is text.  The page becomes block elements (inline elements belong to their
block's text, but those marked as advertising are nodes; a run of text directly between blocks is a node of its own).  Every node gets features: the learned log-odds of its tag and attribute tokens and of its
nearest marked ancestor, depth, position and number of siblings, text length and link density, and the same measures of
its whole subtree.  Boosted regression trees, trained here on generated labelled pages, give each node's probability of
being main text.

Decoding chooses one of three labels for every node - main, boilerplate, or wrapper (holds both) - with the largest sum
of log-probabilities under the rule that below boilerplate everything is boilerplate and below main nothing is wrapper.
So an ancestor and a descendant never contradict each other, and an advert inside an article can still be left out.
The text of main nodes is returned, one line per block.

Defined cases: a null or empty html gives an empty text; a page without any block element is its text; markup that never closes ends with the page; a marked inline element ends with its block; unknown character
references stay as they are; repeated rows are extracted separately; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .tables import bounded

INLINE = set("math mi mo mn ms mrow mtext mfrac msqrt msub msup msubsup semantics a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template iframe svg select textarea head title button".split())
#: Words of attributes that make an inline element a node of its own.
ADVERTISING = set("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo banner".split())
RAW = set("script style textarea title noscript iframe template".split())
#: An opening tag on the left ends an open element of the kinds on the right, up to the nearest border.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
BORDER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

NAME = re.compile(r"/?[a-zA-Z][^\s/><]*")
STOP = re.compile(r"[<>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|data-component)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
PIECE = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    marks: tuple[str, ...]
    parent: int
    depth: int
    place: int
    text: str = ""
    linked: int = 0
    line: int = -1  # texts of one line are put together again
    children: list[int] = field(default_factory=list)


def _marks(attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return ()
    found = []
    for _, value in ATTRIBUTE.findall(attributes):
        found += PIECE.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
    return tuple(dict.fromkeys(found))


class Tags:
    """Tags of a page one after another; every ``find`` that fails is remembered, so nothing is searched twice."""

    def __init__(self, page: str):
        self.page, self.absent = page, dict.fromkeys(("-->", "]]>", ">", '"', "'"), len(page) + 1)

    def find(self, what: str, at: int) -> int:
        if at >= self.absent[what]:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent[what] = at
        return found

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes begin at ``at``; -1 if it has none."""
        while m := STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            if m[0] == "<":
                return -1
            close = self.find(m[0], m.end())
            if close < 0:  # a quote that never closes is a character like others
                close = m.start()
            at = close + 1
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, kind, name, attributes) of what is no text; kind is '', '/', 'cdata' or 'note'."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                close = self.find("-->", at + 4)
                new = close + 3 if close >= 0 else len(page)
                yield at, new, "note", "", ""
            elif page.startswith("<![CDATA[", at):
                close = self.find("]]>", at + 9)
                new = close + 3 if close >= 0 else len(page)
                yield at, new, "cdata", "", page[at + 9 : close if close >= 0 else len(page)]
            elif page.startswith(("<!", "<?"), at):
                close = self.find(">", at)
                new = close + 1 if close >= 0 else at + 1
                if close >= 0:
                    yield at, new, "note", "", ""
            else:
                m = NAME.match(page, at + 1)
                close = self.end(m.end()) if m else -1
                new = close + 1 if close >= 0 else at + 1
                if m and close >= 0:
                    name = m[0].lower()
                    jump = yield at, new, name[0] if name[0] == "/" else "", name.lstrip("/"), page[m.end() : close]
                    if jump is not None:
                        new = jump
                        yield at, new, "note", "", ""  # the answer to send()
            at = new


def parse(page: str) -> list[Node]:
    """Nodes in page order; node 0 is the page."""
    nodes = [Node("#page", (), -1, 0, 0)]
    open_: list[int] = [0]  # elements
    where: dict[str, list[int]] = {}  # places of each tag in open_
    pieces: list[str] = []
    links = linked = silent = line = at = 0

    def flush(ends: bool = True) -> None:
        nonlocal linked, line
        if pieces:
            text = SPACE.sub(" ", html_lib.unescape("".join(pieces)))
            pieces.clear()
            if text.strip():
                own = nodes[open_[-1]]
                child = Node("#text", (), open_[-1], own.depth + 1, len(own.children), text, linked, line)
                own.children.append(len(nodes))
                nodes.append(child)
        linked = 0
        line += ends

    def close(place: int, ends: bool = True) -> None:
        nonlocal silent
        flush(ends)
        for n in open_[place:]:
            silent -= nodes[n].tag in SILENT
            where[nodes[n].tag].pop()
        del open_[place:]

    def open_one(tag: str, marks: tuple[str, ...]) -> None:
        nonlocal silent
        own = nodes[open_[-1]]
        nodes.append(Node(tag, marks, open_[-1], own.depth + 1, len(own.children)))
        own.children.append(len(nodes) - 1)
        where.setdefault(tag, []).append(len(open_))
        open_.append(len(nodes) - 1)
        silent += tag in SILENT

    def last(tags: set[str]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at and not silent:
            pieces.append(page[at:end])
            linked += links and end - at

    tokens = Tags(page).__iter__()
    for start, end, kind, tag, rest in tokens:
        text_to(start)
        at = end
        if kind == "note":
            continue
        if kind == "cdata":
            if not silent:
                pieces.append(html_lib.escape(rest))
            continue
        closing = kind == "/"
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                links = max(0, links - 1) if closing else links + 1
            if closing and where.get(tag):  # only marked ones are open, and nothing but inline elements inside them
                close(where[tag][-1], ends=False)
            elif not closing and rest and not silent and not where.get(tag) and not ADVERTISING.isdisjoint(marks := _marks(rest)):
                flush(ends=False)
                open_one(tag, marks)
            continue
        if closing:
            if where.get(tag):
                close(where[tag][-1])
                links = 0
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        while nodes[open_[-1]].tag in INLINE:  # a block ends a marked inline element
            close(len(open_) - 1)
        if tag in ENDS and (place := last(ENDS[tag])) > last(BORDER[tag]):
            close(place)
        if nodes[open_[-1]].tag == "p":  # a block ends an open paragraph
            close(len(open_) - 1)
        if rest.endswith("/") and tag in ("svg", "iframe", "template", "path"):
            continue
        open_one(tag, _marks(rest))
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = found.start() if found else len(page)
            tokens.send(at)
    text_to(len(page))
    flush()
    return nodes


def lines(nodes: list[Node], chosen: list[bool]) -> str:
    """The chosen texts, one line for each run of text."""
    runs: dict[int, list[str]] = {}
    for x, yes in zip(nodes, chosen, strict=True):
        if yes and x.text:
            runs.setdefault(x.line, []).append(x.text)
    found = (SPACE.sub(" ", "".join(run)).strip() for run in runs.values())
    return "\n".join(x for x in found if x)


FEATURES = 18
#: Tags of single blocks; what encloses them tells more about a text than they do.
BLOCK_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr table pre blockquote".split())


def features(nodes: list[Node], odds: dict[str, float]) -> np.ndarray:
    n = len(nodes)
    out = np.zeros((n, FEATURES))
    length, link, count = [0] * n, [0] * n, [1] * n
    stops = [0] * n
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        length[i] += len(x.text)
        link[i] += x.linked
        stops[i] += x.text.count(". ") + x.text.endswith((".", "!", "?"))
        if x.parent >= 0:
            for total in (length, link, count, stops):
                total[x.parent] += total[i]
    marked, tagged = [0.0] * n, [0.0] * n
    whole = max(length[0], 1)
    for i, x in enumerate(nodes):
        own = sum(odds.get(f".{m}", 0.0) for m in x.marks)
        tag = odds.get(x.tag, 0.0)
        up = x.parent
        marked[i] = own if own else (marked[up] if up >= 0 else 0.0)
        tagged[i] = tag if x.tag in odds and x.tag[0] != "#" and x.tag not in BLOCK_TAGS and abs(tag) > 2 else (tagged[up] if up >= 0 else 0.0)
        brothers = len(nodes[up].children) if up >= 0 else 1
        out[i] = (
            own, tag, marked[up] if up >= 0 else 0.0, tagged[up] if up >= 0 else 0.0, x.depth, x.place / brothers, min(brothers, 50), min(len(x.children), 50),
            min(len(x.text), 2000), x.linked / max(len(x.text), 1), min(length[i], 20000), link[i] / max(length[i], 1), length[i] / whole, length[i] / count[i],
            min(count[i], 200), stops[i] / max(length[i], 1) * 100, len(x.marks), length[up] / whole if up >= 0 else 1.0,
        )
    return out


@dataclass
class Trees:
    """Boosted trees of fixed depth: at each inner node x[feature] > cut goes right."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(len(self.leaf)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            total += self.leaf[t, at - (2**self.depth - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, smooth: float = 1.0) -> Trees:
    """Logistic gradient boosting on binned features."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, 2**depth))
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    score = np.full(len(y), bias)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            here = np.flatnonzero(at == node)
            best = (1e-9, 0, np.inf)
            if len(here) > 1:
                g, h = grad[here].sum(), hess[here].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[here, f], weights=grad[here], minlength=len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[here, f], weights=hess[here], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + smooth) + (g - gl) ** 2 / (h - hl + smooth) - g**2 / (h + smooth)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(c[k]))
            feature[t, node], cut[t, node] = best[1], best[2]
            at[here] = 2 * node + 1 + (x[here, best[1]] > best[2])
        at -= inner
        g, h = np.bincount(at, weights=grad, minlength=2**depth), np.bincount(at, weights=hess, minlength=2**depth)
        leaf[t] = rate * g / (h + smooth)
        score += leaf[t, at]
    return Trees(feature, cut, leaf, depth, bias)


# Generated training pages -------------------------------------------------------------------------------------------

#: Tags and attribute values seen around main text and around everything else.
MAIN_SHELLS = "article|main|div class=content|div id=main-content|div class=post-body|div class=entry-content|section class=story|div class=article-text|div itemprop=articleBody|div role=main".split("|")
OTHER_SHELLS = (
    "nav|nav class=menu|ul class=menu|div class=navigation|div class=navbar|header|header class=site-header|div id=header|footer|footer class=site-footer|div id=footer|aside|aside class=sidebar|div class=sidebar|"
    "div class=ad|div class=ads|div class=advert|div class=advertisement|div class=banner|div class=promo|div class=sponsored|div class=cookie-notice|div class=notice|div class=cookie-banner|div id=consent|div class=alert|"
    "div class=popup|div class=modal|form|form class=search|form class=newsletter|div class=newsletter-signup|div class=subscribe|section class=comments|div id=comments|div class=comment|ol class=comment-list|div class=reader-comments|"
    "div class=disqus|div class=related|div class=recommended|div class=share|div class=social-links|div class=breadcrumbs|div class=pagination|div class=tags|div class=widget|div class=copyright|div class=toolbar"
).split("|")
INLINE_OTHER = "ins class=ad|ins class=adsbygoogle|span class=advert|span class=ad|span class=sponsored|a class=promo|em class=advertisement|span id=ad-inline|a class=ad-link|b class=banner".split("|")
WRAPPERS = "div|div class=page|div id=wrapper|div class=container|div class=row|section|div class=layout|div id=root".split("|")
INNER = "div class=ad|aside|div class=share|div class=related|div class=notice|form class=newsletter|div class=promo|div class=advert|nav class=toc|section class=comments|footer|header".split("|")


def labelled_page(rnd: random.Random) -> tuple[str, set[str]]:
    """A page and the words (each used once) of its main text."""
    number, main = [0], set()

    def words(n: int, is_main: bool) -> str:
        out = []
        for _ in range(n):
            number[0] += 1
            word = f"{''.join(rnd.choice(['ka', 'to', 'mi', 'el', 'ra', 'ne', 'su']) for _ in range(rnd.randint(1, 3)))}{number[0]}"
            out.append(word + rnd.choice(["", "", "", "", ",", "."]))
            if is_main:
                main.add(word)
        return " ".join(out) + rnd.choice([".", ".", "", "!"])

    def shell(kind: str, inside: str) -> str:
        tag, _, attribute = kind.partition(" ")
        name, _, value = attribute.partition("=")
        return f"<{tag}{f' {name}={chr(34)}{value}{chr(34)}' if name else ''}>{inside}</{tag}>"

    def blocks(n: int, is_main: bool) -> list[str]:
        made = []
        for _ in range(n):
            size = rnd.choice([1, 3, 8, 20, 40, 80, 160])
            tag = rnd.choice(["p", "p", "p", "p", "p", "p", "h2", "h3", "h4", "li", "blockquote", "pre", "td"])
            text = words(size, is_main)
            if rnd.random() < 0.2:
                text = f'<a href="/x">{text}</a>' if rnd.random() < 0.3 else f"<b>{text}</b>"
            if is_main and rnd.random() < 0.04:
                text += shell(rnd.choice(INLINE_OTHER), words(rnd.choice([2, 6, 20]), False)) + words(rnd.choice([1, 9, 30]), True)
            made.append({"li": f"<ul><li>{text}</ul>", "td": f"<table><tr><td>{text}</table>"}.get(tag, f"<{tag}>{text}</{tag}>"))
        return made

    def other() -> str:
        kind = rnd.choice(OTHER_SHELLS)
        if kind.startswith(("nav", "ul")) or rnd.random() < 0.35:
            inside = "".join(f'<li><a href="/{i}">{words(rnd.randint(1, 3), False)}</a></li>' for i in range(rnd.randint(2, 9)))
            inside = inside if kind.startswith("ul") else f"<ul>{inside}</ul>"
        elif rnd.random() < 0.5:
            inside = words(rnd.choice([2, 6, 12, 30]), False)
        else:
            inside = "".join(blocks(rnd.randint(1, 5), False))
        if rnd.random() < 0.4 and not kind.startswith(("ul", "ol")):  # boxes have headings too
            tag = rnd.choice(["h1", "h2"]) if "header" in kind else rnd.choice(["h2", "h3", "h4"])
            inside = f"<{tag}>{words(rnd.randint(1, 6), False)}</{tag}>{inside if rnd.random() < 0.7 else ''}"
        return shell(kind, inside)

    body = blocks(rnd.choice([1, 2, 4, 8, 15]), True)
    if rnd.random() < 0.8:
        tag = rnd.choice(["h1", "h1", "h1", "h2", "h3"])
        body.insert(0, f"<{tag}>{words(rnd.randint(1, 9), True)}</{tag}>")
    for _ in range(rnd.choice([0, 0, 1, 2, 3])):
        kind = rnd.choice(INNER if rnd.random() < 0.5 else OTHER_SHELLS)
        body.insert(rnd.randint(0, len(body)), shell(kind, rnd.choice([words(rnd.randint(2, 25), False), "".join(blocks(2, False))])))
    text = "".join(body)
    text = shell(rnd.choice(MAIN_SHELLS), text) if rnd.random() < 0.85 else text
    if rnd.random() < 0.2:
        text = shell("main", text)
    page = "".join([*(other() for _ in range(rnd.randint(0, 4))), text, *(other() for _ in range(rnd.randint(0, 4)))])
    for _ in range(rnd.choice([0, 0, 1, 2])):
        page = shell(rnd.choice(WRAPPERS), page)
    if rnd.random() < 0.5:
        page = other() + page + other()
    return f"<!DOCTYPE html><html><head><title>{words(4, False)}</title><style>p {{}}</style></head><body>{page}</body></html>", main


@cache
def trained(pages: int = 800, seed: int = 11) -> tuple[dict[str, float], Trees]:
    """Token log-odds and trees, fitted on generated pages."""
    rnd = random.Random(seed)
    parsed, truths = [], []
    counts: dict[str, list[float]] = {}
    for _ in range(pages):
        page, main = labelled_page(rnd)
        nodes = parse(page)
        share = [0.0] * len(nodes)
        size = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            found = re.findall(r"[a-z]+\d+", nodes[i].text)
            size[i] += len(found)
            share[i] += sum(w in main for w in found)
            if nodes[i].parent >= 0:
                size[nodes[i].parent] += size[i]
                share[nodes[i].parent] += share[i]
        truth = [size[i] > 0 and share[i] >= 0.6 * size[i] for i in range(len(nodes))]
        for x, y in zip(nodes, truth, strict=True):
            for key in (x.tag, *(f".{m}" for m in x.marks)):
                counts.setdefault(key, [0.0, 0.0])[y] += 1
        parsed.append(nodes)
        truths += truth
    base = np.log((sum(c[1] for c in counts.values()) + 1) / (sum(c[0] for c in counts.values()) + 1))
    odds = {k: float(np.log((c[1] + 0.5) / (c[0] + 0.5)) - base) for k, c in counts.items() if sum(c) >= 3}
    x = np.concatenate([features(nodes, odds) for nodes in parsed])
    return odds, boost(x, np.array(truths, dtype=float))


STRUCTURAL = {"#page", "html", "body"}
#: Log-probability lost where boilerplate begins inside main text, at an element whose own tag or attributes speak for
#: it, and at any other: single odd-looking paragraphs stay.
MARKED_SWITCH, PLAIN_SWITCH = 0.0, 6.0


def decode(nodes: list[Node], x: np.ndarray, log_odds: np.ndarray) -> list[bool]:
    """Which nodes are main text; x are their features."""
    n = len(nodes)
    switch = np.where((x[:, 0] < -1.0) | (x[:, 1] < -2.0), MARKED_SWITCH, PLAIN_SWITCH)
    log_main, log_other = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    best = np.zeros((n, 3))  # main, boilerplate, wrapper
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        main, other, wrap = log_main[i], log_other[i], log_other[i]
        if x.tag in SILENT:
            main = wrap = -1e9
        if not x.children:
            wrap = -1e9
        for c in x.children:
            main += max(best[c][0], best[c][1] - switch[c])
            other += best[c][1]
            wrap += best[c].max()
        if x.tag in STRUCTURAL:
            other = -1e6
            wrap = max(wrap, main - 1.0)
        best[i] = main, other, wrap
    label = [2] * n
    for i, x in enumerate(nodes):
        up = label[x.parent] if x.parent >= 0 else 2
        if up == 0:
            label[i] = 0 if best[i][0] >= best[i][1] - switch[i] else 1
        else:
            label[i] = 1 if up == 1 else max((0, 1, 2), key=lambda k: best[i][k])
    return [k == 0 for k in label]


def main_texts(pages: list[str | None], odds: dict[str, float], trees: Trees) -> list[str]:
    """Main text of every page; the nodes of all pages are scored together."""
    parsed = [parse(p) if p else [] for p in pages]
    sizes = [len(x) for x in parsed]
    if not sum(sizes):
        return [""] * len(pages)
    measures = np.concatenate([features(x, odds) for x in parsed if x])
    scores = trees(measures)
    out, at = [], 0
    for nodes, n in zip(parsed, sizes, strict=True):
        if all(x.tag[0] == "#" for x in nodes):  # a page without markup is its text
            out.append(lines(nodes, [True] * n))
            at += n
            continue
        chosen = decode(nodes, measures[at : at + n], scores[at : at + n]) if n else []
        out.append(lines(nodes, chosen))
        at += n
    return out


SLICE = 512 << 10  # bytes of pages that are scored together


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, trees = model.value
        for batch in batches:
            for lo, hi, _ in tc.chunks(batch.column(2), SLICE):
                part = batch.slice(lo, hi - lo)
                texts = main_texts(part.column(2).to_pylist(), odds, trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return bounded(pages).select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
