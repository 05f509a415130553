import random
import re
import time

import pytest
from conflux.llm import html, queries


def text_of(page):
    return html.main_texts([page], *html.trained())[0]


def test_query_on_the_articles(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op6_html(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [html.SPACE.sub(" ", html.html_lib.unescape(re.sub(r"<[^>]*>", " ", b).replace(" <", "<"))).strip() for b in re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", inner)]
        assert (r.text, r.url, r.n_chars) == ("\n".join(b for b in blocks if b), pages[r.page_id].url, len(r.text))


def test_held_out_generated_pages():
    rnd = random.Random(12345)
    right = 0
    for _ in range(150):
        page, main = html.labelled_page(rnd)
        right += set(re.findall(r"[a-z]+\d+", text_of(page))) == main
    assert right >= 147


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; bare \n text", "plain & bare text"),
        ("<p>one</p>\n<p> two  <b>bo</b>ld<br>x &nbsp; y &eacute;&#233;&bogus; </p>", "one\ntwo bold x y éé&bogus;"),
        ("<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T</h1><p>Unclosed <p>Next<script>var t='</p>'</script><style>p{}</style></article><footer>(c)</footer>", "T\nUnclosed\nNext"),
        ("<article><!-- <p>no</p> --><p title='a > b'>yes</p><div class=\"ad\">Buy</div><form><p>Sign up</p></form></article><div id=comments><p>Great post, thanks!</p></div>", "yes"),
        ("<article><p>never ends", "never ends"),
        ('<article><h1>T</h1><p>One <ins class="ad">Buy now cheap</ins> two.</p><p>three <span class="advert">click <b>here</b> now</span>four</p></article>', "T\nOne two.\nthree four"),
        ("<article><p>a <a class='header-link' href=x>keep</a> b, x<y and z.</p></article>", "a keep b, x<y and z."),
        ("<article><p>Area <math><mi>x</mi><mo>+</mo><mn>2</mn></math> ok</p><object><p>fallback text of it</p></object></article>", "Area x+2 ok\nfallback text of it"),
        ("<header><h1>Site</h1></header><aside>Side bar text</aside><main><p>Main part of it.</p></main><div class='cookie-notice'>We use cookies.</div>", "Main part of it."),
    ],
)
def test_cases(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    "page",
    ["<b" * 500_000, "<a " * 340_000, '<a "' * 250_000, "<a '" * 125_000 + '<a "' * 125_000, '<a b="x>" ' * 100_000, "<div>" * 5000 + "</p>" * 200_000, "<div>" * 60_000 + "</span>" * 60_000,
     "<ul><li><ol>" + "<div>" * 20_000 + "<li></li>" * 50_000, "<" * 1_000_000, "<!--" * 250_000, "<script>" * 120_000, "</script" * 120_000, '<p class="' * 100_000, "<ins class=ad><div>" * 20_000],
    ids=lambda page: page[:12],
)
def test_hostile_pages_take_linear_time(page):
    def seconds(part):
        start = time.process_time()
        html.main_texts([part], *html.trained())
        return time.process_time() - start

    html.trained()
    assert seconds(page) < 12 * seconds(page[: len(page) // 4]) + 1  # quadratic would be 16 times


def test_decoding_never_contradicts_ancestors():
    import numpy as np

    rnd = np.random.default_rng(5)
    page, _ = html.labelled_page(random.Random(2))
    nodes = html.parse(page)
    x = html.features(nodes, html.trained()[0])
    for _ in range(50):
        chosen = html.decode(nodes, x, rnd.normal(scale=4, size=len(nodes)))
        for i, node in enumerate(nodes):
            if chosen[i]:  # between two main nodes there is no boilerplate
                up, gap = node.parent, False
                while up >= 0:
                    gap |= not chosen[up]
                    assert not (gap and chosen[up])
                    up = nodes[up].parent


def test_table_edge_cases(spark):
    long = "<article>" + "<p>word word word</p>" * 30_000 + "</article>"
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>a</p>", "x"), (2, "u", long, "x"), (3, "u", "<div>" * 3000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extracted(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got)[:4] == [("1", 0), ("1", 0), ("2", 15 * 30_000 - 1), ("3", got[-1].n_chars)]
    assert html.extracted(pages.limit(0)).count() == 0
