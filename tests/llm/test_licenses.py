import re

import pyarrow as pa
import pytest
from conflux.llm import licenses, queries
from conflux.llm import textcore as tc

SHORT = [t for _, kind, t in licenses.TEMPLATES if kind == "short"]


def found(text):
    _, _, texts = next(tc.chunks(pa.array([text])))
    index = licenses.Index()
    return [(licenses.TEMPLATES[t][0], licenses.TEMPLATES[t][1], m, text.encode()[a:b].decode()) for _, t, m, a, b, _ in licenses.matches(texts, index)]


def brute_score(template, text, low, high):
    """Best local alignment score inside the band, by the full table."""
    table = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
    best = 0
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            if low <= j - i <= high:
                options = [0, table[i - 1][j - 1] + (1 if template[i - 1] == text[j - 1] else -1)]
                if j - (i - 1) <= high:
                    options.append(table[i - 1][j] - 1)
                if j - 1 - i >= low:
                    options.append(table[i][j - 1] - 1)
                table[i][j] = max(options)
                best = max(best, table[i][j])
    return best


def test_alignment_matches_full_table():
    import random

    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.randint(1, 4) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        low = rnd.randint(-3, 1)
        high = low + rnd.randint(0, 5)
        score, matched, first, past = licenses.align(a, b, low, high)
        assert score == brute_score(a, b, low, high)
        assert matched <= past - first


def test_query_finds_every_planted_line(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_licenses(spark, sf).collect()
    spans = sorted((r.doc_id, r.first, docs[r.doc_id][r.first : r.past]) for r in got if r.template == "short")
    want = sorted((d, m.start(), m[0].rstrip(".")) for d, t in docs.items() for s in SHORT for m in re.finditer(re.escape(s), t))
    assert spans == want
    assert all(0.8 <= r.coverage <= 1 and r.matched <= r.template_words for r in got)


@pytest.mark.parametrize("number", range(len(licenses.TEMPLATES)))
def test_edited_templates_are_found(number):
    license_, kind, text = licenses.TEMPLATES[number]
    around = f"Some words before it. {text.upper()} And é others after, quite a few."
    hits = [h for h in found(around) if h[:2] == (license_, kind)]
    assert len(hits) == 1 and hits[0][2] == len(re.findall(r"[0-9A-Za-z]+", text))
    if len(text.split()) > 20:
        words = text.split()
        edited = " ".join([*words[:9], "inserted", *words[9:14], *words[15:]])
        assert [h[:2] for h in found(edited) if h[0] == license_ and h[1] == kind] == [(license_, kind)]
    assert not [h for h in found(" ".join(text.split()[: len(text.split()) // 2])) if h[:2] == (license_, kind)]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "the"), (4, SHORT[0]), (4, SHORT[0]), (None, f"ü {SHORT[1]}\n{SHORT[1]}"), (5, "filler words " * 100_000 + SHORT[2])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted((str(r.doc_id), r.license, r.first) for r in licenses.scanned(docs).collect())
    assert got == [("4", "MIT", 0), ("4", "MIT", 0), ("5", "GPL-3.0", 1_300_000), ("None", "Apache-2.0", 2), ("None", "Apache-2.0", 3 + len(SHORT[1]))]
    assert licenses.scanned(docs.limit(0)).count() == 0


def edited(words):
    """Every text that is one substituted, inserted or dropped word away."""
    for i in range(len(words)):
        yield [*words[:i], "changed", *words[i + 1 :]]
        yield [*words[:i], *words[i + 1 :]]
    for i in range(1, len(words)):
        yield [*words[:i], "added", *words[i:]]


@pytest.mark.parametrize("number", [t for t, x in enumerate(licenses.TEMPLATES) if x[1] == "short"])
def test_one_edit_of_a_short_template(number):
    words = [x.lower() for x in re.findall(r"[0-9A-Za-z]+", licenses.TEMPLATES[number][2])]
    for text in edited(words):
        code = {x: i for i, x in enumerate([*words, *text, "before", "after"])}
        whole = [code[x] for x in ["before", *text, "after"]]
        matched = licenses.align([code[x] for x in words], whole, -len(words), len(whole))[1]  # the full table
        hits = [h for h in found(" ".join(["Before", *text, "after"])) if h[:2] == licenses.TEMPLATES[number][:2]]
        assert [h[2] for h in hits] == ([matched] if matched >= licenses.COVERAGE * len(words) else []), text


def test_edited_notices_from_the_review():
    for text, matched in (("Released under the MIT Licence", 4), ("Released under an MIT License", 4), ("Released under the modified MIT License", 5)):
        assert [h[:3] for h in found(f"Here. {text}. There.")] == [("MIT", "short", matched)]


def test_an_edit_in_every_fifth_word_of_a_long_template():
    for license_, kind, text in licenses.TEMPLATES:
        if kind != "short":
            words = [x.lower() for x in re.findall(r"[0-9A-Za-z]+", text)]
            changed = ["changed" if i % 5 == 4 else x for i, x in enumerate(words)]
            matched = licenses.align(words, changed, -len(words), len(words))[1]  # the full table
            want = [(license_, kind, matched)] if matched >= licenses.COVERAGE * len(words) else []
            assert [h[:3] for h in found(" ".join(changed)) if h[1] != "short"] == want


def test_an_edited_notice_beside_a_whole_one():
    hits = found("Released under the MIT licence. Released under the MIT License. Released under a MIT License.")
    assert [h[:3] for h in hits] == [("MIT", "short", 4), ("MIT", "short", 5), ("MIT", "short", 4)]
