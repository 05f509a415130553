import zlib

import numpy as np
import pyarrow as pa
from conflux.llm import langid, queries
from conflux.llm import textcore as tc


def brute_posteriors(scores, transitions, start):
    """By enumeration of all label sequences."""
    n, k = scores.shape
    total = np.zeros((n, k))
    for code in range(k**n):
        path = [code // k**t % k for t in range(n)]
        p = np.exp(start[path[0]] + sum(scores[t, path[t]] for t in range(n)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t in range(n):
            total[t, path[t]] += p
    return total / total.sum(axis=1, keepdims=True)


def test_forward_backward_is_exact():
    rnd = np.random.default_rng(3)
    scores, lengths = rnd.normal(size=(4, 5, 3)), np.array([5, 4, 2, 1])
    transitions, start = rnd.normal(size=(3, 3)), rnd.normal(size=3)
    post, pairs = langid.forward_backward(scores, lengths, transitions, start)
    for i, n in enumerate(lengths):
        np.testing.assert_allclose(post[i, :n], brute_posteriors(scores[i, :n], transitions, start), atol=1e-9)
    assert abs(pairs.sum() - (lengths - 1).sum()) < 1e-9


def test_chain_goes_on_over_the_borders_of_runs(monkeypatch):
    rnd = np.random.default_rng(6)
    labels, text = ["aa", "bb", "cc"], [" ".join(rnd.choice(["ka", "to", "schu", "eux"], size=n)) for n in (9, 1, 4, 12, 0, 8)]
    model = langid.Model(labels, rnd.normal(size=(langid.FEATURES, 3)).astype(np.float32), rnd.normal(size=(3, 3)) * 2, rnd.normal(size=3))
    _, _, texts = next(tc.chunks(pa.array(text)))
    w = tc.words(texts)
    monkeypatch.setattr(langid, "RUN", 4)
    got = langid.word_posteriors(texts, w, model)
    scores = langid.Emitter(texts, w).scores(model.weights).astype(np.float64)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if a < b <= a + 9:
            np.testing.assert_allclose(got[a:b], brute_posteriors(scores[a:b], model.transitions, model.start), atol=1e-6)
    monkeypatch.setattr(langid, "RUN", 100)
    np.testing.assert_allclose(got, langid.word_posteriors(texts, w, model), atol=1e-6)


def test_repeated_ids_teach_once(spark, monkeypatch):
    rows, kinds = sample(np.random.default_rng(2), 30)
    taught = []
    monkeypatch.setattr(langid, "train", lambda samples, **kw: taught.append(samples))
    rows = [(i, t, lang) for i, (t, lang) in enumerate(rows)] + [(200, f"text {i}", "aa") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(docs)
    assert len(taught[0]) <= 91
    langid.fit(docs, in_all=12)
    assert len(taught[1]) == 12 and {lang for _, lang in taught[1]} == {"aa", "bb", "cc"}
    langid.fit(docs, size=3000)
    sizes = [len(t.encode()) for t, _ in taught[2]]
    assert 3000 - max(len(t.encode()) for t, _ in taught[0]) < sum(sizes) <= 3000 and {lang for _, lang in taught[2]} == {"aa", "bb", "cc"}


def test_held_out_accuracy_of_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_langid(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def words_of(n, parts, rnd):
    return " ".join("".join(rnd.choice(parts, size=rnd.integers(1, 4))) for _ in range(n))


def sample(rnd, n=60):
    kinds = {"aa": ["ka", "to", "mi"], "bb": ["schu", "lich", "ver"], "cc": ["éa", "eux", "ou"]}
    return [(words_of(40, parts, rnd), lang) for lang, parts in kinds.items() for _ in range(n)], kinds


def test_words_of_code_switched_text():
    rnd = np.random.default_rng(1)
    rows, kinds = sample(rnd)
    model = langid.train(rows)
    text = " ".join([words_of(30, kinds["aa"], rnd), words_of(30, kinds["cc"], rnd), words_of(30, kinds["bb"], rnd)])
    _, _, texts = next(tc.chunks(pa.array([text])))
    post = langid.word_posteriors(texts, tc.words(texts), model)
    truth = np.repeat([0, 2, 1], 30)
    assert (post.argmax(axis=1) == truth).mean() > 0.95


def test_edge_cases(spark):
    rnd = np.random.default_rng(2)
    rows, kinds = sample(rnd, 30)
    train = [(i, t, lang, "s") for i, (t, lang) in enumerate(rows)]
    odd = [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "123 !!! \n", "cc", "s"), (903, "×÷ 12", None, "s"), (None, words_of(9, kinds["aa"], rnd), "aa", "s")]
    odd += [(904, words_of(150_000, kinds["bb"], rnd), None, "s"), (905, "ka", None, "s"), (905, "ka", None, "s"), (906, "1 ü 2", None, None)]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    assert model.labels == ["aa", "bb", "cc"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predicted(docs, model).collect()]
    by = dict((d, (p, s)) for d, p, s in got)
    assert len(got) == len(train) + len(odd)
    assert all(by[d] == ("und", 0.0) for d in (900, 901, 902, 903))
    assert by[904][0] == "bb" and by[None][0] == "aa" and by[906][0] != "und"
    kept = langid.known(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == len(got) - 4


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "ab cd", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.predicted(docs, langid.fit(docs)).collect()] == [("und", 0.0)]
    assert langid.predicted(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_language_with_long_texts_only(spark):
    rnd = np.random.default_rng(4)
    rows, kinds = sample(rnd, 30)
    rows = [(i, t, lang) for i, (t, lang) in enumerate(rows) if lang != "bb"] + [(i, words_of(5_000, kinds["bb"], rnd), "bb") for i in range(500, 504)]
    assert min(len(t) for _, t, lang in rows if lang == "bb") > langid.LONGEST
    docs = spark.createDataFrame([*rows, (900, words_of(30, kinds["bb"], rnd), None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.labels == ["aa", "bb", "cc"]
    assert [r.lang_pred for r in langid.predicted(docs.where("doc_id = 900"), model).collect()] == ["bb"]
