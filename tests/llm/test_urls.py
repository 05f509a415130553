import re

from conflux.llm import queries, urls


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
    score = sum(urls.weights()[b] for b in urls.trigram_buckets(host, path)) if host else 0
    return host, path, rule, verdict or ("block" if score > 0 else "allow"), score


ODD = [
    None, "", "no scheme", "http://", "http:///p", "HTTP://EXAMPLE.Com/en/7x?a#b", "http://com/en/", "http://xcom/en/", "https://a.example.net/de/8/de", "https://example.net/de/7",
    "http://a.org?x://y/es/", "http://É.org/es/ü", "ftp://h#f", "x://y://z/q", "http://net/de", "http://b.example.com/en/71", "http://s/" + "é" * 20_000, "http://new\nline.org/a\nb", "http://😀.com/en/",
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*ODD, ODD[5]])], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.score) for r in urls.judged(pages).collect()}
    assert got == {i: judge(u) for i, u in enumerate([*ODD, ODD[5]])}
    assert urls.judged(pages.limit(0)).count() == 0


def test_query_matches_definition(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.page_id: judge(r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.score) for r in queries.op4_urls(spark, sf).collect()} == want


def test_classifier_learns_its_table():
    rows = urls.labelled_urls()
    right = sum((sum(urls.weights()[b] for b in urls.trigram_buckets(h, p)) > 0) == bool(bad) for h, p, bad in rows)
    assert right == len(rows)
    held = [("mega-casino.example.com", "/en/5", 1), ("cheap-viagra-pills.test", "/x", 1), ("spam-links.example.org", "/de/9", 1), ("city-museum.example.com", "/en/5", 0), ("garden-photos.example.net", "/fr/1", 0)]
    assert all((sum(urls.weights()[b] for b in urls.trigram_buckets(h, p)) > 0) == bool(bad) for h, p, bad in held)


def test_plan_is_native(spark):
    plan = queries.op4_urls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
