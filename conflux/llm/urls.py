"""URL filters: host and path rules, and logistic regression on hashed character n-grams, in DataFrame operations only.

The classifier is fitted once, on the driver, from the small labelled table below: L2-regularised logistic regression by
full-batch gradient descent over hashed character trigrams of ``^host$path``.  Weights are rounded to whole numbers, so
that a url's score is an exact integer wherever it is computed; a url is blocked when its score is above 0.  Scoring is
one expression per row (no shuffle): code points of the url, then a sum of table entries.

A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest rule wins, and then
the verdict is the rule's.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed by score 0;
repeated rows are judged separately; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
FACTOR = 31
UNIT = 1000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: The labelled table: hosts (and paths) of the two kinds.
BAD_HOSTS = (
    "spam-farm cheap-pills casino-bonus free-poker online-casino hot-singles adult-dating xxx-videos buy-viagra pills-online "
    "link-farm spam-links payday-loans quick-loans fake-watches replica-bags win-money lottery-winner crack-download warez-keygen "
    "free-iphone click-bait bet-now sports-betting cheap-meds cheap-cialis porn-tube sex-cams seo-links get-rich"
).split()
GOOD_HOSTS = (
    "daily-news city-library open-source cooking-notes travel-diary garden-help history-archive science-review book-club music-school "
    "weather-report local-sports public-health family-recipes math-forum art-museum film-critic nature-photos code-journal health-advice "
    "university law-review chess-club bird-watching farm-museum writing-tips language-course space-agency river-walks old-maps"
).split()
BAD_PATHS = ("/win/free/bonus", "/buy/cheap/pills", "/xxx/video")
GOOD_PATHS = ("/en/12", "/articles/2019/spring", "/de/345.html", "/fr/7/", "/es/88")
PREFIXES = ("", "www.", "blog.", "m.")
SUFFIXES = (".example.com", ".example.net", ".example.org", ".test")


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 if bad) of every labelled url."""
    rows = []
    for bad, hosts, own in ((1, BAD_HOSTS, BAD_PATHS), (0, GOOD_HOSTS, GOOD_PATHS)):
        for i, host in enumerate(hosts):
            for j in range(4):
                paths = own + GOOD_PATHS if bad else own
                rows.append((PREFIXES[(i + j) % 4] + host + SUFFIXES[j], paths[(i + 3 * j) % len(paths)], bad))
    return rows


def trigram_buckets(host: str, path: str) -> list[int]:
    codes = [ord(c) for c in f"^{host}${path}"]
    return [((a * FACTOR + b) * FACTOR + c) % BUCKETS for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]


@cache
def weights(rounds: int = 120, step: float = 0.5, decay: float = 1e-3) -> list[int]:
    """Whole-number weights of all buckets."""
    rows = [(trigram_buckets(h, p), y) for h, p, y in labelled_urls()]
    w = [0.0] * BUCKETS
    for _ in range(rounds):
        grad = [0.0] * BUCKETS
        for grams, y in rows:
            miss = y - 1 / (1 + math.exp(-sum(w[g] for g in grams)))
            for g in grams:
                grad[g] += miss
        w = [x + step * (g / len(rows) - decay * x) for x, g in zip(w, grad, strict=True)]
    return [round(x * UNIT) for x in w]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def score_of(host: Column, path: Column) -> Column:
    table = F.split(F.lit(",".join(map(str, weights()))), ",").cast("array<int>")
    codes = F.transform(F.split(F.concat(F.lit("^"), host, F.lit("$"), path), ""), lambda c: F.ascii(c).cast("long"))

    def add(state: Column, code: Column) -> Column:  # the last two codes and the sum so far
        bucket = ((state["a"] * FACTOR + state["b"]) * FACTOR + code) % BUCKETS
        gain = F.when(state["a"] >= 0, F.get(table, bucket.cast("int")).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(state["b"].alias("a"), code.alias("b"), (state["sum"] + gain).alias("sum"))

    none = F.lit(-1).cast("long")
    start = F.struct(none.alias("a"), none.alias("b"), F.lit(0).cast("long").alias("sum"))
    total = F.aggregate(codes, start, add, lambda s: s["sum"])
    return F.when(host == "", F.lit(0).cast("long")).otherwise(total)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; rules are a short list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, score and verdict of every page."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", score_of(F.col("host"), F.col("path")))
    own = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return parts.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "score")
