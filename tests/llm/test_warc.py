import base64
import gzip
import hashlib
import io

import pytest
from conflux.llm import queries, warc


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            p = (html or "").encode()
            first[p] = min(first.get(p, page), page)
    out = []
    for page, url, html in rows:
        p = (html or "").encode()
        f = first.get(p)
        revisit = f is not None and page != f
        out.append((page, url, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", f if revisit else None, b"" if revisit else p))
    return sorted(out, key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op3_warc(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(((e[0], *e[2:6]) for e in expected(rows)), key=str)


def test_round_trip_edge_cases(spark):
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://b/\r\nX: 1", "x"), (2, None, ""), (None, "http://n/", "x"), (None, "u", "only null"), (5, "é", "\x1f\x8b\x08 WARC/1.0\r\n\r\n" * 9), (6, "l", "long " * 400_000), (7, "l", "long " * 400_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest long")
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.round_trip(pages, with_payload=True).collect()]
    want = [(p, u.replace("\r", "%0D").replace("\n", "%0A") if u else u, *rest) for p, u, *rest in expected(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_least_size_of_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read(warc.write(pages, tmp_path.as_uri(), least=5)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_common_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 5)
    monkeypatch.setattr(warc, "HOT_DIGESTS", 10)
    rows = [(i, f"http://h/{i}", ["", "error page", f"page {i // 2}", f"own {i}"][i % 4]) for i in range(200, 0, -1)] + [(None, "n", "error page")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, first long, key long").repartition(3)
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.round_trip(pages, with_payload=True).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def archive(n=60):
    members, starts = [], []
    for i in range(n):
        starts.append(sum(map(len, members)))
        members.append(warc.record(i, f"http://h/{i}", (f"payload {i} " * (i * 37 % 500)).encode() + bytes(range(256)) * (i % 3), None))
    return b"".join(members), starts


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 10**9])
def test_every_split_reads_each_record_once(split):
    data, starts = archive()
    seen = []
    for lo in range(0, len(data), split):
        own = list(warc.records_in(io.BytesIO(data), len(data), lo, min(lo + split, len(data))))
        assert len(own) == sum(lo <= s < lo + split for s in starts)
        seen += own
    assert b"".join(seen) == gzip.decompress(data)
    assert [warc.parsed(r)[0]["warc-record-id"] for r in seen] == [f"<urn:page:{i}>" for i in range(60)]


def test_damaged_member_is_passed_over():
    data, starts = archive()
    broken = bytearray(data)
    broken[starts[10] + 40 : starts[10] + 60] = b"\0" * 20
    seen = [warc.parsed(r)[0]["warc-record-id"] for r in warc.records_in(io.BytesIO(bytes(broken)), len(data), 0, len(data))]
    assert seen == [f"<urn:page:{i}>" for i in range(60) if i != 10]
    cut = data[: starts[-1] + 30]
    assert len(list(warc.records_in(io.BytesIO(cut), len(cut), 0, len(cut)))) == 59
