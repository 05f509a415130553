"""WARC archives: deduplicating writer and splittable reader.

Writing: payload digests are computed by Spark; of records with equal payloads the smallest page_id is a response, the
others are revisits that refer to it.  Only digests shared by several pages are looked up: those of very many pages (at
most ``HOT_DIGESTS`` can be that many) and, through a bitmap, the pages that may have one of the others; all other pages
are written where they are read, so no payload is shuffled for being common or for being unique.  Each task attempt
writes one ``.warc.gz`` of one gzip member per record under a name of its own; the manifest, a table that holds the rows
of successful attempts alone, says which archives count.

Reading: tasks scan byte ranges of archives.  A task looks for the gzip magic in its range, accepts a candidate only if
it decompresses to a WARC header, and from then on follows the members; it owns the records that start inside its range
and reads the last of them beyond the range's end.  A damaged member is left by searching on for the next magic.

Files are opened through pyarrow.fs by URI, so the folder can be on any file system that it knows.

Defined cases: a null html is an empty payload; equal payloads of rows that repeat the smallest page_id are all
responses; rows with a null page_id are revisits if a numbered page has the payload, else responses; line breaks in a
url are percent-encoded; an empty table writes no record; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sieve import Sieve
from .tables import bounded, shared_dir, stored

SPLIT = 8 << 20
READ = 1 << 20
HOT, HOT_DIGESTS = 1000, 100_000  # a payload is hot from HOT pages and a share of 1 / HOT_DIGESTS of all on
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(urn: str) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", urn)
    return int(found[1]) if found else None


def record(page: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One gzip member; ``first`` is the page a revisit refers to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + squeeze.flush()


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes all pages; returns (path, bytes, records) of every archive. Payloads under ``least`` bytes are never revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.xxhash64("digest"))
    counted = rows.select("page_id", "digest", "key", F.octet_length("payload").alias("size")).where(F.col("size") >= least)
    shared = counted.groupBy("digest", "key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages")).where("pages > 1 and first is not null")
    shared = stored(shared, "shared")
    # at most HOT_DIGESTS can have that many pages
    hot = F.col("pages") > max(HOT, (shared.agg(F.sum("pages")).first()[0] or 0) // HOT_DIGESTS)
    rare = shared.where(~hot).select("digest", "first")
    sieve = Sieve(shared.where(~hot).select("key"))
    common = sieve.split(rows, "key", hit=False).join(F.broadcast(shared.where(hot).select("digest", "first")), "digest", "left")
    asked = sieve.split(rows, "key", hit=True).join(F.broadcast(shared.where(hot).select("digest", F.col("first").alias("common"))), "digest", "left")
    asked = asked.where("common is not null").withColumnRenamed("common", "first").unionByName(asked.where("common is null").drop("common").join(rare, "digest", "left"))
    first = F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first")).alias("first")
    joined = bounded(common.unionByName(asked)).select("page_id", "url", "payload", first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        n = size = 0
        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    at.create_dir(place, recursive=True)
                    out = at.open_output_stream(f"{place}/{name}", compression=None)
                page, url, payload, first = (batch.column(c)[i].as_py() for c in range(4))
                raw = record(page, url, payload, first)
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    return stored(joined.mapInArrow(run, "path string, bytes long, records long"), "manifest")


class _Window:
    """Forward reading of a file with a bounded number of bytes held."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.held = file, at, size, b""

    def more(self) -> bool:
        there = self.at + len(self.held)
        if there >= self.size:
            return False
        self.file.seek(there)
        got = self.file.read(min(READ, self.size - there))
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n


def _member(window: _Window) -> tuple[bytes, int] | None:
    """Content and compressed length of the member at the window's start; None if it isn't a whole WARC member."""
    inflate = zlib.decompressobj(31)
    parts, length, fed = [], 0, 0
    while True:
        if fed >= len(window.held) and not window.more():
            return None
        try:
            got = inflate.decompress(window.held[fed:])
        except zlib.error:
            return None
        fed = len(window.held)
        parts.append(got)
        length += len(got)
        if length >= 5 and len(parts[0]) >= 5 and not parts[0].startswith(b"WARC/"):
            return None
        if inflate.eof:
            whole = b"".join(parts)
            return (whole, fed - len(inflate.unused_data)) if whole.startswith(b"WARC/") else None


def records_in(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decompressed records whose members start in [start, end)."""
    window, following = _Window(file, start, size), False
    while window.at < end:
        if not following:
            spot = window.held.find(MAGIC)
            if spot < 0:
                window.drop(max(len(window.held) - 2, 0))
                if not window.more():
                    return
                continue
            window.drop(spot)
            if window.at >= end:
                return
        while len(window.held) < 3:
            if not window.more():
                return
        found = _member(window)
        if found is None:
            window.drop(1)
            following = False
            continue
        yield found[0]
        window.drop(found[1])
        following = True


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""

    def fields(head: bytes) -> dict[str, str]:
        pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
        return {k.strip().lower(): v.strip() for k, v in pairs}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def read(manifest: DataFrame, with_payload: bool = True, split: int = SPLIT) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    number = max(1, manifest.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 0)
    ranges = ranges.repartition(int(min(number, 100_000)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                at, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with at.open_input_file(place) as file:
                    for raw in records_in(file, size, start, min(start + split, size)):
                        warc, http, payload = parsed(raw)
                        revisit = warc["warc-type"] == "revisit"
                        if revisit:
                            length, digest = int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
                        else:
                            length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        row = (_page(warc["warc-record-id"]), warc.get("warc-target-uri"), length, digest, warc["warc-type"], _page(warc["warc-refers-to"]) if revisit else None)
                        rows.append((*row, payload) if with_payload else row)
                        held += len(payload) if with_payload else 100
                        if held > 4 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    return ranges.mapInArrow(run, RECORD + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder), with_payload)
