"""WARC archives: writing pages as segmented records, and reassembling them.

Writing: a page is a response record whose block is an HTTP response with a chunked body. Of pages with equal payloads
of `least_revisit` bytes and more, the one with the largest page_id is the response; the others become revisit records
without payload, written after the responses, whose WARC-Refers-To is the response's record id as the archives' index
gives it. Blocks above `segment_bytes` are cut: the first segment keeps the record's type, the others are continuation
records that name the first by WARC-Segment-Origin-ID and go to another archive; the last carries the total length.
Archives are binary rows of a table in the shared folder.

Reading: archives (plain or gzip by record) are parsed; segments are grouped by origin, ordered by segment number,
their total length is verified, and the HTTP body is freed from its chunked framing. Only rows of segmented records
carry blocks through the shuffle, and a group is one record. A revisit's length and digest are those of the response
that it refers to, as it was read back, and must agree with the digest in its own header.

Null pages are empty payloads. Repeated page rows are separate records of the same type. A page without page_id is a
response with page_id null. Very long pages are cut into as many segments as they need. Of several responses with a
page_id and payload that revisits refer to, they name the one with the smallest record id. Damage gives rows with an
`error` and without length and digest, and hurts no other record: records whose segments are missing, repeated, or of a
wrong total length, damaged chunked bodies, revisits without their response, and what lies between a record that can't
be parsed and the next one in its archive (of gzip archives, the next member). Empty tables give no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm._spark import arrow_batches, per_group, salted_join, stage


@dataclass(frozen=True)
class Settings:
    least_revisit: int = 1000
    segment_bytes: int = 16384
    chunk_bytes: int = 4096
    archive_bytes: int = 2 << 20
    compress: bool = False


def record(headers: list[tuple[str, str]], block: bytes, compress: bool = False) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    out = head.encode() + block + b"\r\n\r\n"
    return gzip.compress(out, 6, mtime=0) if compress else out


def chunked(body: bytes, size: int) -> bytes:
    parts = []
    for i in range(0, len(body), size):
        part = body[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The body without chunked transfer framing; extensions and trailers are skipped."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body ends early")
        size = int(body[at:end].split(b";")[0], 16)
        if size < 0:
            raise ValueError("damaged chunk")
        if not size:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("damaged chunk")
        parts.append(part)
        at = end + 4 + size


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and decoded body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("latin-1")
    return fields, unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def inflated(data: bytes) -> tuple[bytes, bool]:
    """What the members of a gzip archive hold, and whether some of them are damaged, which are left out."""
    out, at, damaged, view = [], 0, False, memoryview(data)
    while 0 <= at < len(data):
        one, parts, end = zlib.decompressobj(31), [], at
        try:
            while not one.eof:
                if end >= len(data):
                    raise zlib.error("member ends early")
                parts.append(one.decompress(view[end : end + 65_536]))
                end += 65_536
            out += parts
            at = min(end, len(data)) - len(one.unused_data)
        except zlib.error:
            damaged = True
            at = data.find(b"\x1f\x8b\x08", at + 1)
    return b"".join(out), damaged


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes] | tuple[None, str]]:
    """(headers, block) of each record of an archive, in order; (None, error) for what can't be parsed.

    Header names are lower-cased."""
    if data[:2] == b"\x1f\x8b":
        data, damaged = inflated(data)
        if damaged:
            yield None, "damaged gzip member"
    at = 0
    while 0 <= at < len(data):
        try:
            end = data.find(b"\r\n\r\n", at)
            if end < 0 or data[at : at + 5] != b"WARC/":
                raise ValueError("not a WARC record")
            headers = {}
            for line in data[at:end].split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                headers[k.decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
            size = int(headers.get("content-length", "-1"))
            block = data[end + 4 : end + 4 + size]
            if size < 0 or len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
                raise ValueError("record of a wrong length")
        except ValueError as e:
            yield None, str(e)
            at = data.find(b"WARC/1.", at + 1)
            continue
        yield headers, block
        at = end + 4 + size + 4


def hex_digest(value: str) -> str:
    """The SHA-1 of a WARC-Payload-Digest in lower-case hex; it may be in base 32. Empty for other digests."""
    kind, _, text = value.rpartition(":")
    if kind.lower() != "sha1":
        return ""
    return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()


def decided(pages: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Pages to be written as responses, (page_id, url, html), and as revisits, (page_id, url, digest, refers_to)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    pages = pages.select("page_id", text("url"), text("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    large = pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
    large = large.select("page_id", "url", digest.alias("digest"))
    last = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"))
    last = last.where("low < refers_to").drop("low")
    revisits = stage(salted_join(large, last, "digest", "page_id").where("page_id < refers_to"), "warc-revisits")
    gone = revisits.select(F.col("page_id").alias("__p"), F.col("digest").alias("__d")).distinct()
    responses = pages.join(gone.hint("merge"), (F.col("page_id") == F.col("__p")) & (digest == F.col("__d")), "left_anti")
    return responses, revisits.select("page_id", "url", "digest", "refers_to")


PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = ("WARC-Date", "2024-01-01T00:00:00Z")


class Archive:
    """Records on their way to archives; continuations wait for the archive after."""

    def __init__(self, prefix: str, s: Settings):
        self.prefix, self.s, self.number, self.size = prefix, s, 0, 0
        self.now: list[bytes] = []
        self.later: list[bytes] = []
        self.index: list[dict] = []

    def add(self, headers: list[tuple[str, str]], block: bytes) -> None:
        s, name = self.s, dict(headers)["WARC-Record-ID"]
        first = [("WARC-Segment-Number", "1")] if len(block) > s.segment_bytes else []
        self.now.append(record([*headers, *first], block[: s.segment_bytes], s.compress))
        self.size += len(self.now[-1])
        for i, a in enumerate(range(s.segment_bytes, len(block), s.segment_bytes), 2):
            last = a + s.segment_bytes >= len(block)
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{i}>"), DATE]
            own += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i))]
            own += [("WARC-Segment-Total-Length", str(len(block)))] if last else []
            self.later.append(record(own, block[a : a + s.segment_bytes], s.compress))
            self.size += len(self.later[-1])

    def rows(self, everything: bool) -> Iterator[pa.RecordBatch]:
        while self.now and (everything or self.size >= self.s.archive_bytes) or everything and self.later:
            row = {"archive": f"{self.prefix}-{self.number:06d}.warc", "content": b"".join(self.now), "index": self.index}
            yield pa.RecordBatch.from_pylist([row], ARCHIVE)
            self.now, self.later, self.index = self.later, [], []
            self.size, self.number = 0, self.number + 1


_ENTRY = pa.struct([("page_id", pa.int64()), ("digest", pa.string()), ("record_id", pa.string())])
ARCHIVE = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("index", pa.list_(_ENTRY))])
ARCHIVE_COLUMNS = "archive string, content binary, index array<struct<page_id:bigint,digest:string,record_id:string>>"


def write_archives(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(archive, content): the pages, (page_id, url, html), as WARC archives, in the shared folder."""
    s = settings
    arrow_batches(pages.sparkSession)
    responses, revisits = decided(pages.withColumn("page_id", F.col("page_id").cast("long")), s.least_revisit)

    def headers(kind, name, url, digest):
        common = [("WARC-Type", kind), ("WARC-Record-ID", name), DATE, ("WARC-Target-URI", " ".join(url.split()))]
        return [*common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]

    def write_responses(batches):
        part, made = TaskContext.get().partitionId(), 0
        archive = Archive(f"{part:06d}", s)
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = f"<urn:page:{'' if page is None else page}:{part}-{made}>"
                made += 1
                payload = html.encode()
                digest = hashlib.sha1(payload).hexdigest()
                block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, s.chunk_bytes)
                if page is not None and len(payload) >= s.least_revisit:
                    archive.index.append({"page_id": page, "digest": digest, "record_id": name})
                archive.add(headers("response", name, url, digest), block)
                yield from archive.rows(False)
        yield from archive.rows(True)

    def write_revisits(batches):
        part, made = TaskContext.get().partitionId(), 0
        archive = Archive(f"r{part:06d}", s)
        for batch in batches:
            for page, url, digest, target in zip(*(batch.column(i).to_pylist() for i in range(4))):
                name = f"<urn:page:{page}:r{part}-{made}>"
                made += 1
                more = [("WARC-Refers-To", target), ("WARC-Profile", PROFILE)]
                archive.add([*headers("revisit", name, url, digest), *more], HTTP + b"\r\n")
                yield from archive.rows(False)
        yield from archive.rows(True)

    written = stage(responses.mapInArrow(write_responses, ARCHIVE_COLUMNS), "warc-responses")
    index = written.select(F.explode("index").alias("x")).groupBy("x.digest", F.col("x.page_id").alias("refers_to"))
    index = index.agg(F.min("x.record_id").alias("target"))
    index = index.join(revisits.select("digest", "refers_to").distinct(), ["digest", "refers_to"], "left_semi")
    named = salted_join(revisits, index.drop("refers_to"), "digest", "page_id").select("page_id", "url", "digest", "target")
    again = stage(named.mapInArrow(write_revisits, ARCHIVE_COLUMNS), "warc-revisit-archives")
    return written.union(again).select("archive", "content")


PART = pa.schema(
    [
        ("origin", pa.string()),
        ("segment", pa.int32()),
        ("total", pa.int64()),
        ("type", pa.string()),
        ("uri", pa.string()),
        ("digest", pa.string()),
        ("refers", pa.string()),
        ("length", pa.int64()),
        ("error", pa.string()),
        ("block", pa.binary()),
    ]
)
PART_COLUMNS = (
    "origin string, segment int, total long, type string, uri string, digest string, refers string, length long, "
    "error string, block binary"
)
RECORD = (
    "record_id string, uri string, record_type string, refers_to_id string, payload_bytes long, payload_digest string, "
    "error string"
)


def part_of(headers: dict[str, str], block: bytes) -> dict:
    """A record as a row of PART; a damaged one has an error."""
    row = {
        "origin": headers.get("warc-segment-origin-id", headers.get("warc-record-id")),
        "segment": 0,
        "total": -1,
        "type": headers.get("warc-type"),
        "uri": headers.get("warc-target-uri"),
        "refers": headers.get("warc-refers-to"),
        "block": block,
    }
    try:
        row["digest"] = hex_digest(headers.get("warc-payload-digest", ""))
        row["segment"] = int(headers.get("warc-segment-number", 0))
        row["total"] = int(headers.get("warc-segment-total-length", -1))
    except ValueError:
        row |= {"segment": 0, "error": "damaged header"}
    return row


def finished(row: dict, payload: bool) -> dict:
    """A whole record's row: the length and digest of its payload, and the payload itself if it is wanted."""
    body = None
    if row.get("error") is None and row["type"] == "response":
        try:
            body = http_payload(row["block"])[1]
            row = row | {"length": len(body), "digest": hashlib.sha1(body).hexdigest()}
        except ValueError as e:
            row = row | {"error": str(e)}
    if row.get("error") is not None:
        row = row | {"length": None, "digest": None}
    return row | {"block": body if payload else None}


def read_archives(archives: DataFrame, content: str = "content", payload: bool = False) -> DataFrame:
    """(record_id, uri, record_type, refers_to_id, payload_bytes, payload_digest, error[, payload]) of each response
    and revisit; a revisit has no payload of its own."""
    arrow_batches(archives.sparkSession)

    def parse(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows: list[dict] = []
                for number, (headers, block) in enumerate(records(data or b"")):
                    if headers is None:  # told apart by the archive's digest, so that no group holds many
                        name = f"{hashlib.sha1(data).hexdigest()} {number}"
                        rows.append({"origin": name, "segment": 0, "error": block})
                        continue
                    row = part_of(headers, block)
                    if row["segment"] or row["type"] in ("response", "revisit"):
                        rows.append(row if row["segment"] else finished(row, payload))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, PART)

    def whole(table):
        rows = table.to_pylist()
        single = [r for r in rows if not r["segment"]]
        parts = sorted((r for r in rows if r["segment"]), key=lambda r: r["segment"])
        if parts:
            block = b"".join(r["block"] for r in parts)
            row = parts[0] | {"block": block}
            if [r["segment"] for r in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                row["error"] = "missing or damaged segments"
            single.append(finished(row, payload))
        out = [
            {
                "record_id": r["origin"] if r["type"] else None,
                "uri": r["uri"],
                "record_type": r["type"],
                "refers_to_id": r["refers"],
                "payload_bytes": r["length"],
                "payload_digest": r["digest"],
                "error": r["error"],
                "payload": r["block"],
            }
            for r in single
        ]
        return pa.RecordBatch.from_pylist(out, schema)

    names = ["record_id", "uri", "record_type", "refers_to_id"]
    fields = [(n, pa.string()) for n in names] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    schema = pa.schema([*fields, ("error", pa.string()), *([("payload", pa.binary())] if payload else [])])
    parsed = archives.select(content).mapInArrow(parse, PART_COLUMNS)
    read = stage(per_group(parsed, ["origin"], whole, RECORD + (", payload binary" if payload else "")), "warc-records")
    # a revisit's payload is that of the response it refers to
    good = (F.col("record_type") == "revisit") & F.col("error").isNull()
    revisits, others = read.where(good), read.where(~F.coalesce(good, F.lit(False)))
    wanted = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    found = read.where("record_type = 'response' and error is null").join(wanted, "record_id", "left_semi")
    found = found.groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.min(F.struct(F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))).alias("found")
    )
    revisits = salted_join(revisits, found, "refers_to_id", "record_id", how="left")
    differs = (F.col("payload_digest") != "") & (F.col("payload_digest") != F.col("found.d"))
    error = F.when(F.col("found").isNull(), "the response is missing").when(differs, "the digest differs")
    fits = error.isNull()
    resolved = revisits.withColumns(
        {
            "error": error,
            "payload_bytes": F.when(fits, F.col("found.n")),
            "payload_digest": F.when(fits, F.col("found.d")),
        }
    )
    return others.unionByName(resolved.select(*others.columns))


def page_report(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages, written to archives and read back."""
    kind = pages.select("page_id").schema[0].dataType.simpleString()
    out = read_archives(write_archives(pages.select("page_id", "url", "html"), settings))
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)", 1)
    number = lambda c, name: F.when(page(c) != "", page(c).cast(kind)).alias(name)
    columns = ["payload_bytes", "payload_digest", "record_type"]
    return out.select(number("record_id", "page_id"), *columns, number("refers_to_id", "refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


REPORT_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest AS d, max(page_id) AS last FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM q LEFT JOIN m ON payload_digest = d"""
