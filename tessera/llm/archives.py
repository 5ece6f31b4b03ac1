"""Legacy web archives: ARC in, equivalent WARC out, both read by their declared lengths.

ARC files are parsed twice: once for digests alone, and once for the records, to which
the few facts that the first pass found (what a record repeats) are joined by place. So
payloads are neither sorted nor dealt by their digest, and a page with very many copies
makes no large task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, pieces, settle, tidy

#: Fixed field lists of the two ARC versions' header lines.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
PARSED = "archive string, at long, name string, url string, ip string, date string, mime string, source string, http boolean, size long, digest string, info boolean, whole_digest string, head_digest string, head binary, body binary"
#: Bytes of records that a parser gives at once, and records of a WARC file.
GIVEN, RECORDS = 1 << 20, 5_000
#: Closes each record's gzip member in a file: an empty member, so readers see nothing of it.
_EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003030000000000" + "00000000")


def arc_line(version: int, **given: object) -> bytes:
    """A header line; blanks and controls within a field are escaped, a missing field is `-`."""
    clean = lambda v: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v)) or "-"
    return " ".join(clean("-" if given.get(f) is None else given[f]) for f in FIELDS[version]).encode() + b"\n"


def arc_opening(name: str, version: int, date: str) -> bytes:
    """The version block with which an ARC file begins."""
    body = f"{version} 0 tessera\n{NAMES[version]}\n\n".encode()
    return arc_line(version, url=f"filedesc://{name}", ip="0.0.0.0", date=date, mime="text/plain", status=200, filename=name, offset=0, length=len(body)) + body


def to_arc(pages: DataFrame, version: int = 2, date: str = "20240101000000", size: int = 4 << 20) -> DataFrame:
    """pages (page_id, url, html) as ARC archives (path, content) of about `size` bytes.

    The block is an HTTP response with the html in UTF-8 (null: empty; a long one whole,
    in an archive of its own size). Version 2 keeps the page_id in the Filename field; a
    null page_id or url is `-`. Rows repeat, an empty table gives no archive, and other
    columns are left out.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.spark_partition_id().alias("part"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number = b"", 0
        for batch in batches:
            for piece in pieces(batch, "html", size):
                ids, urls, htmls, parts = (c.to_pylist() for c in piece.columns)
                name = f"{parts[0]:06d}-{number:06d}.arc"
                number += 1
                made = [arc_opening(name, version, date)]
                at = len(made[0]) + 1
                for page_id, url, html in zip(ids, urls, htmls):
                    body = html.encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                    line = arc_line(version, url=url, ip="0.0.0.0", date=date, mime="text/html", status=200, offset=at, filename=page_id, length=len(block))
                    made.append(line + block)
                    at += len(line) + len(block) + 1
                out = b"\n".join(made) + b"\n"
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out], pa.binary())], names=["path", "content"])

    return slim.mapInArrow(run, "path string, content binary")


def write_arc(archives: DataFrame, path: str) -> None:
    """Archives (path, content) as gzip files, one each, that Spark's committer completes or drops."""
    archives.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The ARC files below a folder as (path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > 0).select("path", "content")


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of an ARC file, plain or gzip; the opening line tells the version.

    Blocks are taken by declared length. A line that is not a header (a wrong length,
    say) is skipped until one is found, so a damaged record does not hide the rest.
    """
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    version, at = 1, 0
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            break
        parts = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        names = FIELDS[version]
        if parts[0].startswith("filedesc://"):
            names = FIELDS[2] if len(parts) == len(FIELDS[2]) else FIELDS[1]
        if len(parts) > len(names):  # a type with blanks, as in text/html; charset=x
            extra = len(parts) - len(names)
            parts = [*parts[:3], " ".join(parts[3 : 4 + extra]), *parts[4 + extra :]]
        if len(parts) != len(names) or not parts[-1].isdigit():
            at = end + 1
            continue
        head = dict(zip(names, parts))
        block = content[end + 1 : end + 1 + int(head["length"])]
        if parts[0].startswith("filedesc://"):
            version = 2 if block[:1] == b"2" else 1
        yield at, head, block
        at = end + 1 + int(head["length"])


def _carried(block: bytes, size: int) -> tuple[str, str, bytes, bytes]:
    """Digests of the block and its head, the head, and the payload of `size` bytes, deflated."""
    head = block[: len(block) - size]
    return hashlib.sha1(block).hexdigest().upper(), hashlib.sha1(head).hexdigest().upper(), head, zlib.compress(block[len(head) :], 1)


def parse_arc(archives: DataFrame, whole: bool = True) -> DataFrame:
    """Records of ARC archives (path, content) with size and SHA-1 (hex) of their payloads.

    Only if `whole` come the block's and its head's SHA-1, the head itself and, as body, the
    payload (deflated: it is moved once).
    `name` is what the archive calls itself (else the last part of its path). A null or
    empty content has no records; a damaged record is skipped.
    """
    names = [x.split(" ")[0] for x in PARSED.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.bool_(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.binary(), pa.binary()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in names]
        held = 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                name = (path or "").rsplit("/", 1)[-1]
                for at, head, block in arc_records(content or b""):
                    info = head["url"].startswith("filedesc://")
                    if info and head["url"] != "filedesc://":
                        name = head["url"][11:]
                    http = block.startswith(b"HTTP/") and (split := block.find(b"\r\n\r\n") + 4) >= 4
                    payload = block[split:] if http else block
                    source = head.get("filename")
                    told = (path, at, name, head["url"], head["ip"], head["date"], head["mime"], None if source == "-" else source, http, len(payload), hashlib.sha1(payload).hexdigest(), info)
                    for row, v in zip(rows, (*told, *(_carried(block, len(payload)) if whole else [None] * 4))):
                        row.append(v)
                    held += 200 + len(block) * whole // 2
                    if held > GIVEN:
                        yield give()
                        rows, held = [[] for _ in names], 0
        if held:
            yield give()

    return archives.select("path", "content").mapInArrow(run, PARSED)


def _uuid(*parts: str) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _iso(date: Column) -> Column:
    """ARC's 14 digits (shorter ones filled up) as a WARC date."""
    good = date.rlike("^[0-9]{4,14}$")
    whole = F.concat(date, F.substring(F.lit("00000101000000"), F.length(date) + 1, F.lit(14)))
    d = F.when(good, whole).otherwise(F.lit("19700101000000"))
    return F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2), F.lit("T"), F.substring(d, 9, 2), F.lit(":"), F.substring(d, 11, 2), F.lit(":"), F.substring(d, 13, 2), F.lit("Z"))


def to_warc(archives: DataFrame, least: int = 1000) -> DataFrame:
    """header, head and body of one WARC 1.1 record for each ARC record; `record_bytes` puts them together.

    Identifiers are made from the archive's name, the record's offset and what its header
    and digest say; dates from the 14 digits; types from the content (version block:
    warcinfo, HTTP: response, else resource); digests from block and payload. Of records
    with equal payloads of `least` bytes or more, that of the largest source number (then
    path and offset) is kept and the others become revisits of it. Archives are read
    twice, so they must be the same both times (files, or a written table). No archives
    give no records; very long payloads pass whole, each through one task.
    """
    facts = parse_arc(archives, whole=False).filter((F.col("size") >= least) & ~F.col("info") & F.col("http"))
    facts = settle(facts.withColumn("number", F.expr("try_cast(source as bigint)")).select("digest", "size", "number", "archive", "at", "name", "url", "date"), "facts")
    rank = F.struct(F.coalesce("number", F.lit(-(2**63)).cast("long")).alias("n"), "archive", "at")
    first = facts.groupBy(F.col("digest").alias("d"), F.col("size").alias("z")).agg(F.max(F.struct(rank.alias("rank"), "number", "name", "url", "date")).alias("m"), F.count("*").alias("c")).filter("c > 1")
    both = facts.select("digest", "size", "archive", "at").join(first, (facts["digest"] == first["d"]) & (facts["size"] == first["z"]))
    again = both.filter(~((F.col("m.rank.archive") == F.col("archive")) & (F.col("m.rank.at") == F.col("at")))).select(
        F.col("archive").alias("r_archive"), F.col("at").alias("r_at"), F.col("m.number").alias("f_number"), F.col("m.url").alias("f_url"), F.col("m.date").alias("f_date"),
        _uuid("m.name", "m.rank.at", "m.url", "m.date", "digest").alias("f_id"),
    )
    rec = parse_arc(archives)
    j = rec.join(again.hint("shuffle_hash"), (rec["archive"] == again["r_archive"]) & (rec["at"] == again["r_at"]), "left")  # a hash of the few: payloads are not sorted
    again = F.col("r_at").isNotNull()
    kind = F.when(F.col("info"), "warcinfo").when(again, "revisit").when(F.col("http"), "response").otherwise("resource")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    opt = lambda when, *lines: F.when(when, F.concat(*lines)).otherwise("")
    j = j.withColumn("kind", kind)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _uuid("name", "at", "url", "date", "digest"), F.lit(">"))),
        line("WARC-Date", _iso(F.col("date"))),
        opt(~F.col("info"), line("WARC-Target-URI", F.col("url"))),
        opt(F.col("info"), line("WARC-Filename", F.col("name"))),
        opt(~F.col("info") & (F.col("ip") != "-"), line("WARC-IP-Address", F.col("ip"))),
        opt(F.col("source").isNotNull() & ~F.col("info"), line("WARC-Source-Number", F.col("source"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(again, F.col("head_digest")).otherwise(F.col("whole_digest")))),
        opt(~F.col("info"), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.upper("digest"))), line("WARC-Payload-Length", F.col("size").cast("string"))),
        opt(again, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<"), F.col("f_id"), F.lit(">"))),
            line("WARC-Refers-To-Target-URI", F.col("f_url")), line("WARC-Refers-To-Date", _iso(F.col("f_date"))), line("WARC-Refers-To-Source-Number", F.coalesce(F.col("f_number").cast("string"), F.lit("-")))),
        line("Content-Type", F.when(F.col("info"), "application/warc-fields").when(F.col("http"), "application/http;msgtype=response").otherwise(F.coalesce("mime", F.lit("application/octet-stream")))),
        line("Content-Length", (F.octet_length("head") + F.when(again, 0).otherwise(F.col("size"))).cast("string")),
        F.lit("\r\n"),
    )
    return j.select(header.alias("header"), "head", F.when(~again, F.col("body")).alias("body"))


def record_bytes(header: str, head: bytes, body: bytes | None) -> bytes:
    """A record of to_warc, with the two line ends that close it."""
    return header.encode() + head + (zlib.decompress(body) if body else b"") + END


def write_warc(records: DataFrame, path: str) -> None:
    """Records closed by two line ends, each a gzip member of its own, in files that Spark's committer completes or drops."""

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "body"):
                yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(record_bytes(*x), 6, mtime=0) for x in zip(*(c.to_pylist() for c in part.columns))], pa.binary())], names=["value"])

    packed = records.select("header", "head", "body").mapInArrow(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", RECORDS).text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of a WARC file, plain or gzip, by Content-Length."""
    stream: io.BufferedIOBase = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(n := int(head["content-length"]))
        if len(block) < n:
            raise ValueError("a WARC record ends before its declared length")
        yield head, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per response and revisit of the archives: source number, payload size and digest, type, the number it refers to.

    A block that does not match its digest, or a payload that does not match its own, fails
    the read; an empty folder has no rows. A file's records are taken one after another.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"])

        number = lambda v: int(v) if v and re.fullmatch(r"-?\d+", v) else None
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[list] = [[] for _ in range(7)]
                for head, block in warc_records(batch.column(0)[i].as_py()):
                    if hashlib.sha1(block).hexdigest().upper() != head["warc-block-digest"].partition(":")[2]:
                        raise ValueError(f"{head['warc-record-id']} does not match its block digest")
                    if head["warc-type"] not in ("response", "revisit", "resource"):
                        continue
                    digest, size = head["warc-payload-digest"].partition(":")[2].lower(), int(head["warc-payload-length"])
                    if head["warc-type"] != "revisit":
                        payload = block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block
                        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{head['warc-record-id']} does not match its payload digest")
                    for row, v in zip(rows, (number(head.get("warc-source-number")), size, digest, head["warc-type"], number(head.get("warc-refers-to-source-number")), head.get("warc-target-uri"), head["warc-record-id"])):
                        row.append(v)
                    if len(rows[0]) >= 5000:
                        yield give(rows)
                        rows = [[] for _ in range(7)]
                yield give(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > 0).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string")


def new_archive(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")

