"""Legacy archive converter: pages to ARC files, ARC to WARC, WARC back to rows.

Method.  An ARC file starts with a version block that says which fields its
record lines have; each record is one such line and as many bytes as the line
declares.  The converter parses both versions and synthesises the equivalent
WARC record: identifier, timestamp, type, payload and block digest.  Of records
with equal payloads of at least ``min_revisit_bytes`` the one with the largest
page id becomes the response and the others revisit records without payload.

Scale.  Both kinds of archive are written by Spark's own writer, one bounded
archive per file, gzip-compressed, in the shared folder, so task retries and
lost executors leave no half file.  A first pass over the ARC files yields only
digests; they are grouped (partial aggregation, so a payload that a third of all
pages share moves as one row per task) and only the revisit decisions, a list
per archive, are joined back to the archives.  Payloads are shuffled once, in
compressed archives.  Identifiers are derived from the record, so a task that
runs twice writes the same archive.

Cases.  A null html is an empty payload; a null or odd url is written
percent-encoded (null as ``-``) and read back as null; a null page id is kept as
null and is never preferred as response; repeated rows are records of their own
(of equal page ids the first by file and position is the response); an empty
table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.session import scratch_path, write_and_reload

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 1000
CAPTURED = "20260101000000"
HOST_IP = "0.0.0.0"
#: Fixed values of the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://iipc.github.io/warc-specifications/")


# --- ARC ------------------------------------------------------------------------

def _http_response(page_id: int | None, payload: bytes) -> bytes:
    page = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + page
            + b"Content-Length: %d\r\n\r\n" % len(payload) + payload)


def arc_version_block(version: int, captured: str = CAPTURED) -> bytes:
    body = f"{version} 0 bookspark\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    extra = "" if version == 1 else " 200 - - 0 pages.arc"
    return f"filedesc://pages.arc {HOST_IP} {captured} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes, captured: str = CAPTURED) -> bytes:
    doc = _http_response(page_id, payload)
    target = "-" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "%"
    if version == 1:
        line = f"{target} {HOST_IP} {captured} text/html {len(doc)}"
    else:
        line = f"{target} {HOST_IP} {captured} text/html 200 {zlib.crc32(doc):08x} - 0 pages.arc {len(doc)}"
    return line.encode() + b"\n" + doc + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file by declared length: the field values, and the body in ``block``."""
    at, fields = 0, None
    while True:
        while data[at:at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8")
        if line.startswith("filedesc://"):
            length = int(line.rsplit(" ", 1)[1])
            block = data[end + 1:end + 1 + length]
            fields = ARC_FIELDS[int(block.split(b" ", 1)[0])]
        else:
            if fields is None:
                raise ValueError("an ARC file must start with its version block")
            values = line.rsplit(" ", len(fields) - 1)
            if len(values) != len(fields):
                raise ValueError(f"ARC record line has {len(values)} of {len(fields)} fields")
            record = dict(zip(fields, values))
            length = int(record["Archive-length"])
            block = data[end + 1:end + 1 + length]
            if len(block) != length:
                raise ValueError("ARC record is shorter than its declared length")
            yield record | {"block": block}
        at = end + 1 + length


def _arc_batches(batches, version: int, archive_bytes: int):
    """One row per archive: its bytes without the final newline, which the writer adds."""
    parts, size = [], 0
    for batch in batches:
        for page_id, url, html in zip(*batch.columns):
            record = arc_record(version, page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"))
            if parts and size + len(record) > archive_bytes:
                yield _text_batch(b"".join(parts)[:-1])
                parts, size = [], 0
            parts += [record] if parts else [arc_version_block(version), record]
            size += len(record)
    if parts:
        yield _text_batch(b"".join(parts)[:-1])


def _text_batch(archive: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive], pa.binary()).cast(pa.string())], ["value"])


def _write_archives(archives: DataFrame, name: str, line_end: str) -> str:
    """Writes each row as a gzip file of its own and returns the folder."""
    path = scratch_path(archives.sparkSession, name)
    (archives.write.option("compression", "gzip").option("lineSep", line_end).option("maxRecordsPerFile", 1).text(path))
    return path


def write_arc(pages: DataFrame, version: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes the pages as ARC files in the shared folder; returns the folder."""
    rows = pages.select(pages[id_col].cast("long"), pages[url_col].cast("string"), pages[html_col].cast("string"))
    archives = rows.mapInArrow(partial(_arc_batches, version=version, archive_bytes=archive_bytes), "value string")
    return _write_archives(archives, "arc", "\n")


# --- conversion -----------------------------------------------------------------

def _gunzip(content: bytes) -> bytes:
    out = []
    while content:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def _split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), header bytes, payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, head + mark, payload


def _described(record: dict, seq: int, archive: str) -> dict:
    fields, head, payload = _split_http(record["block"])
    digest = hashlib.sha1(payload).hexdigest()
    name = f"{archive.rsplit('/', 1)[-1]} {seq} {record['URL']} {record['Archive-date']} {digest}"
    page = fields.get("x-page-id")
    return {"page_id": None if page is None else int(page), "record_id": str(uuid.uuid5(ID_SPACE, name)), "digest": digest,
            "size": len(payload), "head": head, "payload": payload}


def _digest_batches(batches):
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            rows = [(seq, *(r[k] for k in ("page_id", "record_id", "digest", "size")))
                    for seq, record in enumerate(read_arc(_gunzip(content.as_py()))) for r in [_described(record, seq, path.as_py())]]
            if rows:
                seqs, pages, ids, digests, sizes = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()] * len(rows)), pa.array(seqs, pa.int32()), pa.array(pages, pa.int64()), pa.array(ids),
                     pa.array(digests), pa.array(sizes, pa.int64())], ["path", "seq", "page_id", "record_id", "digest", "size"])


def _sha1_label(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(kind: str, record_id: str, date: str, block: bytes, content_type: str, more: list[tuple[str, str]]) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), *more,
              ("WARC-Block-Digest", _sha1_label(hashlib.sha1(block).hexdigest())), ("Content-Type", content_type),
              ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def _timestamp(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert_archive(archive: str, data: bytes, revisits: dict[int, str]) -> bytes:
    """The WARC form of an ARC file.  ``revisits``: by position in the file, the id of the
    record that a revisit record refers to."""
    info = f"software: bookspark\r\nformat: WARC File Format 1.1\r\nconverted-from: {archive.rsplit('/', 1)[-1]}\r\n".encode()
    out = [warc_record("warcinfo", str(uuid.uuid5(ID_SPACE, archive.rsplit("/", 1)[-1])), _timestamp(CAPTURED), info, "application/warc-fields", [])]
    for seq, record in enumerate(read_arc(data)):
        r, date = _described(record, seq, archive), _timestamp(record["Archive-date"])
        more = [("WARC-Target-URI", record["URL"]), ("WARC-IP-Address", record["IP-address"]), ("WARC-Payload-Digest", _sha1_label(r["digest"]))]
        kind, block = "response", r["head"] + r["payload"]
        if seq in revisits:
            kind, block = "revisit", r["head"]
            more += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{revisits[seq]}>")]
        out.append(warc_record(kind, r["record_id"], date, block, "application/http; msgtype=response", more))
    return b"".join(out)


def _convert_batches(batches):
    """One row per archive, without the final blank lines, which the writer adds."""
    for batch in batches:
        for path, content, revisits in zip(*(batch.column(c) for c in ("path", "content", "revisits"))):
            decided = {r["seq"]: r["to"] for r in revisits.as_py() or []}
            data = _gunzip(content.as_py())
            if data:
                yield _text_batch(convert_archive(path.as_py(), data, decided)[:-4])


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def convert(spark: SparkSession, arc_folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Converts a folder of ARC files; returns the folder of WARC files."""
    records = write_and_reload(_archives(spark, arc_folder).mapInArrow(
        _digest_batches, "path string, seq int, page_id bigint, record_id string, digest string, size bigint"), "arc-digests")
    large = records.filter(F.col("size") >= min_revisit_bytes)
    # Largest page id, nulls last; of equal ids the first by file and position.
    order = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id")
    best = large.groupBy("digest").agg(F.max(order).alias("_best"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    tied = (large.join(best, "digest").filter(order == F.col("_best"))
            .groupBy("digest").agg(F.min(F.struct("path", "seq", "record_id")).alias("_first")))
    revisits = (large.join(tied, "digest").filter(F.col("record_id") != F.col("_first.record_id"))
                .groupBy("path").agg(F.collect_list(F.struct("seq", F.col("_first.record_id").alias("to"))).alias("revisits")))
    archives = _archives(spark, arc_folder).join(revisits, "path", "left").select("path", "content", "revisits")
    return _write_archives(archives.mapInArrow(_convert_batches, "value string"), "warc", "\r\n\r\n")


# --- WARC -----------------------------------------------------------------------

def read_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file by declared length: the header fields, and the body in ``block``."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(fields["Content-Length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError("WARC record does not end at its declared length")
        yield fields | {"block": data[end + 4:stop]}
        at = stop + 4


def _record_batches(batches):
    names = ["page_id", "record_id", "record_type", "refers_id", "url", "warc_date", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for record in read_warc(_gunzip(content.as_py())):
                if record["WARC-Type"] not in ("response", "revisit"):
                    continue
                fields, _, payload = _split_http(record["block"])
                label = record["WARC-Payload-Digest"]
                if record["WARC-Block-Digest"] != _sha1_label(hashlib.sha1(record["block"]).hexdigest()):
                    raise ValueError(f"block digest differs in {record['WARC-Record-ID']}")
                response = record["WARC-Type"] == "response"
                if response and label != _sha1_label(hashlib.sha1(payload).hexdigest()):
                    raise ValueError(f"payload digest differs in {record['WARC-Record-ID']}")
                page, uri = fields.get("x-page-id"), record["WARC-Target-URI"]
                rows.append((None if page is None else int(page), record["WARC-Record-ID"], record["WARC-Type"], record.get("WARC-Refers-To"),
                             None if uri == "-" else unquote(uri), record["WARC-Date"], int(fields["content-length"]),
                             base64.b32decode(label.removeprefix("sha1:")).hex(), payload if response else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)


def read_records(spark: SparkSession, warc_folder: str) -> DataFrame:
    """One row per response or revisit record of a folder of WARC files, digests verified."""
    schema = ("page_id bigint, record_id string, record_type string, refers_id string, url string, warc_date string, "
              "payload_bytes bigint, payload_digest string, payload binary")
    return _archives(spark, warc_folder).mapInArrow(_record_batches, schema)


def archive_pages(pages: DataFrame, version: int = 1, min_revisit_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back, with the page id that a revisit refers to."""
    spark = pages.sparkSession
    warc = convert(spark, write_arc(pages, version, id_col, url_col, html_col, archive_bytes), min_revisit_bytes)
    columns = ["page_id", "record_id", "record_type", "refers_id", "payload_bytes", "payload_digest"]
    records = write_and_reload(read_records(spark, warc).select(*columns), "warc-records")
    to = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    return (records.join(to, "refers_id", "left")
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"))
