"""Converting legacy ARC archives to WARC.

An ARC file is a version block, then records: a header line whose fields the version block names, and as many bytes as
the line declares. Version 1 lines have 5 fields, version 2 lines 10. The converter reads records by their declared
lengths, and writes for each an equivalent WARC 1.1 record: an identifier made from address, date and place, the date in
ISO form, SHA-256 digests of payload and block, and the type. A payload of at least 100 bytes that an earlier page (by
number) also has becomes a revisit of it.

Archives are written by Spark's own text writer as gzip files: a record's bytes are one value and its closing
CRLF CRLF is the separator, so any file system that Spark reaches will do, and a lost executor's files are rewritten by
the commit protocol. They are read as a stream of bytes in the same way: the separator may well occur in a payload, so
the reader joins the parts again and cuts records by Content-Length.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.shared import arrow_map, in_slices, scratch_path, written

END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
#: Field names of the two versions of ARC, as their version blocks list them: fixed by the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20000101000000"


@dataclass
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    kind: str
    status: str
    body: bytes


def arc_file(rows: list[tuple[str, bytes]], version: int) -> bytes:
    """An ARC file of (address, HTTP message) rows."""
    block = f"{version} 0 converter\n{FIELDS[version]}\n".encode()
    head = "text/plain 200 - - 0 pages.arc" if version == 2 else "text/plain"
    out = [f"filedesc://pages.arc 0.0.0.0 {DATE} {head} {len(block)}\n".encode(), block]
    for url, body in rows:
        address = quote(url or "none:", safe="!#$%&'()*+,/:;=?@[]~")
        extra = f" 200 {hashlib.md5(body).hexdigest()} - {sum(map(len, out))} pages.arc" if version == 2 else ""
        out += [f"\n{address} 0.0.0.0 {DATE} text/html{extra} {len(body)}\n".encode(), body]
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file of either version, cut by declared lengths; the version block is not one of them."""
    at, version, fields = 0, 0, 5
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"ARC: no end of the header line at byte {at}")
        line = data[at:stop].decode("utf-8", "replace").split(" ")
        length = int(line[-1])
        body = data[stop + 1 : stop + 1 + length]
        if len(body) < length:
            raise ValueError(f"ARC: the record at byte {at} declares {length} bytes, {len(body)} are left")
        if not version:
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC: version {version}")
            fields = len(FIELDS[version].split())
        elif len(line) != fields:
            raise ValueError(f"ARC: {len(line)} header fields in version {version} at byte {at}")
        else:
            yield ArcRecord(version, line[0], line[1], line[2], line[3], line[4] if version == 2 else "", body)
        at = stop + 1 + length


def warc_record(r: ArcRecord, row: object, refers_to: object = None) -> bytes:
    """The WARC record for an ARC record, without its closing END. row: the page's number; refers_to: of a revisit, the response's."""
    head, sep, payload = r.body.partition(END)
    block = r.body if refers_to is None else head + sep
    d = r.date
    lines = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{d} {row} {r.url}')}>",
        "WARC-Target-URI": r.url,
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(),
        "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(),
        "WARC-Payload-Length": len(payload),
        "WARC-Source-Row": "" if row is None else row,
    }
    if refers_to is not None:
        lines |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Row": refers_to}
    lines |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in lines.items()).encode() + END + block


class WarcStream:
    """Cuts a stream of bytes into (headers, block) pairs by Content-Length."""

    def __init__(self) -> None:
        self.held: list[bytes] = []
        self.size = self.need = 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held.append(data)
        self.size += len(data)
        if self.size < self.need:  # the block is not whole yet: wait without copying
            return
        data = b"".join(self.held)
        while True:
            stop = data.find(END)
            if stop < 0:
                self.need = 0
                break
            lines = data[:stop].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"WARC: a record begins with {lines[0][:40]!r}")
            head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            self.need = stop + 4 + int(head["Content-Length"]) + 4
            if len(data) < self.need:
                break
            block = data[stop + 4 : self.need - 4]
            if data[self.need - 4 : self.need] != END:
                raise ValueError("WARC: no CRLF CRLF after a block")
            data = data[self.need :]
            yield head, block
        self.held, self.size = [data], len(data)


def with_roles(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html (binary) and first: for a revisit the page_id it refers to, else null.

    Only the table of repeated digests is joined: sent to all where it is small, by the usual join, which splits hot
    digests, where it is not.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    firsts = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = written(firsts, "warc-firsts")
    if firsts.count() <= 50_000:
        firsts = F.broadcast(firsts)
    return rows.join(firsts, "digest", "left").withColumn("first", F.when(F.col("page_id") == F.col("first"), F.lit(None)).otherwise(F.col("first")))


def write(pages: DataFrame, path: str) -> None:
    """Archives of the pages (page_id, url, html), converted from ARC files of both versions, each of some megabytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            for part in in_slices(batch, 2, 4_000_000):
                ids, urls, bodies, firsts = (part.column(i).to_pylist() for i in range(4))
                nth += 1
                arc = arc_file([(u, HTTP + b) for u, b in zip(urls, bodies)], 1 + nth % 2)
                yield pa.RecordBatch.from_arrays([pa.array([warc_record(r, i, f) for r, i, f in zip(arc_records(arc), ids, firsts, strict=True)], pa.binary())], ["record"])

    records = arrow_map(with_roles(pages).select("page_id", "url", "html", "first"), run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The records of archives: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, uri, payload.

    A response's payload is checked against its digest; a revisit's is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, file = WarcStream(), None
        for batch in batches:
            out = []
            for data, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file:
                    if any(stream.held) and file is not None:
                        raise ValueError(f"WARC: {file} ends within a record")
                    stream, file = WarcStream(), name
                for head, block in stream.feed((data or b"") + END):
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    payload = block.partition(END)[2] if kind == "response" else None
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"WARC: the payload of {head['WARC-Record-ID']} has another digest")
                    out.append((head["WARC-Source-Row"] or None, int(head["WARC-Payload-Length"]), digest, kind, head.get("WARC-Refers-To-Row"), head["WARC-Record-ID"], head["WARC-Target-URI"], payload))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if i == 1 else pa.binary() if i == 7 else pa.string()) for i in range(8)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri", "payload"])
        if any(stream.held):
            raise ValueError(f"WARC: {file} ends within a record")

    parts = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path"))
    found = arrow_map(parts, run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, uri string, payload binary")
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of all pages in the shared folder and reads them back.

    Null html is an empty payload, null url an empty address; a null page_id stays null and no page refers to it. Rows
    that repeat the smallest page_id of their payload are all responses. Other columns of pages do not matter; an empty
    table gives an empty result.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path, dict(pages.dtypes)["page_id"])
