"""Legacy archive converter: ARC files (versions 1 and 2) to WARC 1.1.

An ARC file starts with a version block that names the fields of its record lines; each record is such a line and as
many bytes as the line declares.  The converter reads both versions, plain or gzip, and synthesises what WARC asks
for: record ids, ISO timestamps, record types, block and payload digests.  Records with equal payloads are written
once as ``response``; the others become ``revisit`` records that refer to it.

Archives are written by Spark's text writer, one record a row (the record separator of the format is the line
separator), so commits survive lost executors and any file system that Spark knows will do.  They are read with
``binaryFile``; a task holds one compressed archive and one record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.shared import binary_values, stored

FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SOURCE_ID = "X-Source-Id"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ARC_END, _WARC_END = "\n", "\r\n\r\n"
_RECORD = ("record_id string, version int, source_id long, url string, ip string, date string, mime string, "
           "kind string, truncated boolean, head binary, payload_digest string, payload_bytes long")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _token(text: str | None, empty: str) -> str:
    """A field of a record line: without white space or control characters, which are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "") or empty


def arc_line(version: int, url: str, ip: str, date: str, mime: str, length: int, status: int = 200) -> bytes:
    if version == 1:
        return f"{url} {ip} {date} {mime} {length}\n".encode()
    return f"{url} {ip} {date} {mime} {status} - - 0 - {length}\n".encode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} {0 if version == 1 else 1} archive\n{FIELDS[version]}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
              date: str = "20200101000000") -> None:
    """Write pages as ARC files, one for each partition, of version 1 and 2 by turns.

    A record's block is an HTTP response whose ``X-Source-Id`` header carries the page id.  Null html is an empty
    body, a null url ``about:blank``, a null id no header.
    """
    rows = pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, first = 1 + part % 2, True
        for batch in batches:
            values = [arc_version_block(version, f"part-{part}.arc", date)] if first and batch.num_rows else []
            first = first and not batch.num_rows
            for pid, link, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                       binary_values(batch.column(2)), strict=True):
                body = body or b""
                own = f"{SOURCE_ID}: {pid}\r\n" if pid is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n{own}\r\n".encode()
                line = arc_line(version, _token(link, "about:blank"), "0.0.0.0", date, "text/html", len(head) + len(body))
                values.append(line + head + body)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

    _write(rows.mapInArrow(run, "value binary"), path, _ARC_END)


def _write(records: DataFrame, path: str, end: str) -> None:
    out = records.select(F.col("value").cast("string")).write.option("lineSep", end)
    out.options(compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).text(path)


def _open(content: bytes) -> BinaryIO:
    plain = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=plain)) if content[:2] == b"\x1f\x8b" else plain


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bool]]:
    """``(version, fields, block, truncated)`` of every record of an ARC file, the version block first.

    The version block's own record line has the fields of version 1.  A url may hold spaces: the other fields are
    counted from the right.  A block shorter than declared is the last, truncated one.  A line whose fields or length
    cannot be read ends the file with ``ValueError``.
    """
    stream = _open(content)
    version, names = 1, FIELDS[1].split()
    first = True
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC record line: {line[:200]!r}")
        fields, size = dict(zip(names, parts, strict=True)), int(parts[-1])
        block = stream.read(size)
        if first and fields["URL"].startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split(" ")[0])
            names = lines[1].split(" ") if len(lines) > 1 and lines[1] else FIELDS[version].split()
        first = False
        yield version, fields, block, len(block) < size


def iso_date(digits: str) -> str:
    """The ISO form of an archive date of 14 digits, or fewer (the rest is the smallest); the epoch if unreadable."""
    d = digits if digits.isdigit() and len(digits) >= 4 else "19700101"
    d = (d + "00000101000000"[len(d):] if len(d) < 14 else d)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP response; all payload if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, at + len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    end = min(ends)[1] if ends else len(block)
    return block[:end], block[end:]


def header(head: bytes, name: str) -> str | None:
    for line in head.splitlines()[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each record of the ARC files under ``path``, with its payload if asked for.

    ``kind`` is ``warcinfo`` for the version block (the first record only), ``response`` for an HTTP block, else ``resource``.  ``record_id`` is
    derived from the archive's name and the record's place, ``date`` is in ISO form.  An empty file has no record.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    schema = _RECORD + (", payload binary" if payload else "")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for place, (version, f, block, cut) in enumerate(arc_records(content.as_py())):
                    head, body = split_http(block)
                    kind = "warcinfo" if not place and f["URL"].startswith("filedesc:") else "response" if head else "resource"
                    rows.append((f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{place}')}", version,
                                 _number(header(head, SOURCE_ID)), f["URL"], f["IP-address"], iso_date(f["Archive-date"]),
                                 f["Content-type"], kind, cut, head, sha1_base32(body), len(body), body)[:len(names)])
                    held += len(block)
                    if held > 8 << 20:
                        yield _batch(rows, kinds, names)
                        rows, held = [], 0
                yield _batch(rows, kinds, names)

    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)


def warc_record(kind: str, record_id: str, date: str, fields: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, revisit_min_bytes: int = 0) -> None:
    """Convert the ARC files under ``arc_path`` to WARC files under ``warc_path``.

    Of HTTP records with equal payloads of at least ``revisit_min_bytes`` bytes, the one with the largest source id
    (then date, then record id; nulls lowest) stays ``response``, the others become ``revisit`` with its id, url, date
    and source id.  Smaller ones, and other kinds, stay whole.  A cut block is marked ``WARC-Truncated: length``.
    """
    alike = (F.col("kind") == "response") & (F.col("payload_bytes") >= revisit_min_bytes)
    seen = read_arc(spark, arc_path, payload=False).filter(alike)
    best = F.max(F.struct("source_id", "date", "record_id", "url")).alias("of")
    first = seen.groupBy("payload_digest", "payload_bytes").agg(best, F.count("*").alias("copies"))
    first = first.filter("copies > 1").select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "of.*")
    first = stored(first.toDF("d", "b", "of_source", "of_date", "of_record", "of_url"), "copied")
    records = read_arc(spark, arc_path)
    hit = alike & (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")) & (F.col("of_record") != F.col("record_id"))
    rows = records.join(first, hit, "left").drop("d", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for r in (dict(zip(batch.schema.names, (c[i].as_py() for c in batch.columns), strict=True)) for i in range(batch.num_rows)):
                fields: dict[str, object] = {"WARC-Truncated": "length" if r["truncated"] else None}
                kind, block = r["kind"], r["head"] + r["payload"]
                if kind == "warcinfo":
                    fields |= {"WARC-Filename": r["url"].removeprefix("filedesc://"), "Content-Type": r["mime"]}
                else:
                    fields |= {"WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"],
                               "WARC-Payload-Digest": f"sha1:{r['payload_digest']}",
                               "Content-Type": "application/http; msgtype=response" if kind == "response" else r["mime"]}
                if r["of_record"]:
                    kind, block = "revisit", r["head"]
                    fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{r['of_record']}>",
                               "WARC-Refers-To-Target-URI": r["of_url"], "WARC-Refers-To-Date": r["of_date"],
                               "Refers-To-Source-Id": r["of_source"], "Payload-Length": r["payload_bytes"]}
                values.append(warc_record(kind, r["record_id"], r["date"], fields, block))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

    _write(rows.mapInArrow(run, "value binary"), warc_path, _WARC_END)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of every record of a WARC file; header names in lower case.

    A block's declared length counts, whatever bytes it holds.  Anything but a record where one should start raises
    ``ValueError``, and so does a block that is shorter than declared.
    """
    stream = _open(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC block ends before its declared length")
        yield fields, block


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row for each record of the WARC files under ``path``.

    ``payload_bytes`` and ``payload_digest`` (bare base32) are those of the full payload: computed from what a record
    holds, and for a revisit as it declares.  ``digest_ok``: the payload has the digest that its record declares.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = ("record_type string, record_id string, date string, url string, source_id long, payload_bytes long, "
              "payload_digest string, digest_ok boolean, refers_to_record string, refers_to long" + ", payload binary" * payload)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = [*[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in warc_records(content.as_py()):
                    kind = f["warc-type"]
                    head, body = split_http(block)
                    declared = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    revisit = kind == "revisit"
                    digest = declared if revisit else sha1_base32(body)
                    rows.append((kind, f["warc-record-id"].strip("<>"), f["warc-date"], f.get("warc-target-uri"),
                                 _number(header(head, SOURCE_ID)), _number(f.get("payload-length")) if revisit else len(body),
                                 digest, not declared or digest == declared,
                                 f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None,
                                 _number(f.get("refers-to-source-id")), None if revisit else body)[:len(names)])
                    held += len(block)
                    if held > 8 << 20:
                        yield _batch(rows, kinds, names)
                        rows, held = [], 0
                yield _batch(rows, kinds, names)

    return files.mapInArrow(run, schema)


#: The page records of ``write_arc``, ``convert`` and ``read_warc`` over table ``pages``, in SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          (((('0x' || substr(hex, 5 * i + 1, 5))::INTEGER) >> (15 - 5 * j)) & 31) + 1, 1) FOR j IN range(0, 4)], '')
          FOR i IN range(0, 8)], '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""
