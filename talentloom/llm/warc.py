"""WARC archives written and read back through an index.

A page becomes one record: WARC headers, an HTTP header block, and for responses the
payload, compressed as a gzip member of its own. Of pages with equal payloads of at
least `revisit_bytes` the one with the largest id is the response and the others are
revisits without payload. Writing a record gives its index row: file, offset, length,
URL and digest. Every task attempt writes files of its own and only the index rows of
finished tasks are kept, so an attempt that was lost leaves nothing that is read.
Readers take the selected index rows sorted by offset, merge neighbouring byte ranges,
and read each merged range once. Files are opened through Arrow's file systems, in the
shared folder of the session.

Defined results: null html is an empty payload; a null URL leaves the target URI out;
control characters and spaces of a URL are percent-encoded; rows repeated with the
same page_id and payload are the same page, each written as that page's record type;
a null page_id sorts below all others. An empty table gives an index without rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import checked_broadcast, own_columns, to_batch, utf8
from talentloom.session import materialise, shared_folder

CRLF = "\r\n"
END = CRLF + CRLF
GZIP = 31  # zlib's window bits for gzip members
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
INDEX = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
     ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


@dataclass(frozen=True)
class Archive:
    folder: str
    index: DataFrame  # the columns of INDEX


def _record_id(page_id: int | None) -> str:
    """A stable id made from the page id; the page id can be read from it."""
    return f"<urn:page:{'' if page_id is None else page_id}>"


def format_record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record; a revisit states the size of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{END}".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines.append(f"WARC-Refers-To: {_record_id(refers_to)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return utf8(CRLF.join(lines) + END) + block + END.encode()


def write_archive(
    pages: DataFrame,
    folder: str | None = None,
    revisit_bytes: int = 1000,
    file_bytes: int = 1 << 30,
    date: str = "2000-01-01T00:00:00Z",
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> Archive:
    """Write one record per page and the index of all records."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    own = own_columns(pages, page_id=page_id, url=url, html=html)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = own.withColumn("digest", F.sha1(payload))
    slim = own.where(F.octet_length(payload) >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first_page"), F.count("*").alias("n"))
    twins = materialise(slim.where("n > 1").select("digest", "first_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        file, name, at = None, "", 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                key, address, text, digest, first = (c[i].as_py() for c in batch.columns)
                if file is None or at >= file_bytes:
                    if file is not None:
                        file.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    file = system.open_output_stream(f"{place}/{name}", compression=None)
                revisit = first is not None and key != first
                record = format_record(key, address, digest, utf8(text) if isinstance(text, str) else text or b"", first, revisit, date)
                pack = zlib.compressobj(3, zlib.DEFLATED, GZIP)
                member = pack.compress(record) + pack.flush()
                file.write(member)
                rows.append((f"{folder}/{name}", at, len(member), key, address, digest, "revisit" if revisit else "response", first if revisit else None))
                at += len(member)
            if rows:
                yield to_batch(rows, INDEX)
        if file is not None:
            file.close()

    written = own.join(checked_broadcast(twins, 64), "digest", "left").select("page_id", "url", "html", "digest", "first_page")
    index = written.mapInArrow(
        run, "path string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
    )
    return Archive(folder, materialise(index))


def parse_record(record: bytes) -> dict[str, str | bytes]:
    """Header fields of one uncompressed record, and its payload under `payload`."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields | {"http": http.decode(), "payload": payload}


def _ranges(rows: Iterator[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Neighbouring records of a file as one range, while gaps and the whole stay small."""
    path, start, end, parts = "", 0, 0, []
    for p, offset, length in rows:
        if parts and (p != path or offset > end + gap or offset + length - start > most):
            yield path, start, end, parts
            parts = []
        if not parts:
            path, start, end = p, offset, offset + length
        parts.append((offset, length))
        end = max(end, offset + length)
    if parts:
        yield path, start, end, parts


def read_records(selected: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records of the selected index rows: page_id, url, record_type, refers_to,
    payload_bytes (of the full payload), payload_digest (worked out again from what a
    response holds, from the header of a revisit) and payload (null for a revisit).

    Rows are dealt by file and stretch of the file, so no task holds a whole large file.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("payload", pa.binary())]
    )

    def number(record_id: str | None) -> int | None:
        digits = (record_id or "")[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def parsed(record: bytes) -> tuple:
        got = parse_record(record)
        revisit = got["WARC-Type"] == "revisit"
        stated = got["WARC-Payload-Digest"].removeprefix("sha1:")
        digest = stated if revisit else hashlib.sha1(got["payload"]).hexdigest()
        if digest != stated:
            raise ValueError(f"{got['WARC-Record-ID']}: payload digest {digest}, header says {stated}")
        size = int(got["http"].rpartition("Content-Length: ")[2]) if revisit else len(got["payload"])
        refers_to = number(got.get("WARC-Refers-To"))
        return number(got["WARC-Record-ID"]), got.get("WARC-Target-URI"), got["WARC-Type"], refers_to, size, digest, None if revisit else got["payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        wanted = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        name, file = None, None
        for path, start, end, parts in _ranges(wanted, gap, most):
            if path != name:
                system, place = fs.FileSystem.from_uri(path)
                name, file = path, system.open_input_file(place)  # no decompression: offsets are of the stored bytes
            block = memoryview(file.read_at(end - start, start))
            yield to_batch([parsed(zlib.decompress(block[o - start : o - start + n], GZIP)) for o, n in parts], schema)

    stretch = F.floor(F.col("offset") / most)
    dealt = selected.select("path", "offset", "length").repartition("path", stretch).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )
