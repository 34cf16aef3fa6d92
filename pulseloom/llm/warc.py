"""WARC archives, index first.

Writing: each task streams its records, a gzip member each, to archive files of its own in the shared
folder and returns an index row per record: file, offset, length, URL and digest. Only the index
of tasks that succeeded is kept; a file of a lost attempt is never referred to. Payloads of
``min_revisit`` bytes or more that occur again become revisit records of the one with the smallest page_id.

Reading: the selected index rows are dealt by ranges of (file, offset) and sorted; neighbours at most ``gap`` bytes
apart are read as one range of up to ``span`` bytes, and the records are cut out of it, some megabytes of unpacked payload at a time.

Archives are reached through the file system of the folder's URI. Defined cases: a null payload is empty; a null page_id comes last, and is
smallest only among nulls; repeated rows with the smallest page_id are all responses; a very long payload is one record, held alone; empty tables give an empty index;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, shared_dir, slices, small

MIN_REVISIT = 100
ROTATE = 1 << 30
GAP, SPAN = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SQL = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value: str | None) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(url)}"] * (url is not None) + [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"X-Page-Id: {page_id}"] * (page_id is not None)
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; the payload of a revisit is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str, payload: str = "html", min_revisit: int = MIN_REVISIT, rotate: int = ROTATE) -> DataFrame:
    """Write a record per page below ``folder`` and return the index, itself written out."""
    data = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), data.alias("payload"))
    digest = F.sha2("payload", 256)
    first = p.filter(F.length("payload") >= min_revisit).select(digest.alias("digest"), "page_id")
    first = materialize(first.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    # payloads that occur once need no partner: the repeated digests go to the payloads if they are few, else both are shuffled
    first = small(first, 96)
    met = p.withColumn("digest", digest).join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    met = met.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, name, offset = None, "", 0
        try:
            for b in slices(batches, "payload"):
                rows = []
                for r in b.to_pylist():
                    if out is None or offset >= rotate:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                        info = b"software: pulseloom\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        member = _gzip(head.encode() + info + b"\r\n\r\n")
                        out.write(member)
                        offset = len(member)
                    member = _gzip(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["revisit"]))
                    out.write(member)
                    rows.append({"page_id": r["page_id"], "url": r["url"], "file": name, "offset": offset, "length": len(member), "payload_digest": r["digest"], "record_type": "revisit" if r["revisit"] else "response", "refers_to": r["refers_to"]})
                    offset += len(member)
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return materialize(met.mapInArrow(run, INDEX_SQL))


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[str, int, int, list[int]]]:
    """(file, start, end, row numbers): sorted rows (file, offset, length), coalesced."""
    out: list[tuple[str, int, int, list[int]]] = []
    for i, (file, offset, length) in enumerate(rows):
        if out and out[-1][0] == file and offset <= out[-1][2] + gap and offset + length - out[-1][1] <= span:
            f, a, b, own = out[-1]
            out[-1] = (f, a, max(b, offset + length), [*own, i] if len(own) < 2 else (own.append(i) or own))
        else:
            out.append((file, offset, offset + length, [i]))
    return out


def read_archives(index: DataFrame, folder: str, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records of the index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            for file, start, end, own in ranges(rows, gap, span):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, system.open_input_file(f"{base}/{file}")
                data = source.read_at(end - start, start)
                found, held = [], 0
                for i in own:
                    found.append(parse(zlib.decompress(data[rows[i][1] - start : rows[i][1] - start + rows[i][2]], 31)))
                    held += len(found[-1]["payload"] or b"")
                    if held >= span:
                        yield pa.RecordBatch.from_pylist(found, schema=_PAGE)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=_PAGE)
        if source is not None:
            source.close()

    n = partitions(index.sparkSession)
    picked = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return picked.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, then read every record back; the payloads of revisits are those of their responses."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = write_archives(pages, folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
