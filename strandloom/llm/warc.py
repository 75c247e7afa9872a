"""WARC archives: writing with revisits and segmentation, reading with segment reassembly.

Writing. Every page becomes a record whose block is an HTTP response. Pages of equal payloads of ``REVISIT_BYTES`` or
more are stored once: the one of the largest id is the response, the others are revisit
records that refer to it. Blocks over ``SEGMENT_BYTES`` are cut into a first record and continuation
records (WARC-Segment-Origin-ID, -Number, and on the last -Total-Length); bodies over ``CHUNKED_BYTES`` use chunked transfer framing. Archives
are plain WARC files, gzipped whole by Spark's writer, each of at most ``FILE_RECORDS`` records, in the shared folder.

Reading. Each archive is parsed by content lengths. Records in one piece are decoded where they are; only
segments are shuffled, by the id of their origin, sorted by number, joined, and their total length
verified. A record that is incomplete, has a gap or a wrong length is returned with ``ok`` false and without payload.

Defined results: a null page has the empty payload; rows with equal or null ids are records of their own (each has an id of
its own; of several responses' rows with the largest id all are responses); an empty table gives an empty
archive; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm._store import new_path

REVISIT_BYTES = 1000
SEGMENT_BYTES = 16384
CHUNKED_BYTES = 4096
FILE_RECORDS = 2000
CRLF = b"\r\n"

RECORD = "record_id string, origin_id string, segment int, total long, warc_type string, headers map<string,string>, block binary"
MESSAGE = "record_id string, warc_type string, headers map<string,string>, payload binary, ok boolean"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + CRLF for k, v in [*headers, ("Content-Length", str(len(block)))])
    return head + CRLF + block + CRLF + CRLF


def _one_line(value: str | None) -> str:
    return "".join(" " if c in "\r\n\0" else c for c in value or "")


def chunked(body: bytes, size: int) -> bytes:
    return b"".join(f"{len(body[k : k + size]):x}".encode() + CRLF + body[k : k + size] + CRLF for k in range(0, len(body), size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The body without its chunked framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        try:
            n = int(body[at:end].split(b";")[0].strip() or b"x", 16) if end >= 0 else -1
        except ValueError:
            return None
        if n < 0 or (n and body[end + 2 + n : end + 4 + n] != CRLF):
            return None
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def marked(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to. Only digests that repeat are joined back."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= least
    first = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    out = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunked_bytes: int = CHUNKED_BYTES, file_records: int = FILE_RECORDS) -> None:
    """pages: as made by marked(). A record's last byte is the line feed that Spark's text writer puts after each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for b in batches:
            out = []
            for x in b.to_pylist():
                ident = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{row} {x["page_id"]} {x["digest"]}'.encode()).digest())}>"
                row += 1
                body = x["payload"]
                common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _one_line(x["url"])), ("WARC-Payload-Digest", f"sha1:{x['digest']}"), ("X-Page-ID", "" if x["page_id"] is None else str(x["page_id"])), ("X-Payload-Length", str(len(body))), ("Content-Type", "application/http; msgtype=response")]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if x["record_type"] == "revisit":
                    own = [("WARC-Type", "revisit"), ("WARC-Record-ID", ident), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(x["refers_to"]))]
                    out.append(_record(own + common, head + CRLF))
                    continue
                framed = len(body) >= chunked_bytes
                block = head + (b"Transfer-Encoding: chunked\r\n\r\n" + chunked(body, chunked_bytes) if framed else f"Content-Length: {len(body)}\r\n\r\n".encode() + body)
                parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
                for k, part in enumerate(parts):
                    own = [("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", ident if not k else f"{ident[:-1]}-{k + 1}>")]
                    if len(parts) > 1:
                        own += [("WARC-Segment-Number", str(k + 1))] + [("WARC-Segment-Origin-ID", ident)] * (k > 0) + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts) - 1)
                    out.append(_record(own + (common if not k else common[:1]), part))
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], names=["record"])

    text = pages.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; stops at what isn't a record."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers.get("Content-Length", 0))
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives below path. An archive is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for data in b.column(0):
                data = data.as_buffer().to_pybytes()
                rows = []
                for h, block in parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    number, total = h.get("WARC-Segment-Number"), h.get("WARC-Segment-Total-Length")
                    ident = h.get("WARC-Record-ID")
                    rows.append((ident, h.get("WARC-Segment-Origin-ID", ident), int(number) if number else None, int(total) if total else None, h.get("WARC-Type"), list(h.items()), block))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def _decoded(block: bytes) -> bytes | None:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    lines = [x.lower() for x in head.split(CRLF)]
    if any(x.startswith(b"transfer-encoding:") and b"chunked" in x for x in lines):
        return unchunked(body)
    n = next((int(x.partition(b":")[2]) for x in lines if x.startswith(b"content-length:")), None)
    return body if n is None or n == len(body) else None


def reassembled(records: DataFrame) -> DataFrame:
    """One row a logical record, decoded."""
    names = [x.split()[0] for x in MESSAGE.split(", ")]
    types = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.to_pylist():
                parts = x["parts"]
                ok = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) or len(parts) == 1 and parts[0]["segment"] is None
                block = b"".join(p["block"] for p in parts)
                ok = ok and (parts[0]["segment"] is None or parts[-1]["total"] == len(block))
                body = _decoded(block) if ok else None
                if x["warc_type"] == "revisit":
                    body = b"" if ok else None
                rows.append((x["record_id"], x["warc_type"], x["headers"], body, body is not None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    part = F.struct("segment", "total", "block")
    whole = records.where("segment is null").select("record_id", "warc_type", "headers", F.array(part).alias("parts"))
    cut = records.where("segment is not null").groupBy(F.col("origin_id").alias("record_id")).agg(
        F.min_by("warc_type", "segment").alias("warc_type"), F.min_by("headers", "segment").alias("headers"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    return whole.unionByName(cut).mapInArrow(run, MESSAGE)


def read(spark: SparkSession, path: str) -> DataFrame:
    return reassembled(read_records(spark, path))


def report(messages: DataFrame) -> DataFrame:
    """page_id and what the payload is. A revisit has no body; its length and digest are those of its headers."""
    revisit = F.col("warc_type") == "revisit"
    h = lambda k: F.element_at("headers", k)
    return messages.select(
        F.expr("try_cast(element_at(headers, 'X-Page-ID') as bigint)").alias("page_id"),
        F.when(revisit, h("X-Payload-Length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(h("WARC-Payload-Digest"), ":", -1)).otherwise(F.sha1("payload")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(revisit, h("X-Refers-To-Page-ID").cast("long")).alias("refers_to"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(marked(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return report(read(spark, path))
