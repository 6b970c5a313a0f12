"""WARC archives: one gzip member a record, written and read back.

Writing finds equal payloads first (digest and length, grouped with partial sums, so one hot payload costs a row a
task), then each task compresses its records into archives of a bounded size in the shared folder.  Reading is
sequential: zlib inflates a member piece by piece, the header's Content-Length frames the block, and both digests are
verified before a record counts.

Cases: a null payload is an empty one; equal payloads of at least ``least`` bytes are stored once, by the row with the
smallest page_id (null counts as larger than any), smaller ones always in full; repeated rows with one page_id each get
a record, and of equal ones with the smallest identifier the first that a task meets is no revisit of itself but both
are responses; an empty table makes no archive; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, slices, table, through_disk, work_dir

#: Compressed bytes after which a task begins a new archive, and bytes read or inflated at once.
ARCHIVE_BYTES, CHUNK = 256 << 20, 64 << 10
#: Payloads of fewer bytes are never stored as revisits.
LEAST = 0
#: Digests (some 150 bytes each in a hash table) that are sent to all tasks at most.
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response with its HTTP block, or a revisit whose block is the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    name = (urn or "none").strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a binary stream, verified; reads forward only, a chunk at a time."""
    rest = b""
    while True:
        if not rest:
            rest = source.read(CHUNK)
            if not rest:
                return
        member, out, need, fields, at = zlib.decompressobj(31), bytearray(), None, {}, 0
        while not member.eof:
            out += member.decompress(rest, CHUNK)
            rest = member.unconsumed_tail if not member.eof else member.unused_data
            if need is None and (end := out.find(b"\r\n\r\n")) >= 0:
                lines = bytes(out[:end]).decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("a record must begin with its version")
                fields = dict(x.split(": ", 1) for x in lines[1:])
                at, need = end + 4, end + 4 + int(fields["Content-Length"])
            if not rest and not member.eof:
                rest = source.read(CHUNK)
                if not rest:
                    raise EOFError("an archive ends inside a record")
        if need is None or len(out) != need + 4 or out[need:] != b"\r\n\r\n":
            raise ValueError("a record's length differs from its Content-Length")
        block = bytes(out[at:need])
        if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"{fields['WARC-Record-ID']}: the block's digest differs")
        yield fields, block


def payload_of(block: bytes) -> tuple[int, bytes]:
    """The payload's stated length and what the block holds of it."""
    head, _, body = block.partition(b"\r\n\r\n")
    n = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return n, body


def write_archives(pages: DataFrame, least: int = LEAST, at: str | None = None) -> DataFrame:
    """Writes an archive or more from each task under ``at``; gives the manifest: path, records.

    Only digests of payloads that occur more than once go to the join.  They are counted first: up to ``BROADCAST_ROWS``
    of them are sent to all tasks, more are joined by a shuffle, in which Spark splits hot digests.
    """
    spark = pages.sparkSession
    at = at or work_dir(spark, "warc")
    target, root = filesystem(at)
    target.create_dir(root, recursive=True)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.concat(F.sha2(html, 256), F.lit("/"), F.length(html)).alias("same"))
    shared = rows.where(F.length("html") >= least).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("same", "first")
    shared = through_disk(shared, "shared-payloads")
    few = shared.count() <= BROADCAST_ROWS  # then no payload is shuffled
    marked = rows.join(F.broadcast(shared) if few else shared, "same", "left").select(
        "page_id", "url", "html", F.expr("CASE WHEN page_id IS NULL OR page_id <> first THEN first END").alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = path = None
        size = n = 0

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

        for whole in batches:
            for batch in slices(whole):
                for r in batch.to_pylist():
                    if sink is None:
                        path = f"{at}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        system, inner = filesystem(path)
                        sink, size, n = system.open_output_stream(inner, compression=None), 0, 0
                    data = record_bytes(r["page_id"], r["url"], r["html"], r["refers_to"])
                    sink.write(data)
                    size, n = size + len(data), n + 1
                    if size >= ARCHIVE_BYTES:
                        yield closed()
                        sink = None
        if sink is not None:
            yield closed()

    return through_disk(marked.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null in revisits) of each record."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = filesystem(path)
                rows, size = [], 0
                with system.open_input_stream(inner, compression=None) as source:
                    for fields, block in read_records(source):
                        n, body = payload_of(block)
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(body) != n or base32_sha1(body) != digest):
                            raise ValueError(f"{fields['WARC-Record-ID']}: the payload's digest differs")
                        rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], n, digest, kind, _page(fields.get("WARC-Refers-To")), body.decode() if kind == "response" else None))
                        size += len(body)
                        if size > 16 << 20 or len(rows) >= 10_000:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    files = manifest.count()  # of archives, not of records
    return manifest.select("path").repartition(max(1, files)).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB: the same from the table; base32 turns five hexadecimal digits into four of its own.
OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 7), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT >> k) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM s
"""
