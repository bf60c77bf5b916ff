"""WARC archives: one gzip member for each record, read sequentially.

Writing: pages are numbered once, in a table written to the shared folder. Of records with equal payloads of at least
REVISIT_BYTES, the one with the largest page_id is a response and the others revisit it without repeating the payload.
Each task writes archives of its own under a name that no other attempt uses, and only archives of tasks that Spark
committed are listed in the manifest, so lost executors leave no record behind that is read twice.

Reading: archives are dealt out to tasks of about READ_BYTES each; in each, members are decompressed piece by piece with
zlib, the record is framed by its content length, and the payload's SHA-1 is compared with the header's.

Defined results: a null html is an empty payload; a null url becomes about:blank; an empty table
gives no rows; of repeated rows (same page_id, same payload) the first is the response, the others refer to
that page_id; a null page_id sorts below all others, and so does one that is no whole number; a record's id is made of its page's
row, so repeated page_ids have record ids of their own; very long pages are records like any other, one at a time in
memory; other columns are left out.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import joined_groups, prepare, qualified, shared_folder, text_or_empty, written

REVISIT_BYTES = 1000
#: An archive is closed and the next one begun after so many compressed bytes.
ARCHIVE_BYTES = 256 << 20
#: Compressed bytes that a task reads, about, and tasks at most.
READ_BYTES, MOST_READERS = 16 << 20, 100_000
CHUNK = 1 << 16
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DigestError(ValueError):
    """A record's payload doesn't have the digest that its header states."""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with a scheme (file:/x, as Spark writes it, counts as file:///x)."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def record_id(row) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{row}')}>"


def record_bytes(row: int, page_id, url, payload: bytes, digest: str, kind: str, refers_to=None, refers_row=None) -> bytes:
    """One record, uncompressed. A revisit has HTTP headers only; its own headers state the full payload's length."""
    target = quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    name = "null" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(row)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {name}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        other = "null" if refers_to is None else refers_to
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_row)}", f"X-Refers-To-Page: {other}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream: io.RawIOBase) -> Iterator[bytes]:
    """The content of each gzip member in turn; holds one record and one chunk."""
    unpacker, parts, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(CHUNK):
        parts.append(unpacker.decompress(data))
        rest = b""
        if unpacker.eof:
            rest = unpacker.unused_data
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
    if any(parts):
        raise EOFError("the archive ends within a record")


def parsed(record: bytes) -> dict:
    """Headers of a record and its payload, framed by Content-Length; the digest of a payload that is there is verified."""
    head, _, body = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    n = int(headers["content-length"])
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise ValueError("the record's content length doesn't fit its member")
    _, _, payload = body[:n].partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(headers["x-payload-length"])):
        raise DigestError(f"page {headers['x-page-id']}: payload doesn't match {digest}")
    number = lambda key: None if headers.get(key, "null") == "null" else int(headers[key])
    return {
        "page_id": number("x-page-id"), "url": headers["warc-target-uri"], "payload": payload if headers["warc-type"] == "response" else None,
        "payload_bytes": int(headers["x-payload-length"]), "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": number("x-refers-to-page"),
    }


def decided(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, payload, digest, record_type, refers_to, refers_row): pages with what each record is to be."""
    payload = F.encode(text_or_empty("html"), "UTF-8")
    rows = written(
        pages.select(
            F.monotonically_increasing_id().alias("row"), F.col("page_id").try_cast("long").alias("page_id"),
            F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"),
        ),
        "warc-pages",
    )
    # Of no page_id sorts last; of equal ones the first row is the response.
    best = F.max_by(F.struct("page_id", "row"), F.struct(F.col("page_id").isNotNull(), "page_id", -F.col("row")))
    long = F.octet_length("payload") >= REVISIT_BYTES
    groups = rows.filter(long).groupBy("digest").agg(best.alias("best"), F.count("*").alias("n")).filter("n > 1")
    groups = written(groups.select("digest", F.col("best.page_id").alias("first_page"), F.col("best.row").alias("first_row"), "n"), "warc-copies")
    met = joined_groups(rows, groups, ["digest"], "n", rows.count(), "row")
    revisit = F.col("first_row") != F.col("row")  # null where nothing is equal
    return met.select(
        "row", "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_page")).alias("refers_to"), F.when(revisit, F.col("first_row")).alias("refers_row"),
    )


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record for each page; returns the manifest (path, records, bytes) of what was committed."""
    prepare(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)

    def write(batches):
        out, path, records, size = None, "", 0, 0

        def listed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    system, name = opened(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(name, compression=None)
                member = gzip_member(record_bytes(row["row"], row["page_id"], row["url"], row["payload"], row["digest"], row["record_type"], row["refers_to"], row["refers_row"]))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    return written(decided(pages).mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_warc(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in a manifest, one archive after another in each task."""
    prepare(spark)
    archives, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(archives, MOST_READERS, max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))))
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = opened(path)
                rows, held = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for record in members(stream):
                        row = parsed(record)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return manifest.select("path").repartition(tasks).mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_warc(pages, shared_folder(spark, "warc"))
    return read_warc(spark, manifest, payloads=False).drop("url", "payload")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS best FROM p WHERE octet_length(b) >= 1000 GROUP BY d)
SELECT p.page_id, octet_length(p.b) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.best IS NULL OR g.best = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.best IS NOT NULL AND g.best <> p.page_id THEN g.best END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
