"""WARC archives with revisit records instead of repeated payloads.

Headers (page_id, payload digest, payload size) are grouped by digest, which gives each payload's
response; pages join that decision, tasks write archives with fresh headers, and the archives are
read back record by record.  Payloads are shuffled only if the table of repeated digests is too
large to broadcast; then the join is a sort-merge join of two exchanges, which AQE splits on hot digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, mapped, materialize, table
from .token_store import put_file

#: An archive is closed when its payloads take so many bytes; a longer payload has an archive of its own.
ARCHIVE_BYTES = 16 << 20
#: Bytes of an archive that are decompressed at first for a record.
WINDOW = 1 << 10
#: Repeated digests up to this number (a few MB) are broadcast.
BROADCAST_DIGESTS = 50_000
DATE = "1970-01-01T00:00:00Z"
URN = "urn:ridgework:page:"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes, date: str = DATE) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an archive of gzip members.

    A member is fed in windows that double, so what is read beyond its end, and read again, is never more than the member itself or WINDOW.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts, window = zlib.decompressobj(31), [], WINDOW
        while not z.eof:
            if at >= len(view):
                raise ValueError("damaged archive")
            piece = view[at : at + window]
            parts.append(z.decompress(piece))
            at += len(piece)
            window *= 2
        at -= len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        yield headers, rest[: int(headers["Content-Length"])]


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Digests of at least ``min_bytes`` bytes that more than one row has, with the response's page_id: _sha1, _size, _first."""
    html = F.coalesce("html", F.lit(""))
    heads = pages.select("page_id", F.sha1(F.encode(html, "UTF-8")).alias("_sha1"), F.octet_length(html).cast("long").alias("_size"))
    groups = heads.groupBy("_sha1", "_size").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return groups.filter((F.col("_n") > 1) & (F.col("_size") >= min_bytes)).drop("_n")


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row below ``out``; returns the manifest: file, n_records, n_revisits.

    Of rows with equal payloads of at least ``min_bytes`` bytes those with the smallest page_id are
    responses (more than one only if that page_id is repeated) and the others revisit it; smaller payloads
    are all responses.  Null html is an empty payload.  A null page_id never is the smallest, unless all are null.
    """
    spark = pages.sparkSession
    repeated = materialize(resolve(pages, min_bytes), "warc-repeated")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("_sha1"))
    n = repeated.count()
    rows = rows.join(F.broadcast(repeated) if n <= BROADCAST_DIGESTS else repeated.hint("merge"), "_sha1", "left")
    again: Column = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    rows = rows.select("page_id", "url", "html", "_sha1", F.when(again, F.col("_first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = n_revisits = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n_revisits
            name = f"{uuid.uuid4().hex}.warc.gz"  # a failed task's archives are in no manifest
            put_file(f"{out}/{name}", b"".join(parts))
            row = pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([len(parts)], pa.int64()), "n_revisits": pa.array([n_revisits], pa.int64())})
            parts.clear()
            held = n_revisits = 0
            return row

        for batch in batches:
            for page_id, url, text, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = text.encode()
                kind = "response" if refers_to is None else "revisit"
                raw = record(kind, page_id, url, base32(sha1), len(payload), refers_to, payload if refers_to is None else b"")
                z = zlib.compressobj(1, wbits=31)
                parts.append(z.compress(raw) + z.flush())
                held += len(raw)
                n_revisits += refers_to is not None
                if held >= archive_bytes:
                    yield flush()
        if parts:
            yield flush()

    return materialize(mapped(rows, write, "file string, n_records long, n_revisits long"), "warc-manifest")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record in the manifest's archives.

    A response's digest and size are taken from the payload itself; a damaged one fails the task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    files = files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "content").join(F.broadcast(manifest.select("file")) if manifest.count() <= 100_000 else manifest.select("file"), "file", "left_semi")

    def number(value: str) -> int | None:
        tail = value.strip("<>").removeprefix(URN)
        return None if tail in ("null", "None") else int(tail)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                out = []
                for h, payload in records(data.as_py()):
                    digest, size, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), h["WARC-Type"]
                    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size):
                        raise ValueError("damaged payload")
                    out.append((number(h["WARC-Record-ID"]), size, digest, kind, number(h["WARC-Refers-To"]) if kind == "revisit" else None))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(cols[0], pa.int64()), "payload_bytes": pa.array(cols[1], pa.int64()), "payload_digest": pa.array(cols[2], pa.string()), "record_type": pa.array(cols[3], pa.string()), "refers_to": pa.array(cols[4], pa.int64())})

    return mapped(files.select("content"), read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    out = fresh_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), out)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, out, manifest)


#: A digest in base 32 from its bits.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM p), d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * get_bit(b, CAST(5 * i AS INTEGER)) + 8 * get_bit(b, CAST(5 * i + 1 AS INTEGER)) + 4 * get_bit(b, CAST(5 * i + 2 AS INTEGER)) + 2 * get_bit(b, CAST(5 * i + 3 AS INTEGER)) + get_bit(b, CAST(5 * i + 4 AS INTEGER)), 1)), '') AS digest
  FROM (SELECT *, CAST(unhex(h) AS BIT) AS b FROM f))
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
