"""Token ids as binary shards whose document boundaries are Elias-Fano coded.

File format of a shard (little endian)::

    magic    4 bytes  b"EFT1"
    width    u32      bytes of an id: 2 or 4
    docs     u64      number of documents n
    ids      u64      number of ids u
    low      u32      bits of a boundary's low part, l
    high     u64      bytes of the high bit array
    doc ids  n x i64  (the smallest long stands for a null doc_id)
    lows     ceil(n * l / 8) bytes, packed, least significant bit first
    highs    bit (end_i >> l) + i is set for the i-th boundary
    array    u * width bytes, the concatenated ids

The boundaries are the end offsets of the documents, a non-decreasing sequence, so they take
about 2 + log2(u / n) bits each; ``select`` on the high bits returns any of them without a table
of 64-bit offsets.  Shards follow each other in ascending doc_id order.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, mapped, materialize, partitions, table

MAGIC, HEAD = b"EFT1", struct.Struct("<4sIQQIQ")
NULL_ID = -(2**63)
#: A shard is closed when its ids take so many bytes; a longer document has a shard of its own.
SHARD_BYTES = 8 << 20
#: Texts that are encoded at once, in characters.
ENCODE_CHARS = 1 << 20
#: Set bits between two samples of the select structure; bytes whose bits are counted at once to build it; boundaries read at once.
SELECT_EVERY, PIECE, RUN = 256, 1 << 16, 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """(low bits, packed lows, high bits) of a non-decreasing sequence of unsigned numbers."""
    n = len(ends)
    if not n:
        return 0, b"", b""
    ends = ends.astype(np.uint64)
    low = max(0, int(int(ends[-1]) // n).bit_length() - 1)
    bits = ((ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
    at = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1, np.uint8)
    high[at] = 1
    return low, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


class Boundaries:
    """Select over Elias-Fano coded end offsets: ``end(i)`` for one, ``ends(a, b)`` for a run."""

    def __init__(self, n: int, low: int, lows: bytes, highs: bytes):
        self.n, self.low = n, low
        self._lows, self._highs = np.frombuffer(lows, np.uint8), np.frombuffer(highs, np.uint8)
        # of every SELECT_EVERY-th set bit: the byte that holds it, and the set bits before that byte; the bytes are counted in pieces
        n_samples = -(-n // SELECT_EVERY)
        self._byte, self._rank = np.zeros(n_samples, np.int64), np.zeros(n_samples, np.int64)
        before = done = 0
        for a in range(0, len(self._highs), PIECE):
            counts = np.cumsum(np.bitwise_count(self._highs[a : a + PIECE]), dtype=np.int64)
            total = before + int(counts[-1])
            here = np.arange(done, min(n_samples, -(-total // SELECT_EVERY)))
            at = np.searchsorted(counts, here * SELECT_EVERY - before, side="right")
            self._byte[here] = a + at
            self._rank[here] = before + np.where(at > 0, counts[at - 1], 0)
            before, done = total, done + len(here)

    def _low_part(self, a: int, b: int) -> np.ndarray:
        if not self.low:
            return np.zeros(b - a, np.int64)
        first, last = a * self.low, b * self.low
        bits = np.unpackbits(self._lows[first // 8 : -(-last // 8)], bitorder="little")[first % 8 : first % 8 + last - first]
        return bits.reshape(b - a, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def ends(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.int64)
        k, stop = a // SELECT_EVERY, -(-b // SELECT_EVERY)
        first = int(self._byte[k])
        last = int(self._byte[stop]) + 1 if stop < len(self._byte) else len(self._highs)
        at = np.flatnonzero(np.unpackbits(self._highs[first:last], bitorder="little")) + 8 * first
        rank = int(self._rank[k])
        return ((at[a - rank : b - rank] - np.arange(a, b)) << self.low) + self._low_part(a, b)

    def end(self, i: int) -> int:
        return int(self.ends(i, i + 1)[0])


def write_shard(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The file of these documents; ids: little-endian unsigned 32-bit ids of each."""
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    low, lows, highs = elias_fano(ends)
    array = np.frombuffer(b"".join(ids), "<u4")
    if NULL_ID in doc_ids:
        raise ValueError(f"doc_id {NULL_ID} stands for null")
    keys = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, width, len(ids), len(array), low, len(highs))
    return b"".join([head, keys.tobytes(), lows, highs, array.astype(f"<u{width}").tobytes()])


class Shard:
    """Random access to the documents of a shard's file."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, self.n_ids, low, high = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        keys = np.frombuffer(data, "<i8", self.n, at)
        self.doc_ids = [None if k == NULL_ID else k for k in keys.tolist()]
        at += 8 * self.n
        size = -(-self.n * low // 8)
        self.boundaries = Boundaries(self.n, low, data[at : at + size], data[at + size : at + size + high])
        self.array = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + size + high)

    def span(self, i: int) -> tuple[int, int]:
        a = 0 if i == 0 else self.boundaries.end(i - 1)
        return a, self.boundaries.end(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.array[a:b]


def shared_fs(path: str):
    """(filesystem, path in it) of a URI in the shared folder, for writers in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{os.path.abspath(path)}")


def put_file(path: str, data: bytes) -> None:
    """Write whole files only: a retried or speculative task replaces the same name with the same bytes."""
    fs, p = shared_fs(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(draft := f"{p}.{uuid.uuid4().hex}.tmp") as f:
        f.write(data)
    fs.move(draft, p)


def write_token_shards(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 0, shard_bytes: int = SHARD_BYTES, n_partitions: int | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write shards below ``out`` in ascending doc_id order.

    Returns the manifest, a row per shard: task (range partition), shard (number in it), n_docs,
    n_ids.  A doc_id of -2 ** 63, which the file keeps for null, is refused.  Null text counts as empty and gives the end id alone; a null doc_id sorts first;
    rows with the same doc_id are all kept, ordered by text; an empty table writes no shard.
    Columns other than doc_id and text don't matter.
    """
    spark = docs.sparkSession
    path, n = tokenizer or default_tokenizer(), n_partitions or partitions(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("task"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_cache import encoder

        tail = struct.pack("<I", end_id)
        keys: list[int | None] = []
        ids: list[bytes] = []
        held, shard, width = 0, 0, 4

        def flush(task: int) -> pa.RecordBatch:
            nonlocal held, shard
            put_file(f"{out}/{task:06d}-{shard:06d}.eft", write_shard(keys, ids, width))
            row = pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([held // 4], pa.int64())})
            keys.clear()
            ids.clear()
            held, shard = 0, shard + 1
            return row

        task = 0
        with encoder(path, keep=True) as e:
            width = 2 if max(e.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
            for batch in batches:
                if not batch.num_rows:
                    continue
                task = batch.column("task")[0].as_py()
                for doc_ids, texts in text_blocks(batch):
                    for doc_id, x in zip(doc_ids, e.encode(texts)):
                        keys.append(doc_id)
                        ids.append(x + tail)
                        held += len(x) + 4
                        if held * width // 4 >= shard_bytes:
                            yield flush(task)
        if ids:
            yield flush(task)

    return materialize(mapped(rows, write, "task int, shard int, n_docs long, n_ids long"), "token-manifest")


def text_blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of a batch in blocks of bounded size."""
    doc_ids, texts = batch.column("doc_id"), batch.column("text")
    a, held = 0, 0
    for b, size in enumerate(pc.binary_length(texts).to_pylist(), 1):
        held += size or 0
        if held >= ENCODE_CHARS or b == batch.num_rows:
            yield doc_ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist()
            a, held = b, 0


def read_token_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The offsets come from the shards' select structures; the manifest gives the ids before each shard:
    sums within a task by window, and the tasks' totals, one row a range partition, before them.
    """
    inside = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = tasks.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_t"))
    bases = manifest.withColumn("_s", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(before, "task")
    bases = bases.select("task", "shard", (F.col("_s") + F.col("_t")).cast("long").alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eft").schema("path string, modificationTime timestamp, length long, content binary").load(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                task, shard = map(int, name.rpartition("/")[2].removesuffix(".eft").split("-"))
                s = Shard(data.as_py())
                for i in range(0, s.n, RUN):  # select gives a run's boundaries; no table of all is made
                    j = min(i + RUN, s.n)
                    ends = s.boundaries.ends(i, j)
                    starts = np.concatenate([[s.boundaries.end(i - 1) if i else 0], ends[:-1]])
                    crc = [zlib.crc32(s.array[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_pydict({"task": pa.array([task] * (j - i), pa.int32()), "shard": pa.array([shard] * (j - i), pa.int32()), "doc_id": pa.array(s.doc_ids[i:j], pa.int64()), "first": pa.array(starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    found = mapped(files.select("path", "content"), read, "task int, shard int, doc_id long, first long, n_tokens long, ids_crc32 long")
    # a row a shard: its size is proven by the manifest's count, which the hint follows
    bases = F.broadcast(bases) if manifest.count() <= 100_000 else bases
    return found.join(bases, ["task", "shard"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded, written as shards and read back."""
    out = fresh_path(spark, "tokens")
    manifest = write_token_shards(table(spark, sf_dir, "documents"), out)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_shards(spark, out, manifest)
