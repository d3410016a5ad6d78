"""Best-fit packing of token pieces into fixed-length sequences by minimum bin slack.

Pieces of one length are interchangeable, so packing needs only how many pieces each length has:
a histogram of at most ``max_len`` counts, whatever the size of the corpus.  Per bin a bitset
subset-sum dynamic program over the available lengths finds the fullest feasible combination;
the combination is removed as many times as the counts allow.  Each such pattern exhausts a
length, so there are about as many patterns as lengths.  The pieces then find their places with a
join: the r-th piece of a length takes the r-th slot that the patterns hold for that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, materialize, running_start, table
from .token_store import default_tokenizer, text_blocks

MAX_LEN = 1024
END_ID = 2
#: Slack allowed per bin, one try each.
SLACKS = (0, 1, 2, 4, 8, 16, 32)


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> list[tuple[int, int]]:
    """A combination of (length, times) whose sum is the largest up to ``room``, or at most ``slack`` less.

    Bit s of ``reach[i]`` says that the i smallest lengths can make the sum s.  Among the sums allowed,
    long pieces are taken first, as they are the hardest to place later.
    """
    full = (1 << (room + 1)) - 1
    lengths = sorted(k for k, c in counts.items() if c > 0 and 0 < k <= room)
    reach = [1]
    for k in lengths:
        bits, left, step = reach[-1], min(counts[k], room // k), 1
        while left > 0:  # 1, 2, 4 ... copies make any number up to the count
            take = min(step, left)
            bits |= (bits << (take * k)) & full
            left -= take
            step *= 2
        reach.append(bits)
    most, chosen = reach[-1].bit_length() - 1, []
    least = max(0, most - slack)
    for i in range(len(lengths), 0, -1):
        k = lengths[i - 1]
        times = min(counts[k], most // k)
        while times and not reach[i - 1] >> max(0, least - times * k) & ((1 << (most - max(times * k, least) + 1)) - 1):
            times -= 1
        if times:
            chosen.append((k, times))
            most, least = most - times * k, max(0, least - times * k)
    return chosen


def patterns(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[list[tuple[int, int]], int]]:
    """[(combination, how many bins take it)] that places all pieces, in the fewest bins of a few tries.

    A try allows each bin some slack, which leaves more short pieces for the last bins; the
    histogram is small, so trying costs little.
    """
    tries = (_patterns(counts, max_len, slack) for slack in SLACKS)
    return min(tries, key=lambda p: sum(bins for _, bins in p))


def _patterns(counts: dict[int, int], max_len: int, slack: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Each bin starts from the longest piece left."""
    left, found = {k: c for k, c in counts.items() if c > 0}, []
    while left:
        top = max(left)
        left[top] -= 1
        rest = fullest(left, max_len - top, slack)
        left[top] += 1
        combo = {top: 1}
        for k, t in rest:
            combo[k] = combo.get(k, 0) + t
        bins = min(left[k] // t for k, t in combo.items())
        for k, t in combo.items():
            left[k] -= t * bins
            if not left[k]:
                del left[k]
        found.append((sorted(combo.items(), reverse=True), bins))
    return found


def slot_rows(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times, first bin, offset): the pieces of a length with ranks in
    [first, end) fill a pattern's bins, ``times`` pieces a bin, from ``offset`` on."""
    used, base, rows = dict.fromkeys(counts, 0), 0, []
    for combo, bins in patterns(counts, max_len):
        offset = 0
        for k, t in combo:
            rows.append((k, used[k], used[k] + t * bins, t, base, offset))
            used[k] += t * bins
            offset += k * t
        base += bins
    return rows


def cut_pieces(docs: DataFrame, max_len: int = MAX_LEN, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False, keep: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit).

    A document's ids end with ``end_id``; only a document of more than ``max_len`` ids is cut, into
    pieces of ``max_len`` of which the first may be shorter.  Null text counts as empty and gives a
    piece of one id.  Rows with the same doc_id are documents of their own.  With ``keep`` a worker's cache of chunks outlives its task.
    """
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_cache import encoder

        tail = int(end_id).to_bytes(4, "little")
        with encoder(path, keep) as e:
            for batch in batches:
                for doc_ids, texts in text_blocks(batch):
                    out: list[tuple] = []
                    for doc_id, x in zip(doc_ids, e.encode(texts)):
                        raw = x + tail
                        n = len(raw) // 4
                        first = (n - 1) % max_len + 1
                        for i, a in enumerate([0, *range(first, n, max_len)]):
                            b = first if i == 0 else a + max_len
                            part = raw[4 * a : 4 * b]
                            out.append((doc_id, i, a, b - a, zlib.crc32(part), part))
                    cols = list(zip(*out))
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_pydict({names[i]: pa.array(cols[i], t) for i, t in enumerate(types)})

    return mapped(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), cut, schema)


def place(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Add sequence_id and offset to pieces that have doc_id, piece, start, length, ids_crc32.

    ``pieces`` is read more than once: give a written table.  No rows give no rows.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_len rows at most
    rows = slot_rows(counts, max_len)
    slots = spark.createDataFrame(rows or [], "length long, lo long, hi long, times long, first_bin long, at long")
    ranked = running_start(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "rank")
    # a row a length and pattern: bounded by max_len, not by the corpus
    packed = ranked.join(F.broadcast(slots), (ranked.length == slots.length) & (ranked.rank >= slots.lo) & (ranked.rank < slots.hi)).drop(slots.length)
    k = F.col("rank") - F.col("lo")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_bin") + F.floor(k / F.col("times"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(k, F.col("times")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, max_len: int = MAX_LEN, tokenizer: str | None = None, end_id: int = END_ID, keep: bool = False) -> DataFrame:
    """Pack all documents: a row per piece with its sequence and place."""
    return place(materialize(cut_pieces(docs, max_len, tokenizer, end_id, keep=keep), "pieces"), max_len)


def sequences(docs: DataFrame, placed: DataFrame, max_len: int = MAX_LEN, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary), from ``pack``'s rows; doc_ids must be distinct."""
    parts = cut_pieces(docs, max_len, tokenizer, end_id, with_ids=True).select("doc_id", "piece", "ids")
    rows = placed.join(parts, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # max_len ids at most a group
    return rows.select("sequence_id", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep=True)
