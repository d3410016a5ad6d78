"""Alignment of two tokenizers' ids over a corpus: groups of tokens between common byte offsets, counts of linked id pairs, scores of documents.

Neither vocabulary has a token that holds a space after a non-space, so a space between two non-spaces ends a token of both, and texts are cut
there: each distinct chunk of a task is encoded, aligned and its linked pairs are listed once, by NumPy, in a cache of bounded size.  A block of documents becomes
one row with its documents' figures and, for each stripe of A ids (a modulo the number of stripes, so that frequent ids are spread), one row with the
block's linked pairs, in how many of its documents each is, and in which.  Counting is partitioned by stripe: ``np.add.at`` adds up a dense block of
(A ids of the stripe) x (B ids).  Scoring sends a stripe's links to where its counts are, in parts where a stripe has many; row maxima of the block tell which
pairs are best.  A link row is scored as it passes, and its documents' partial sums return to their block.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mapped, materialize, partitions, table
from .token_store import default_tokenizer

#: A ids of a stripe: its dense block has WIDTH x (B ids) longs, 131 MB of 32 000.
WIDTH = 512
#: A block of documents closes at so many characters, or documents (their numbers are 16 bits).
BLOCK_CHARS, BLOCK_DOCS = 1 << 20, 1 << 16
#: The cache is emptied when it holds so many chunks or linked pairs; chunks that are learnt at once, in characters; pairs that are expanded at once.
MAX_CHUNKS, MAX_PAIRS, LEARN_CHARS, EXPAND = 200_000, 4_000_000, 1 << 18, 1 << 21
#: Chunks that go to the libraries as one text.
CALL = 64
#: Cells of a row of the table of counts.
SLICE = 1 << 20

_ADJACENT = re.compile(r"\s\s")
#: Chunks that can't be put between others with single spaces: at their ends is white space of any kind, or they hold the mark that one vocabulary has for a space.
_ODD = r"^$|\x{2581}|^[WS]|[WS]$".replace("WS", r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
_LONE_SPACE, _INNER = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\S ")
_BLOCKS = (
    "block long, stripe int, cells binary, held binary, docs binary, times binary, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
)
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_level() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def _pooled(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, starts, all bytes one after the other)."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(parts), np.uint8)


class Vocabularies:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        level = _byte_level()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(map(level.__getitem__, token)) if all(c in level for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether texts may be cut at a space between two non-spaces.
        self.cut = not any(_INNER.search(t.decode(errors="replace")) for t in self.bytes_a + self.bytes_b)
        (self.len_a, self.start_a, self.pool_a), (self.len_b, self.start_b, self.pool_b) = map(_pooled, (self.bytes_a, self.bytes_b))
        #: Ids in decimal, each with room for the mark that follows.
        numbers = [f"{i};".encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        sizes, self.decimal_starts, self.decimals = _pooled(numbers)
        self.digits = sizes - 1


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Byte offsets where tokens of both end."""
    return np.intersect1d(ends_a, ends_b, assume_unique=True)


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value[order], first) if len(key) else value


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Aligner:
    """Chunks of texts, each encoded and aligned once; chunk i of the cache has FIGURES in ``figures[i]``, its linked pairs and its groups as text in pools."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = [(np.zeros((0, 4), np.int64), *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint8))]
        self.n_pairs = 0

    def _arrays(self) -> tuple[np.ndarray, ...]:
        """figures, pairs a chunk, their codes a * (B ids) + b, how often each is linked, bytes of text a chunk, the texts; all learnt so far."""
        self.parts = [tuple(np.concatenate(p) for p in zip(*self.parts))]
        return self.parts[0]

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(A ids, B ids, bytes a chunk) of chunks that follow a space each; None if tokens' bytes aren't the text's."""
        v = self.v
        texts = [" ".join(chunks[i : i + CALL]) for i in range(0, len(chunks), CALL)]  # as texts, which are cut where chunks begin
        a = np.fromiter(chain.from_iterable(e.ids for e in v.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)), np.int64)
        b = np.fromiter(chain.from_iterable(v.b.encode(texts, num_threads=1)), np.int64)
        raw = np.frombuffer("".join(" " + t for t in texts).encode(), np.uint8)
        for ids, sizes, starts, pool in ((a, v.len_a, v.start_a, v.pool_a), (b, v.len_b, v.start_b, v.pool_b)):
            found = pool[_ranges(starts[ids], sizes[ids])]
            if len(found) != len(raw) or (found != raw).any():
                return None
        return a, b, pc.binary_length(pa.array(chunks, pa.large_string())).to_numpy() + 1

    def _learn(self, chunks: list[str]) -> None:
        """Append chunks, each of which follows a space, to the cache; one whose tokens' bytes aren't its own has no groups."""
        found = self._encoded(chunks)
        if found is None and len(chunks) > 1:
            for part in (chunks[: len(chunks) // 2], chunks[len(chunks) // 2 :]):
                self._learn(part)
            return
        self.slots.update(zip(chunks, range(len(self.slots), len(self.slots) + len(chunks))))
        n, n_b = len(chunks), len(self.v.bytes_b)
        if found is None:
            self.parts.append((np.zeros((1, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8)))
            return
        # chunks end in common offsets, so all are aligned as one text
        a, b, sizes = found
        ends_a, ends_b, last = np.cumsum(self.v.len_a[a]), np.cumsum(self.v.len_b[b]), np.cumsum(sizes)
        ends = group_ends(ends_a, ends_b)
        group_a, group_b, chunk = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b), np.searchsorted(last, ends)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        figures = np.zeros((n, 4), np.int64)
        np.add.at(figures, chunk, np.stack([in_a, in_b, np.ones_like(in_a), in_a * in_b], axis=1))
        owner, codes, times = self._pairs(a, b, group_a, group_b, chunk, n_b)
        text, sizes = self._text(a, b, in_a, in_b)
        self.parts.append((figures, np.bincount(owner, minlength=n), codes, times, np.bincount(chunk, sizes, n).astype(np.int64), text))
        self.n_pairs += len(codes)

    def _text(self, a, b, in_a, in_b) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all groups written as ``a1,a2|b1;``, bytes a group)."""
        v, to_a, to_b = self.v, np.cumsum(in_a), np.cumsum(in_b)
        # a group's A ids come after the B ids of the groups before, its B ids after its own A ids
        place_a, place_b = np.arange(len(a)) + np.repeat(to_b - in_b, in_a), np.arange(len(b)) + np.repeat(to_a, in_b)
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[to_a - 1]], mark[place_b[to_b - 1]] = ord("|"), ord(";")
        sizes = v.digits[ids] + 1
        text = v.decimals[_ranges(v.decimal_starts[ids], sizes)]
        text[np.cumsum(sizes) - 1] = mark
        return text, np.add.reduceat(sizes, to_a + to_b - in_a - in_b)

    def _pairs(self, a, b, group_a, group_b, chunk, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, code, times) of linked pairs, by chunk and code: distinct ids of a group meet, not their occurrences."""
        n_a = len(self.v.bytes_a)
        key_a, times_a = np.unique(group_a * n_a + a, return_counts=True)
        key_b, times_b = np.unique(group_b * n_b + b, return_counts=True)
        first_b = np.searchsorted(key_b, np.arange(len(chunk) + 1) * n_b)
        group, partners = key_a // n_a, np.diff(first_b)
        sizes = partners[group]
        slices = np.searchsorted(np.cumsum(sizes), np.arange(EXPAND, max(int(sizes.sum()), 1), EXPAND))
        keys, times = [], []
        for at in np.split(np.arange(len(key_a)), slices):
            with_b = _ranges(first_b[group[at]], sizes[at])
            of_a = np.repeat(at, sizes[at])
            code = (key_a[of_a] % n_a) * n_b + key_b[with_b] % n_b
            k, t = _summed(chunk[group[of_a]] * (n_a * n_b) + code, times_a[of_a] * times_b[with_b])
            keys.append(k)
            times.append(t)
        key, times = _summed(np.concatenate(keys), np.concatenate(times))
        return key // (n_a * n_b), key % (n_a * n_b), times

    def _chunks(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct chunks, the chunk of each occurrence, occurrences a text), in the order of the texts."""
        if not self.v.cut:
            coded = pa.array(texts, pa.large_string()).dictionary_encode()
            return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.ones(len(texts), np.int64)
        odd = {i for i, t in enumerate(texts) if _ADJACENT.search(t) or t[0].isspace() or t[-1].isspace()}
        easy = [i for i in range(len(texts)) if i not in odd]
        cut = pc.split_pattern(pa.array([texts[i] for i in easy], pa.large_string()), " ")
        odd_at = sorted(odd)
        odd_cut = [_LONE_SPACE.split(texts[i]) for i in odd_at]
        coded = pa.concat_arrays([cut.flatten(), pa.array([c for cs in odd_cut for c in cs], pa.large_string())]).dictionary_encode()
        sizes = np.concatenate([np.diff(cut.offsets.to_numpy()), np.fromiter(map(len, odd_cut), np.int64, len(odd_cut))]).astype(np.int64)
        starts, place = np.cumsum(sizes) - sizes, np.argsort(np.array(easy + odd_at, np.int64))
        return coded.dictionary.to_pylist(), coded.indices.to_numpy()[_ranges(starts[place], sizes[place])], sizes[place]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(FIGURES of each text, groups_sha256 of each, and by code and text: codes, text numbers, times linked)."""
        if len(self.slots) > MAX_CHUNKS or self.n_pairs > MAX_PAIRS:
            self._clear()
        full = [i for i, t in enumerate(texts) if t]
        chunks, codes, sizes = self._chunks([texts[i] for i in full]) if full else ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        fresh = [c for c in chunks if c not in self.slots]
        odd = pc.match_substring_regex(pa.array(fresh, pa.large_string()), _ODD).to_pylist() if self.v.cut else [True] * len(fresh)
        for c in [c for c, o in zip(fresh, odd) if o]:
            self._learn([c])
        fresh = [c for c, o in zip(fresh, odd) if not o]
        while fresh:  # in calls of bounded size; a longer chunk has a call of its own
            held, n = 0, 0
            while n < len(fresh) and (n == 0 or held + len(fresh[n]) <= LEARN_CHARS):
                held += len(fresh[n]) + 1
                n += 1
            self._learn(fresh[:n])
            fresh = fresh[n:]
        figures, n_pairs, pool, pool_times, n_text, text = self._arrays()
        first = np.cumsum(n_pairs) - n_pairs
        slot = np.fromiter(map(self.slots.__getitem__, chunks), np.int64, len(chunks))
        at = slot[codes] if len(codes) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(full)), sizes)
        ok = np.ones(len(full), bool)
        ok[doc[figures[at, 0] == 0]] = False  # a text with a chunk that isn't itself in bytes has no tokens
        out, hashes = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        ends = np.cumsum(sizes)
        sums = np.vstack([np.zeros((1, 4), np.int64), np.cumsum(figures[at], axis=0)])
        text_at = np.cumsum(n_text) - n_text
        for k, (i, x, y) in enumerate(zip(full, (ends - sizes).tolist(), ends.tolist())):
            if ok[k]:
                out[i] = sums[y] - sums[x]
                own = at[x:y]
                hashes[i] = hashlib.sha256(text[_ranges(text_at[own], n_text[own])][:-1].tobytes()).hexdigest()
        use = ok[doc]
        key, times = np.unique(doc[use] * max(1, len(self.slots)) + at[use], return_counts=True)
        doc, at = key // max(1, len(self.slots)), key % max(1, len(self.slots))
        own = _ranges(first[at], n_pairs[at])
        number = np.array(full, np.int64)[np.repeat(doc, n_pairs[at])] if len(at) else np.zeros(0, np.int64)
        key, times = _summed(pool[own] * BLOCK_DOCS + number, pool_times[own] * np.repeat(times, n_pairs[at]))
        return out, hashes, key // BLOCK_DOCS, key % BLOCK_DOCS, times


def stripes_of(codes: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(stripe, cell within its block) of pair codes."""
    n = -(-n_a // WIDTH)
    a = codes // n_b
    return a % n, (a // n) * n_b + codes % n_b


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Written rows of blocks: stripe -1 has the documents, the others the links of a stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies(path_a, path_b)
        aligner, task, turn = Aligner(v), TaskContext.get().partitionId(), 0
        types = {f.name: f.type for f in pa.schema([("block", pa.int64()), ("stripe", pa.int32()), *((c, pa.binary()) for c in ("cells", "held", "docs", "times")), *((c, pa.list_(pa.int64())) for c in ("doc_id", *FIGURES)), ("groups_sha256", pa.list_(pa.string()))])}

        def rows(ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
            block = (task << 32) | turn
            figures, hashes, codes, number, times = aligner.align(texts)
            stripe, cell = stripes_of(codes, len(v.bytes_a), len(v.bytes_b))
            order = np.lexsort((number, cell, stripe))
            stripe, cell, number, times = stripe[order], cell[order], number[order].astype("<u2"), times[order].astype("<u4" if times.max(initial=0) < 2**32 else "<u8")
            cols: dict[str, list] = {c: [None] for c in types} | {"block": [block], "stripe": [-1], "doc_id": [ids], "groups_sha256": [hashes]} | {c: [figures[:, i].tolist()] for i, c in enumerate(FIGURES)}
            new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (stripe[1:] != stripe[:-1])])) if len(cell) else np.zeros(0, np.int64)
            held = np.diff(np.concatenate([new, [len(cell)]]))
            for s in np.unique(stripe).tolist():
                i, j = np.searchsorted(stripe, [s, s + 1])
                x, y = np.searchsorted(new, [i, j])
                found = {"block": block, "stripe": s, "cells": cell[new[x:y]].astype("<u4").tobytes(), "held": held[x:y].astype("<u4").tobytes(), "docs": number[i:j].tobytes(), "times": times[i:j].tobytes()}
                for c in types:
                    cols[c].append(found.get(c))
            return pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in types.items()], list(types))

        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append(t)
                chars += len(t or "")
                if chars >= BLOCK_CHARS or len(ids) == BLOCK_DOCS:
                    yield rows(ids, texts)
                    ids, texts, chars, turn = [], [], 0, turn + 1
        if ids:
            yield rows(ids, texts)

    return materialize(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _BLOCKS), "align-blocks")


def _numbers(raw: bytes, n: int | None = None) -> np.ndarray:
    """Unsigned integers of four bytes, or of what ``n`` of them take."""
    return np.frombuffer(raw, f"<u{len(raw) // n}" if n else "<u4").astype(np.int64)


def _added(rows: DataFrame, keys: list[str], n_b: int) -> DataFrame:
    """Sum (cells, held) by ``keys``, of which the first is the stripe: rows of SLICE cells at most, cells in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now = np.zeros(WIDTH * n_b, np.int64), None

        def close() -> Iterator[pa.RecordBatch]:
            cells = np.flatnonzero(total)
            for part in np.split(cells, range(SLICE, len(cells), SLICE)):
                yield pa.RecordBatch.from_pydict({k: pa.array([x], pa.int32()) for k, x in zip(keys, now)} | {"cells": [part.astype("<u4").tobytes()], "held": [total[part].astype("<u8").tobytes()]})
            total[cells] = 0

        for batch in batches:
            for *key, cells, held in zip(*(batch.column(c).to_pylist() for c in (*keys, "cells", "held"))):
                if key != now:
                    if now is not None:
                        yield from close()
                    now = key
                at = _numbers(cells)
                np.add.at(total, at, _numbers(held, len(at)))
        if now is not None:
            yield from close()

    schema = ", ".join(f"{k} int" for k in keys) + ", cells binary, held binary"
    return mapped(rows.select(*keys, "cells", "held").repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys), run, schema)


def pair_counts(blocks: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """Written table stripe, cells, held: in how many documents each linked pair is.  With more partitions than stripes a stripe is added up in parts first."""
    links = blocks.filter("stripe >= 0")
    parts = -(-partitions(blocks.sparkSession) // -(-n_a // WIDTH))
    if parts > 1:
        links = _added(links.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")), ["stripe", "part"], n_b)
    return materialize(_added(links, ["stripe"], n_b), "align-counts")


def _scores(blocks: DataFrame, counts: DataFrame, n_b: int) -> DataFrame:
    """block, best, sums: what the links of a stripe add to n_best and count_sum of a block's documents."""
    n, links = partitions(blocks.sparkSession), blocks.filter("stripe >= 0")
    sizes = links.groupBy("stripe").agg(F.sum(F.length("docs")).alias("bytes"))
    share = sizes.agg(F.sum("bytes")).first()[0] or 1  # a row a stripe was summed
    parts = sizes.select("stripe", F.ceil(F.col("bytes") * n / share).cast("int").alias("parts"))  # a row a stripe: broadcast
    links = links.join(F.broadcast(parts), "stripe").select("stripe", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "block", "cells", "held", "docs", "times")
    known = counts.join(F.broadcast(parts), "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "cells", "held", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, most, used = np.zeros((WIDTH, n_b), np.int64), None, None, []
        flat = count.reshape(-1)
        for batch in batches:
            out: list[tuple] = []
            for stripe, part, kind, block, cells, held, docs, times in zip(*(c.to_pylist() for c in batch.columns)):
                if (stripe, part) != now:
                    for at in used:
                        flat[at] = 0
                    now, most, used = (stripe, part), None, []
                at = _numbers(cells)
                if kind == 0:
                    np.add.at(flat, at, _numbers(held, len(at)))
                    used.append(at)
                    continue
                if most is None:
                    most = count.max(axis=1)
                own = np.repeat(np.arange(len(at)), _numbers(held, len(at)))
                number = np.frombuffer(docs, "<u2").astype(np.int64)
                linked, c = _numbers(times, len(number)), flat[at]
                best, sums = np.zeros((2, int(number.max()) + 1), np.int64)
                np.add.at(sums, number, c[own] * linked)
                np.add.at(best, number, (c == most[at // n_b])[own] * linked)
                out.append((block, best.astype("<u4" if best.max() < 2**32 else "<u8").tobytes(), sums.astype("<u8").tobytes()))
            if out:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, t), v in zip((("block", pa.int64()), ("best", pa.binary()), ("sums", pa.binary())), zip(*out))})

    rows = known.unionByName(links).repartitionByRange(n, "stripe", "part").sortWithinPartitions("stripe", "part", "kind")
    return mapped(rows, run, "block long, best binary, sums binary")


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per row of ``docs``.

    A text is encoded as space + text by A and, by B, with the space it adds itself.  Null and empty texts, and those whose tokens' bytes aren't
    the text's, have no tokens: zeros and ''.  Rows with the same doc_id, or without one, are documents of their own, and count as such.
    """
    path_a, path_b = tokenizer_a or default_tokenizer(), tokenizer_b or default_pieces()
    n_a, n_b = _sizes(path_a, path_b)
    blocks = _blocks(docs, path_a, path_b)
    counts = pair_counts(blocks, n_a, n_b)
    scores = _scores(blocks, counts, n_b)
    columns = ("doc_id", *FIGURES, "groups_sha256")
    rows = blocks.filter("stripe = -1").select("block", F.lit(0).alias("kind"), *columns, F.lit(None).cast("binary").alias("best"), F.lit(None).cast("binary").alias("sums"))
    rows = rows.unionByName(scores.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = None, None

        def close() -> pa.RecordBatch:
            cols = known | {"n_best": total[0], "count_sum": total[1]}
            return pa.RecordBatch.from_arrays([pa.array(cols[c], pa.string() if c == "groups_sha256" else pa.int64()) for c in (*columns, "n_best", "count_sum")], [*columns, "n_best", "count_sum"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if known is not None:
                        yield close()
                    known = {c: row[c] for c in columns}
                    total = np.zeros((2, len(known["doc_id"])), np.int64)
                else:
                    sums = np.frombuffer(row["sums"], "<u8").astype(np.int64)
                    total[0, : len(sums)] += _numbers(row["best"], len(sums))
                    total[1, : len(sums)] += sums
        if known is not None:
            yield close()

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in FIGURES) + ", groups_sha256 string, n_best long, count_sum long"
    rows = rows.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind")
    return mapped(rows, run, schema).select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")


def aligned_pairs(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """a, b, n_docs, best: every linked id pair of the corpus, the number of documents that hold it linked, and whether that is its A id's highest."""
    path_a, path_b = tokenizer_a or default_tokenizer(), tokenizer_b or default_pieces()
    n_a, n_b = _sizes(path_a, path_b)
    blocks = _blocks(docs, path_a, path_b)
    counts = pair_counts(blocks, n_a, n_b)
    discard(blocks)
    n = -(-n_a // WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, cells, held in zip(*(batch.column(c).to_pylist() for c in ("stripe", "cells", "held"))):
                at = _numbers(cells)
                yield pa.RecordBatch.from_pydict({"a": (at // n_b) * n + stripe, "b": at % n_b, "n_docs": _numbers(held, len(at))})

    rows = mapped(counts, run, "a long, b long, n_docs long")
    most = rows.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row an A id
    return rows.join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _sizes(path_a: str, path_b: str) -> tuple[int, int]:
    v = Vocabularies(path_a, path_b)
    return len(v.bytes_a), len(v.bytes_b)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
