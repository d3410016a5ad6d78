"""Exact byte-level BPE ids for whole texts, with a cache of space-delimited chunks.

The pre-tokenizer of the byte-level vocabulary never joins characters across a
space that stands alone between two non-space characters: the space opens the
next piece.  A text may therefore be cut at exactly those spaces, each chunk be
encoded once, and the ids of the chunks be joined; the result equals encoding
the whole text.  A block of texts is cut and its distinct chunks found by Arrow;
those not met before go to the ``tokenizers`` library in few calls, and the
texts' ids are gathered from a pool by NumPy.  Tokens that the vocabulary adds (such as
an end mark spelled out in a text) get their own ids, as the library gives them: a text is
cut at them first.  The cache has a bounded number of entries, is freed at the end
of each task and changes nothing but the speed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries kept in a task, some 200 bytes each; chunks met when it is full are kept for their block alone.
MAX_CHUNKS = 64_000
#: The same for a cache that outlives its task: at 250 000 a third of the chunks that a worker encodes are ones that it has met before.
KEPT_CHUNKS = 1_000_000
#: Characters that form a piece of their own after letters, and runs of them that are kept.
MARKS, MAX_MARKS = '.,;:!?%&*#$")', 10_000
#: Longer chunks are encoded but not kept.
MAX_CHUNK_CHARS = 64
#: Fresh chunks that go to the library in one call, in characters.
CALL_CHARS = 1 << 18

_ADJACENT = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class ChunkEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int | None = None):
        self.most = MAX_CHUNKS if most is None else most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added, self.added_ids = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None, added
        size = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self._clear()
        self.marks: dict[str, bytes] = {}

    def _clear(self) -> None:
        """No chunk: slot i has ``lens[i]`` ids in the pool from ``starts[i]`` on."""
        self.slots: dict[str, int] = {}
        self.starts, self.lens, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _put(self, parts: list[bytes], at: int) -> None:
        """Ids of consecutive slots from ``at`` on."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        end, need = at + len(parts), self.used + int(sizes.sum())
        while end > len(self.starts):
            self.starts, self.lens = np.concatenate([self.starts] * 2), np.concatenate([self.lens] * 2)
        while need > len(self.pool):
            self.pool = np.concatenate([self.pool] * 2)
        self.lens[at:end] = sizes
        self.starts[at:end] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : need] = np.frombuffer(b"".join(parts), "<u4")
        self.used = need

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _plain(self, text: str) -> bytes:
        return np.array(self._ids(text), dtype="<u4").tobytes()

    def _learn(self, chunks: list[str], out: dict[str, bytes]) -> None:
        """Encode chunks that follow a space.  Those that hold no space of their own go in
        one call: each begins with the only token of its own that opens with a space."""
        batch: list[str] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if batch:
                ids = np.array(self._ids(" " + " ".join(batch)), dtype="<u4")
                cuts = np.flatnonzero(self.opens[ids])
                raw, at = ids.tobytes(), (cuts * 4).tolist()
                if len(at) == len(batch):
                    out.update(zip(batch, (raw[a:b] for a, b in zip(at, at[1:] + [len(raw)]))))
                else:  # not met with this kind of vocabulary; exact all the same
                    out.update((c, self._plain(" " + c)) for c in batch)
                batch.clear()
                held = 0

        stems: set[str] = set()
        ended: list[tuple[str, str, str]] = []
        for c in chunks:
            if c.isalpha():
                batch.append(c)
                held += len(c) + 1
                if held >= CALL_CHARS:
                    flush()
            elif " " in c or not c or c[0].isspace() or c[-1].isspace():
                out[c] = self._plain(" " + c)
            elif (stem := c.rstrip(MARKS)) != c and stem.isalpha():  # letters, then marks that are a piece of their own
                ended.append((c, stem, mark := c[len(stem) :]))
                if stem not in self.slots:
                    stems.add(stem)
                if mark not in self.marks:
                    self.marks[mark] = self._plain(mark)
            else:
                batch.append(c)
                held += len(c) + 1
                if held >= CALL_CHARS:
                    flush()
        for c in stems.difference(out, chunks):
            batch.append(c)
            held += len(c) + 1
            if held >= CALL_CHARS:
                flush()
        flush()
        for c, stem, mark in ended:
            out[c] = (out[stem] if stem in out else self._slot(self.slots[stem])) + self.marks[mark]

    def _slot(self, i: int) -> bytes:
        return self.pool[self.starts[i] : self.starts[i] + self.lens[i]].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; an empty text has none."""
        if self.added is None or not any(map(self.added.search, texts)):
            return self._encode(texts)
        cut = [self.added.split(t) for t in texts]  # plain parts, with an added token between each two
        plain = iter(self._encode([p for parts in cut for p in parts[::2]]))
        return [b"".join(next(plain) if i % 2 == 0 else self.added_ids[p] for i, p in enumerate(parts)) for parts in cut]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.marks) > MAX_MARKS:
            self.marks.clear()
        # Arrow cuts texts in which every space is a lone one; the others are cut by the expression
        odd = [i for i, t in enumerate(texts) if _ADJACENT.search(t) or t[:1].isspace() or t[-1:].isspace()]
        easy = np.ones(len(texts), bool)
        easy[odd] = False
        easy_at = np.flatnonzero(easy)
        cut = pc.split_pattern(pa.array([texts[i] for i in easy_at], pa.large_string()), " ")
        odd_cut = [_LONE_SPACE.split(texts[i]) for i in odd]
        flat = pa.concat_arrays([cut.flatten(), pa.array([c for cs in odd_cut for c in cs], pa.large_string())])
        counts = np.concatenate([np.diff(cut.offsets.to_numpy()), np.fromiter(map(len, odd_cut), np.int64, len(odd_cut))])
        order = np.concatenate([easy_at, np.array(odd, np.int64)])
        coded = flat.dictionary_encode()
        chunks, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        first = np.cumsum(counts) - counts

        slots = self.slots
        known = np.fromiter(map(slots.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(known < 0).tolist()
        found: dict[str, bytes] = {}
        self._learn([chunks[i] for i in missing], found)
        keep = [c for c in found if len(c) <= MAX_CHUNK_CHARS][: self.most - len(slots)]
        self._put([found[c] for c in keep], len(slots))
        slots.update(zip(keep, range(len(slots), len(slots) + len(keep))))
        # for this block alone: long chunks and those beyond the bound, and each text's first chunk, which follows no space
        kept, used = len(slots), self.used
        long = [c for c in found if c not in slots]
        heads = [chunks[codes[i]] for i in first]
        self._put([found[c] for c in long] + [self._plain(c) if c else b"" for c in heads], kept)
        own = dict(zip(long, range(kept, kept + len(long))))
        known[missing] = [slots[c] if c in slots else own[c] for c in (chunks[i] for i in missing)]
        at = known[codes]
        at[first] = kept + len(long) + np.arange(len(heads))

        lens = self.lens[at]
        ends = np.cumsum(lens)
        place = np.repeat(self.starts[at] - (ends - lens), lens)
        place += np.arange(len(place))
        ids = self.pool.take(place)
        self.used = used
        bounds = np.concatenate([[0], ends])
        out: list[bytes] = [b""] * len(texts)
        for i, a, b in zip(order.tolist(), bounds[first].tolist(), bounds[first + counts].tolist()):
            out[i] = ids[a:b].tobytes()
        return out


_kept: dict[str, ChunkEncoder] = {}


@contextmanager
def encoder(path: str, keep: bool = False) -> Iterator[ChunkEncoder]:
    """An encoder of this vocabulary file for the length of a task; its memory is free afterwards for whatever the worker runs next.

    With ``keep`` it stays for the worker's next tasks, with the chunks it has met, at most KEPT_CHUNKS: for jobs of many small tasks, which would meet them anew.
    """
    if keep:
        if path not in _kept:
            _kept.clear()
            _kept[path] = ChunkEncoder(path, KEPT_CHUNKS)
        yield _kept[path]
        return
    e = ChunkEncoder(path)
    try:
        yield e
    finally:
        e.__dict__.clear()
