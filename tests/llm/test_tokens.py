import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridgework.llm import common, packing
from ridgework.llm import token_store as ts
from ridgework.llm.token_cache import ChunkEncoder

from .edge import documents


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(ts.default_tokenizer())


@pytest.fixture(scope="module")
def chunks():
    return ChunkEncoder(ts.default_tokenizer())


def raw(tok, text, end):
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(text=st.lists(st.sampled_from(["word", "don't", " ", "  ", "\n", "é.", "x,", "x.,", ".", "ß", "ª.", "１２", "12.", "<|endoftext|>", " ", "a's,", "Ünï."])).map("".join))
def test_cached_ids_equal_plain(tok, chunks, text):
    assert chunks.encode([text])[0] == raw(tok, text, 0)[:-4]
    spaced = " ".join(text)
    assert chunks.encode([spaced])[0] == raw(tok, spaced, 0)[:-4]


@settings(max_examples=100, deadline=None)
@given(sizes=st.lists(st.integers(0, 5000), max_size=900))
def test_elias_fano_selects_all(sizes):
    ends = np.cumsum(sizes, dtype=np.int64)
    low, lows, highs = ts.elias_fano(ends)
    b = ts.Boundaries(len(ends), low, lows, highs)
    assert b.ends(0, len(ends)).tolist() == ends.tolist()
    for i in range(0, len(ends), 37):
        assert b.end(i) == ends[i]
    assert len(lows) + len(highs) <= len(ends) * (2 + np.log2(max(1, ends[-1] if len(ends) else 1) / max(1, len(ends)) + 1)) / 8 + 3


def check_store(spark, tok, docs, tmp, **kw):
    m = ts.write_token_shards(docs, tmp, **kw)
    got = ts.read_token_shards(spark, tmp, m).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, at = [], 0
    for r in rows:
        x = raw(tok, r["text"], 0)
        want.append((r["doc_id"], at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_store_round_trip(spark, sf, tok):
    check_store(spark, tok, common.table(spark, sf, "documents"), common.fresh_path(spark, "t"), shard_bytes=20_000)


def test_store_edge_rows(spark, tok):
    check_store(spark, tok, documents(spark), common.fresh_path(spark, "t"))


def test_empty(spark, tmp_path):
    documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert ts.op10_token_store(spark, str(tmp_path)).collect() == []
    assert packing.op2_best_fit_packing(spark, str(tmp_path)).collect() == []


def check_pack(spark, tok, docs, rows, max_len):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        x = raw(tok, r["text"], 2)
        n = len(x) // 4
        first = (n - 1) % max_len + 1
        for i, (a, b) in enumerate([(0, first), *((a, a + max_len) for a in range(first, n, max_len))]):
            want[(r["doc_id"], i, a, b - a, zlib.crc32(x[4 * a : 4 * b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    return len(bins), -(-sum(r["length"] for r in rows) // max_len)


def test_packing(spark, sf, tok):
    docs = common.table(spark, sf, "documents")
    rows = packing.pack(docs).collect()
    got, least = check_pack(spark, tok, docs, rows, 1024)
    bins: list[int] = []
    for n in sorted((r["length"] for r in rows), reverse=True):  # best fit decreasing
        fits = [i for i, b in enumerate(bins) if b + n <= 1024]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += n
        else:
            bins.append(n)
    assert least <= got <= min(len(bins), 1.02 * least)
    check_pack(spark, tok, documents(spark), packing.pack(documents(spark), 64).collect(), 64)


def test_sequences_hold_the_ids(spark, sf, tok):
    docs = common.table(spark, sf, "documents")
    placed = common.materialize(packing.pack(docs), "placed")
    seq = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(docs, placed).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in placed.collect():
        part = seq[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert part == raw(tok, texts[r["doc_id"]], 2)[4 * r["start"] : 4 * (r["start"] + r["length"])]


def best_by_all_subsets(counts, room):
    sums = {0}
    for k, c in counts.items():
        sums = {s + k * t for s in sums for t in range(c + 1) if s + k * t <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), room=st.integers(0, 60))
def test_fullest_is_optimal(counts, room):
    got = packing.fullest(counts, room)
    assert all(0 < t <= counts[k] for k, t in got)
    assert sum(k * t for k, t in got) == best_by_all_subsets(counts, room)


@settings(max_examples=50, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=30))
def test_patterns_place_all(counts):
    left = Counter()
    for combo, bins in packing.patterns(counts, 64):
        assert sum(k * t for k, t in combo) <= 64
        for k, t in combo:
            left[k] += t * bins
    assert left == Counter(counts)


def test_a_kept_cache_meets_no_chunk_twice():
    """At the bound of one task's cache a worker encoded a third of its chunks again; what a small cache gives is the same."""
    import public_tokenizers

    from ridgework.llm import token_cache

    path = public_tokenizers.path("byte_bpe_50k.json")
    with token_cache.encoder(path, keep=True) as e:
        assert e.most == token_cache.KEPT_CHUNKS > token_cache.MAX_CHUNKS
        texts = [" ".join(f"w{i * j % 97}x," for i in range(50)) for j in range(9)] + ["", "a", " b  c "]
        ids = e.encode(texts)
        assert e.encode(texts) == ids
    assert ChunkEncoder(path, 5).encode(texts) == ids and len(ids[9]) == 0
