import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgework.llm import common, ngram_join

from .edge import documents


def word_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows):
    rows = [(r["doc_id"], word_set(r["text"])) for r in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, s in rows:
        for g in s:
            by[g].add(i)
    sets = dict(rows)
    for i, s in rows:
        for j in set().union(*(by[g] for g in s)) if s else ():
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(s), find(i)) for i, s in rows}


def test_shingles_count_as_words():
    for t in ("", "a", "a b c d", "a b c d e", "A b c d e f a B c d e", "x  y\tz\n\x0bw v\x1cu ü Ü", "a b c d e " * 9):
        assert len(ngram_join.shingles(t)) == len(word_set(t))


@settings(max_examples=100, deadline=None)
@given(a=st.sets(st.integers(0, 60), min_size=1), drop=st.sets(st.integers(0, 60), max_size=4), add=st.sets(st.integers(61, 64)), heavy=st.sets(st.integers(0, 64)))
def test_similar_sets_share_prefixes_under_each_order(a, drop, add, heavy):
    import numpy as np

    mix = lambda x: np.unique(ngram_join._mixed(np.array(sorted(x), np.uint64) + np.uint64(1)))
    b = (a - drop) | add
    if not b or 100 * len(a & b) < 80 * len(a | b):
        return
    f = mix(heavy) if heavy else np.zeros(0, np.uint64)
    f = ngram_join.Frequent(f, (f % np.uint64(5)) + np.uint64(1))
    for x, y in zip(ngram_join.prefixes(mix(a), f, 3), ngram_join.prefixes(mix(b), f, 3)):
        assert set(x.tolist()) & set(y.tolist())


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_groups_against_brute_force(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    got = {tuple(r) for r in ngram_join.near_groups(docs).collect()}
    assert got == brute(docs.collect())


def test_edge_rows(spark):
    got = sorted(map(tuple, ngram_join.near_groups(documents(spark)).collect()), key=str)
    assert len(got) == documents(spark).count()
    by = {r[0]: r for r in got}
    assert by[2] == (2, 0, 2) and by[3] == (3, 0, 3) and by[5] == (5, 2, 1) and by[6] == (6, 2, 1) and by[None] == (None, 1, None) and by[8][2] == 7
    assert ngram_join.near_groups(documents(spark).limit(0)).collect() == []


def test_chain_of_near_copies_and_shared_passage(spark):
    """Neighbours in the chain are similar, its ends aren't; many other texts share one passage."""
    words = [f"w{i}" for i in range(300)]
    chain = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(60))
    other = [(1000 + i, " ".join(f"o{i}x{j}" for j in range(10 + i % 25)) + " " + passage) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in chain + other], "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.near_groups(docs).collect()} == brute(docs.collect())


def test_keep_one(spark, sf):
    docs = common.table(spark, sf, "documents")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, _, c in brute(docs.collect()) if i == c}
    assert kept.filter(F.col("doc_id").isNull()).count() == 0


def test_words_that_collide_under_polynomials():
    """Thue-Morse words of 1024 characters have equal polynomial hashes modulo 2 ** 64."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert ngram_join.shingles(a).tolist() != ngram_join.shingles(b).tolist()


def test_word_blocks():
    import pyarrow as pa

    texts = ["", " ", "a b\tc\n\x0b\x0c\rd  e f ", "Ü É a", "A b C d e f", "a b c d e f"]
    got = ngram_join.word_hashes(pa.array(texts, pa.string()).slice(1))
    assert [len(h) for h in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts[1:]]
    assert got[1].tolist() == got[3].tolist() == got[4].tolist() == ngram_join.word_hashes(pa.array(texts[5:]))[0].tolist()
