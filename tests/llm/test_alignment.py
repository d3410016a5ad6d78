import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgework.llm import alignment as al

from .edge import documents


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def groups_of(text, a, b):
    """[(A ids, B ids)] by whole texts and a walk over both, or None."""
    level = {c: bytes([i]) for c, i in al._byte_level().items()}
    raw = b" " + text.encode()
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba = [b"".join(level[c] for c in a.id_to_token(i)) for i in ia]
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if b"".join(ba) != raw or b"".join(bb) != raw:
        return None
    out, i, j = [], 0, 0
    while i < len(ia):
        x, y, p, q = i + 1, j + 1, len(ba[i]), len(bb[j])
        while p != q:
            if p < q:
                p, x = p + len(ba[x]), x + 1
            else:
                q, y = q + len(bb[y]), y + 1
        out.append((ia[i:x], ib[j:y]))
        i, j = x, y
    return out


def brute(rows, a, b):
    found = [groups_of(t, a, b) if t else None for _, t in rows]
    held = Counter()
    for g in found:
        held.update({(x, y) for ga, gb in g or [] for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), g in zip(rows, found):
        if g is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for ga, gb in g for x in ga for y in gb]
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in g)
        out.append((doc_id, sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out), held, most


ODD = [
    "", None, "a", " ", "  a", "a  b", "a ", "\n", "x\ny z", "▁x", "a ▁ b", "<|endoftext|> and <s> </s> <unk> <0x0A>", "ünï çödé naïve", "日本語 テキスト です。", "🙂🙃 👩‍👩‍👧", "\x00 \x1c \x85 y", "tab\tx", "a　b  c", "don't we'll 1234567890 3.14", "é combining",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 300 + " " + "-" * 77, "internationalization of electroencephalographically", "the the the the", "ﬁ ½ ①",
]


def run(df):
    return Counter(map(tuple, al.align(df).select("doc_id", *al.FIGURES, "n_best", "count_sum", "groups_sha256").collect()))


def test_odd_texts_equal_brute_force(spark, libraries):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "the end"), (None, "the end"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, block int, stripe string").repartition(3)
    assert run(df) == brute(rows, *libraries)[0]


def test_documents_equal_brute_force(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], *libraries)[0]


def test_edge_rows_pairs_and_empty_table(spark, libraries):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, held, most = brute(rows, *libraries)
    assert run(docs) == want
    got = {(r.a, r.b): (r.n_docs, r.best) for r in al.aligned_pairs(docs).collect()}
    assert got == {p: (n, n == most[p[0]]) for p, n in held.items()}
    assert al.align(docs.limit(0)).count() == 0 and al.align(docs.filter(F.col("text").isNull())).count() == 1


def test_small_blocks_and_caches(libraries, monkeypatch):
    """Chunks alone give what whole texts give, whatever the cache holds."""
    monkeypatch.setattr(al, "MAX_CHUNKS", 3)
    monkeypatch.setattr(al, "LEARN_CHARS", 20)
    monkeypatch.setattr(al, "EXPAND", 7)
    v = al.Vocabularies(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert v.cut
    aligner = al.Aligner(v)
    for turn in range(2):
        for at in range(0, len(ODD), 4):
            figures, hashes, codes, number, times = aligner.align(ODD[at : at + 4])
            for i, t in enumerate(ODD[at : at + 4]):
                g = groups_of(t, *libraries) if t else None
                links = Counter(x * 32000 + y for ga, gb in g or [] for x in ga for y in gb)
                assert dict(zip(codes[number == i].tolist(), times[number == i].tolist())) == links
                assert figures[i].tolist() == ([sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values())] if g else [0] * 4)
                assert bool(hashes[i]) == (g is not None)


def test_long_group_without_common_ends(monkeypatch):
    """Distinct ids of a group meet, not their occurrences: quadratic links without quadratic work."""
    aligner = al.Aligner(al.Vocabularies(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")))
    n = 100_000
    owner, codes, times = aligner._pairs(np.zeros(n, np.int64), np.arange(n) % 2, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(1, np.int64), 32000)
    assert owner.tolist() == [0, 0] and codes.tolist() == [0, 1] and times.tolist() == [n * n // 2] * 2
