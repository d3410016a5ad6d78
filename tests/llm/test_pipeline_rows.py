import re
from collections import Counter

import numpy as np

import corpus_pipeline as cp
from ridgework.llm import common, exact_dedup, mixing, ngram_join, quality

from .edge import documents
from .test_ngram import word_set


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def edge(spark):
    """The edge documents, with repeated rows and null doc_ids in numbers."""
    docs = documents(spark)
    more = [(5, "five words with doc id five in common here"), (5, "other words of a document that has the same id"), (None, "null id text"), (None, "another text with no id at all")]
    rows = spark.createDataFrame([(i, t, "en", "b", 0, 1, 2, 3, "h", "s") for i, t in more], docs.schema)
    return common.materialize(docs.unionByName(rows), "edge")


def test_classifier_decides_rows(spark, sf):
    docs, labels = edge(spark), common.table(spark, sf, "labels")
    model = quality.fit(quality.document_stats(docs), labels)
    want = Counter(tuple(r) for r in docs.collect() if model.score(np.array([quality.statistics(r["text"] or "")], np.float32).astype(float))[0] >= quality.THRESHOLD)
    assert rows_of(quality.keep_accepted(docs, labels)) == want


def test_all_accepted_rows_stay(spark, sf, monkeypatch):
    docs = edge(spark)
    monkeypatch.setattr(quality, "score", lambda stats, model: stats.selectExpr("*", "1 AS predicted"))
    assert rows_of(cp.keep_quality(spark, docs, sf)) == rows_of(docs)


def test_dedup_keeps_one_row_of_equal_texts(spark):
    docs = edge(spark)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    got = exact_dedup.keep_distinct(docs).collect()
    best = {}
    for r in docs.collect():
        rank = (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)
        best[norm(r["text"])] = min(best.get(norm(r["text"]), rank), rank)
    assert Counter((norm(r["text"]), (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)) for r in got) == Counter(best.items())


def test_near_copies_keep_one_row_of_a_group(spark):
    docs = edge(spark)
    rows = docs.collect()
    sets = [word_set(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = Counter()
    for g in set(group):
        of = [rows[i]["doc_id"] for i in range(len(rows)) if group[i] == g]
        want[min(of, key=lambda d: (d is None, d or 0))] += 1
    assert Counter(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == want


def test_mix_takes_each_row_for_itself(spark):
    docs = edge(spark)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, got = Counter(), Counter()
    for r in mixing.mix_counts(docs).collect():
        want[r["doc_id"]] += r["taken"]
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["doc_id"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got == +want
