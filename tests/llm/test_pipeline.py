import re

import corpus_pipeline as cp
from ridgework.llm import common, quality

from .test_dedup_mix import brute as equal_groups
from .test_ngram import brute as near_groups
from .test_tokens import check_pack, tok  # noqa: F401


def test_stages(spark, tok):  # noqa: F811
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    n = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    steps = [docs]
    for name, stage in cp.STAGES[:-1]:
        steps.append(common.materialize(stage(spark, steps[-1], sf), name))
        assert steps[-1].columns == docs.columns
    scored, distinct, one, mixed = steps[1:]
    rejected = {r["doc_id"] for r in quality.op7_quality_scores(spark, sf).collect() if not r["predicted"]}
    assert n(scored) == n(docs) - rejected and rejected
    assert n(distinct) == {i for i, keep, _, kept, _ in equal_groups(scored.collect()) if kept}
    assert n(one) == {i for i, _, c in near_groups(distinct.collect()) if i == c}
    rows, texts = mixed.collect(), {r["doc_id"]: r["text"] for r in one.collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert abs(sum(size(r["text"]) for r in rows) - 1.5 * sum(map(size, texts.values()))) < 96 * 20
    packed = cp.STAGES[-1][1](spark, mixed, sf).collect()
    check_pack(spark, tok, mixed, packed, 1024)


def test_run(spark, sf):
    got = cp.run(spark, sf)
    assert got.count() > 0 and "sequence_id" in got.columns
