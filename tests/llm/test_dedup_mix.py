import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ridgework.llm import common, exact_dedup, mixing

from .edge import documents

WS = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[WS.sub("", r["text"] or "")].append(r)
    out = Counter()
    for norm, g in groups.items():
        g.sort(key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        for i, r in enumerate(g):
            out[(r["doc_id"], g[0]["doc_id"], len(g), i == 0, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


def test_dedup_against_brute_force(spark, sf):
    for docs in (common.table(spark, sf, "documents"), documents(spark), documents(spark).limit(0)):
        assert Counter(map(tuple, exact_dedup.content_groups(docs).collect())) == brute(docs.collect())


def test_dedup_of_hot_texts(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    hot = spark.range(3000).select((F.col("id") + 10_000).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the  same").when(F.col("id") % 3 == 1, "the same").otherwise(None).alias("text"))
    docs = common.materialize(docs.unionByName(hot), "t")
    got = common.materialize(exact_dedup.content_groups(docs), "t")
    assert Counter(map(tuple, got.collect())) == brute(docs.collect())


def test_dedup_sql(spark, sf):
    got = exact_dedup.op5_content_sort_dedup(spark, sf)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(exact_dedup.SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    left, total, out = set(names), share * sum(sizes.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in left}
        for s in over:
            out[s] = cap * sizes[s]
            total -= out[s]
        left -= over
    return out


def check_mix(docs, rows, near):
    rows_in = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows_in:
        sizes[r["source"]] += size(r["text"])
    want = targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r["doc_id"], r["source"], size(r["text"])) for r in rows_in)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= near


def spread(rows, shard_slots=mixing.SHARD_SLOTS):
    """Words that a source's draws may be off its target: a source draws its residual slots of a shard with a variance of one at most; six deviations, and a short last block."""
    shards = 1 + 1.5 * sum(r["size"] for r in rows) / mixing.BLOCK_WORDS / shard_slots
    return mixing.BLOCK_WORDS * (2 + 6 * math.sqrt(shards))


def test_mix(spark, sf):
    docs = common.table(spark, sf, "documents")
    rows = mixing.mix_counts(docs).collect()
    check_mix(docs, rows, spread(rows))
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix_counts(docs.repartition(5)).collect()))


def test_mix_edge_rows(spark):
    rows = mixing.mix_counts(documents(spark)).collect()
    check_mix(documents(spark), rows, spread(rows))
    assert mixing.mix_counts(documents(spark).limit(0)).collect() == []


def test_draws_decide_what_is_taken(spark):
    """Another seed, or other shards, take other words; totals stay near the targets, within a hundredth in shards as they are by default."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    seen = set()
    for kw in ({}, {"seed": 5}, {"shard_slots": 256}, {"shard_slots": 1024}):
        rows = mixing.mix_counts(docs, **kw).collect()
        taken, target = Counter(), {}
        for r in rows:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert r["taken"] <= 2 * r["size"]
        near = spread(rows, kw.get("shard_slots", mixing.SHARD_SLOTS))
        assert all(abs(taken[s] - t) <= (near if "shard_slots" in kw else 0.01 * t) for s, t in target.items()), (kw, taken, target)
        seen.add(tuple(sorted((str(s), n) for s, n in taken.items())))
    assert len(seen) == 4


def test_many_sources(spark):
    """A source a document: targets by brute force, without a task that sees all sources."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 17 * 5), None if i == 7 else f"host{i:04d}") for i in range(1500)], "doc_id long, text string, source string")
    rows = mixing.mix_counts(docs).collect()
    sizes = {r["source"]: r["source_size"] for r in rows}
    want = targets(sizes)
    assert len(rows) == 1500 and all(r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(want.values())
    assert abs(sum(r["taken"] for r in rows) - total) < 0.1 * total


def test_mixed_documents_hold_the_words(spark, sf):
    docs = common.table(spark, sf, "documents")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    got = out.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n"))
    want = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(docs).collect() if r["taken"]}
    assert {r["doc_id"]: r["n"] for r in got.collect()} == want


def test_shards_are_drawn(spark, sf):
    """Every shard's counts over sources add up to its slots and differ from shard to shard; the shards hold all that is taken, a slot each once."""
    docs = common.table(spark, sf, "documents")
    rows = mixing.mix_shards(docs, shard_slots=128).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.mix_shards(docs, shard_slots=128).collect()}
    taken, slots = Counter(), defaultdict(set)
    for r in rows:
        taken[r["doc_id"]] += r["words"]
        slots[(r["source"], r["shard"])].add(r["slot"])
    assert taken == +Counter({r["doc_id"]: r["taken"] for r in mixing.mix_counts(docs, shard_slots=128).collect()})
    for source in {s for s, _ in slots}:
        own = [x for (s, _), xs in slots.items() if s == source for x in xs]
        assert sorted(own) == list(range(len(own)))  # numbered without gaps, up to the cap
    shards = sorted({k for _, k in slots})
    per = [sum(len(xs) for (_, k), xs in slots.items() if k == shard) for shard in shards]
    assert all(n <= 128 for n in per) and sum(n < 128 for n in per) <= len(per) / 4 + 1  # but for what is beyond a cap
    assert any(len({len(slots[(s, k)]) for k in shards}) > 1 for s in {s for s, _ in slots})


def test_deal_by_hand(spark):
    plan = spark.createDataFrame([("a", False, 700.5), ("b", False, 250.25), ("", True, 49.25), ("c", False, 0.25)], "_src string, _null boolean, slots double")
    rows = mixing.deal(plan, 100).collect()
    by = defaultdict(Counter)
    for r in rows:
        by[r["shard"]][r["_src"]] += r["drawn"]
    assert sorted(by) == list(range(10)) and all(sum(c.values()) == 100 for c in by.values())
    assert all(c["a"] >= 70 and c["b"] >= 25 and c[""] >= 4 for c in by.values())  # what is certain
    assert sum(c["a"] for c in by.values()) >= 700 and len({c["a"] for c in by.values()} | {c[""] for c in by.values()}) > 2
    other = mixing.deal(plan, 100, seed=3).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, rows)) and sorted(map(tuple, mixing.deal(plan, 100).collect())) == sorted(map(tuple, rows))
    assert mixing.deal(plan.limit(0), 100).count() == 0


def test_draws_follow_their_probabilities(spark):
    plan = spark.createDataFrame([(f"s{i}", False, 1000 * (0.1 + 0.9 * (i % 3 == 0))) for i in range(20)], "_src string, _null boolean, slots double")
    total = sum(1000 * (0.1 + 0.9 * (i % 3 == 0)) for i in range(20))
    rows = mixing.deal(plan, 8).collect()  # all expectations are below one slot: everything is drawn
    got = Counter()
    for r in rows:
        got[r["_src"]] += r["drawn"]
    chi = sum((got[f"s{i}"] - e) ** 2 / e for i in range(20) if (e := 1000 * (0.1 + 0.9 * (i % 3 == 0))))
    assert sum(got.values()) == round(total) and chi < 60  # 19 degrees of freedom


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 5, 7, 10, 97, 1000, 4099):
        got = spark.range(n).select(common.permuted(F.col("id"), F.lit(n).cast("long"), lambda r, half: F.xxhash64(F.lit(r), half)).alias("x")).collect()
        assert sorted(r["x"] for r in got) == list(range(n))


def test_running_start(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = common.running_start(rows, ["k"], ["id"], F.col("v"), "s", 4).collect()
    for k in range(3):
        of = sorted((r["s"], r["v"]) for r in got if r["k"] == k)
        at = 0
        for s, v in of:
            assert s == at
            at += v
