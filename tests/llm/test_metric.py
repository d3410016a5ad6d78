import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgework.llm import common, metric_search


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 2**32 - 1), n=st.integers(0, 700), dim=st.integers(1, 12), spread=st.sampled_from([1, 3, 200, 10**7]), hot=st.booleans())
def test_tree_finds_the_best(seed, n, dim, spread, hot):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(0, spread, (n, dim)))
    if hot:
        x[n // 3 :] = x[0] if n else 0
    ids = rng.permutation(n).astype(np.int64) * 3
    tree = metric_search.MTree(ids, x, leaf=8, fanout=4)
    for j in range(0, n, 67):
        want = sorted(((int(s), -int(i)) for s, i in zip(x @ x[j], ids) if i != ids[j]), reverse=True)[:5]
        assert tree.search(x[j], 5, int(ids[j])) == [(s, -i) for s, i in want]


def test_bounds_avoid_computations():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 1000, (40, 16)).repeat(100, axis=0) + rng.normal(0, 20, (4000, 16)))
    tree = metric_search.MTree(np.arange(4000), x)
    tree.search(x[7], 5, 7)
    assert tree.computed < 1000


@pytest.mark.parametrize("shard", [150, 4096])
def test_against_sql(spark, shard):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = metric_search.top_k(common.table(spark, sf, "embeddings"), shard=shard).collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(metric_search.SQL).fetchall())


def test_clusters_rule_out_shards(spark):
    """Of well separated clusters a query visits few cells, and still finds what all pairs give."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 4, (30, 8)).repeat(40, axis=0) * 256 + rng.normal(0, 8, (1200, 8))) / 256
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    used = metric_search.usable(rows).withColumn("dim", metric_search.F.size("v"))
    used = common.materialize(used, "t")
    data, cells = metric_search.cells_of(used, 1024, 40)
    assert len(cells.shards) > 10
    got = metric_search.top_k(rows, shard=40).collect()
    v = np.floor(256 * x)
    want = set()
    for i in range(0, 1200, 50):
        best = sorted((-int(v[i] @ v[j]), j) for j in range(1200) if j != i)[:5]
        want |= {(i, n, j, -sc) for n, (sc, j) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want
    floors = {(r["query_id"]): r["score"] for r in got if r["rank"] == 5}
    queries = used.filter("vec_id % 50 = 0").join(spark.createDataFrame([(i, float(s)) for i, s in floors.items()], "vec_id long, floor double"), "vec_id")
    visits = metric_search.routed(queries.select("vec_id", "v", "dim", "floor"), cells, False).count()
    assert visits < 0.5 * 24 * sum(cells.shards.values())


def test_edge_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (50, [3.0], 1), (None, [1.0, 1.0], 1), (100, [1e30, 1e30], 1), (7, [], 1), (150, [-1.0, -0.001], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in metric_search.top_k(docs).collect()}
    assert [got[0, i] for i in range(1, 5)] == [(100, 2**63 - 1), (1, 256 * 256 + 512 * 512), (1, 256 * 256 + 512 * 512), (150, -256 * 256 - 512)]
    assert (50, 1) not in got and (0, 5) not in got and (150, 4) in got
    assert metric_search.top_k(docs.limit(0)).collect() == []
