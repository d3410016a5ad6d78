import heapq

from pyspark.sql import functions as F

from ridgework.operators import grid


def test_accumulated_cost_of_a_deep_grid(spark):
    n = 404
    cells = spark.range(n).select(F.lit(10).alias("q"), F.col("id").cast("int").alias("r"), ((F.col("id") * 37) % 11).cast("double").alias("elev"), F.lit("grassland").alias("veg"), F.lit(False).alias("trail"))
    edges = grid.marked_edges(cells).withColumn("w", grid.route_cost())
    w = {}
    for e in edges.collect():
        w.setdefault((e["q"], e["r"]), []).append((e["w"], (e["b_q"], e["b_r"])))
    want, heap = {}, [(0.0, (10, 0))]
    while heap:
        cost, at = heapq.heappop(heap)
        if at not in want:
            want[at] = cost
            for step, to in w[at]:
                heapq.heappush(heap, (cost + step, to))
    for tile in (64, 40):
        got = {(r["q"], r["r"]): r["cost"] for r in grid.accumulated_cost(edges, cells.filter("q = 10 AND r = 0"), tile).collect()}
        assert len(want) == n and got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-3 for k in want)
    assert grid.accumulated_cost(edges, cells.filter("q = 99")).collect() == []
