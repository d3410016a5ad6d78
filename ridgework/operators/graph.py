"""Connected components and ranks over all rows, both without a task that sees everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that has an edge (a, b) to another; nodes are of any type with an order, null ends have no edge.

    Alternating stars: each node links its larger neighbours to the least it knows, then its smaller ones, until no edge changes.
    The number of rounds grows with the logarithm of the number of nodes, for chains too; every round's edges are written.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "links")
    state = lambda x: x.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    before = state(e)
    while before["n"]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").select(F.col("b").alias("x"), "a", "m")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))).distinct()
        after = written(small, "links")
        dropped(e)
        dropped(large)
        e, now = after, state(after)
        if now == before:
            break
        before = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def running(df: DataFrame, order: list[Column | str], value: Column, out: str, within: list[str] | None = None) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the rows that come before by ``order``, of all rows or ``within`` those of some columns, however many they are.

    Rows are range-partitioned by (within, order); sums of the ranges, a row a range and value of ``within``, give the offsets.  ``order`` should tell all rows apart.
    """
    keys = within or []
    parts = written(df.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*keys, "_p").agg(F.sum("_v").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    same = F.col("_p") == F.col("_p2")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}2"))
    sums = sums.select(*(F.col(k).alias(f"_{k}2") for k in keys), F.col("_p").alias("_p2"), "_o")
    inside = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(sums, same).withColumn(out, F.col(out) + F.col("_o")).drop("_p", "_p2", "_o", "_v", *(f"_{k}2" for k in keys))


def ranked(df: DataFrame, order: list[Column | str], out: str = "rank", within: list[str] | None = None) -> DataFrame:
    """Add ``out``, the row's number from 1 by ``order``, over all rows or ``within`` the rows of some columns."""
    return running(df, order, F.lit(1).cast("long"), out, within).withColumn(out, F.col(out) + 1)
