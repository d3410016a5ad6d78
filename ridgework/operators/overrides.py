"""Overrides of a plan's vegetation by spans of chainage, and of a catalogue by sparse patches.

A plan's spans are an array of one row, in the order in which they were made; touching ends overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import derived as derived_table

_SPANS = (
    "array(named_struct('s', (o_custkey % 10) * 50.0e0, 'e', (o_custkey % 10) * 50.0e0 + 300, 'veg', 'grassland'), named_struct('s', (o_orderkey % 8) * 60.0e0, 'e', (o_orderkey % 8) * 60.0e0 + 500, 'veg', 'heavyforest'){})"
)


def derived(spark, sf) -> DataFrame:
    """plan, enabled, route, spans: overrides derived from orders."""
    return derived_table(spark, sf, "orders", {"plan": "o_orderkey", "enabled": "o_orderkey % 7 <> 0", "route": "CASE WHEN o_orderkey % 5 = 0 THEN 'mediumscrub' END", "spans": f"CASE WHEN o_orderkey % 3 = 0 THEN {_SPANS.format('')} END"})


def derived_spans(spark, sf) -> tuple[DataFrame, DataFrame]:
    spans = derived_table(spark, sf, "orders", {"plan": "o_orderkey", "spans": _SPANS.format(", named_struct('s', 900.0e0, 'e', 1000.0e0, 'veg', 'lightshrub')")})
    new = derived_table(spark, sf, "orders", {"plan": "o_orderkey", "s": "(o_orderkey % 11) * 80.0e0", "e": "(o_orderkey % 11) * 80.0e0 + 100", "veg": "'mediumscrub'"})
    return spans, new


def effective(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add confidence and replace veg of rows (plan, mid, veg, conf) by their plan's enabled overrides; what is overridden is certain."""
    j = rows.join(overrides, "plan", "left").withColumn("_hit", F.expr("filter(spans, x -> mid BETWEEN x.s AND x.e)"))
    on, first = F.coalesce("enabled", F.lit(False)), F.expr("get(_hit, 0).veg")
    veg = F.when(on & first.isNotNull(), first).when(on & F.col("route").isNotNull(), F.col("route")).otherwise(F.col("veg"))
    return j.withColumn("confidence", F.when(on & (first.isNotNull() | F.col("route").isNotNull()), 1.0).otherwise(F.col("conf"))).withColumn("veg", veg).drop("_hit", "spans", "enabled", "route")


def put(spans: DataFrame, new: DataFrame) -> DataFrame:
    """The spans of each plan after a new one replaces all that it touches (replace_) or grows over them (merge_)."""
    j = spans.join(new, "plan").withColumn("_hit", F.expr("filter(spans, x -> NOT (e < x.s OR s > x.e))"))
    kept = "transform(filter(spans, x -> e < x.s OR s > x.e), x -> named_struct('replace_start', x.s, 'replace_end', x.e, 'merge_start', x.s, 'merge_end', x.e, 'veg', x.veg))"
    own = "named_struct('replace_start', s, 'replace_end', e, 'merge_start', least(s, array_min(transform(_hit, x -> x.s))), 'merge_end', greatest(e, array_max(transform(_hit, x -> x.e))), 'veg', veg)"
    return j.select("plan", F.posexplode(F.expr(f"concat({kept}, array({own}))")).alias("place", "x")).select("plan", "place", "x.*")
