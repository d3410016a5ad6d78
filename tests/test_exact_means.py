"""Means at a limit do not depend on the order of rows."""

from ridgework.plans import catalog

LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def test_a_mean_confidence_of_the_limit_is_not_low(spark, tmp_path):
    """Confidences of 0.7, 0.64, 0.5, 0.51 and 0.65 in any order; as doubles their mean is 0.6 or just below."""
    parts = {1: (70, 4214, 2550, 15251, 16515), 2: (15251, 16515, 70, 4214, 2550), 3: (16515, 15251, 2550, 4214, 70), 4: (70, 4214, 2551, 15251, 16514), 5: (70, 4214, 2550, 15251, 16514)}
    rows = [(plan, part, 1, line, 10.0, 100.0, 0.01, 0.0, "A", "F") for plan, of in parts.items() for line, part in enumerate(of)]
    spark.createDataFrame(rows, LINEITEM).write.parquet(f"{tmp_path}/lineitem.parquet")
    low = {r["plan"] for r in catalog.QUERIES["insights_rules"](spark, str(tmp_path)).filter("id = 'low-confidence'").collect()}
    assert low == {5}
