import __spark_entry__ as entries


def test_entry(spark):
    got = entries.entry(spark)
    assert got.count() and {"plan", "resource", "level", "hours"} <= set(got.columns)


def test_names():
    queries, sql = entries.queries(), entries.oracle_sql()
    assert "equip_line_eval" in queries and sql.keys() <= queries.keys()
    assert all(map(callable, queries.values())) and all(isinstance(s, str) and s.strip() for s in sql.values())
