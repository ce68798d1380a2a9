import __spark_entry__ as entry


def test_catalog_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"timeline", "p4_found", "p7_found"} <= set(queries)
