def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
