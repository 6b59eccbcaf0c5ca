import __spark_entry__ as entry


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "model" in df.columns
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert all(callable(f) for f in queries.values())
    assert {f"p{n}_found" for n in range(1, 7)} <= set(queries)
