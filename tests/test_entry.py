import __spark_entry__ as E


def test_registry_is_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and "bm25_topk" in q


def test_entry_runs(spark):
    assert E.entry(spark).limit(3).count() == 3
