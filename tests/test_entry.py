import __spark_entry__ as e


def test_queries_and_sql_agree_in_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p1_found", "p6_found", "inspect_stats"} <= set(e.queries())
