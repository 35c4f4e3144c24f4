import __spark_entry__ as entry


def test_contract(spark):
    names = set(entry.queries())
    assert len(names) > 150 and set(entry.oracle_sql()) <= names
    assert entry.entry(spark).columns == ["query_id", "item_id", "score", "rank", "snippet"]
