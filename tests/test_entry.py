import __spark_entry__ as entry_module


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["story_id", "pos", "sentence", "score"] + [f"r{k}" for k in range(1, 8)]
    assert df.count() > 1000


def test_registry():
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
