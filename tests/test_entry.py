import __spark_entry__ as e


def test_names_and_sql():
    names = e.queries()
    assert "conv_role_counts" in names and set(e.oracle_sql()) <= set(names)


def test_flagship(spark):
    df = e.entry(spark)
    assert df.count() > 0 and df.columns[0] == "conv_id"
