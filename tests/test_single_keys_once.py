"""A search for keys of one column in a table that its sample holds whole counts nothing again."""

from tablewright.operators import dependencies


def test_a_whole_sample_settles_single_columns(spark):
    rows = [(i, i if i else None, 0.0 if i == 1 else -0.0 if i == 2 else float(i), float("nan") if i == 3 else float(i), f"v{i % 9}", None) for i in range(10)]
    df = spark.createDataFrame(rows, "a long, b long, c double, d double, e string, f int")
    work = dependencies.Work()
    found = dependencies.find_keys(df, max_size=1, work=work)
    assert [(k.columns, k.uniqueness, k.null_pct) for k in found] == [(("a",), 1.0, 0.0), (("d",), 1.0, 0.0)]
    assert work.jobs == 2  # the counts and the sample; 3 with a count of the columns
    assert [k.columns for k in dependencies.find_single_keys(df, max_null_pct=10)] == [("a",), ("b",), ("d",)]
    for sample in (0, 4, 100):
        assert dependencies.find_keys(df, max_size=1, max_null_pct=10, sample=sample) == dependencies.find_single_keys(df, max_null_pct=10)
    assert dependencies.find_single_keys(df.union(df), max_null_pct=10) == [] == dependencies.find_single_keys(df.where("a < 0"))
