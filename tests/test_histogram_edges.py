"""Values on the edge of a bucket fall where the SQL puts them, whatever the maximum is."""

import duckdb
import pytest

from tablewright import queries as registry


@pytest.mark.parametrize("high", [500.0, 500.04, 500.1, 560.21])
def test_edges(spark, tmp_path, high):
    duckdb.sql(f"copy (select (i / 100)::double as value from range({round(high * 100) + 1}) t(i)) to '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in registry.QUERIES["histogram_events_value"](spark, f"file://{tmp_path}").collect()]
    with duckdb.connect() as duck:
        duck.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
        assert sorted(got) == sorted(duck.sql(registry.ORACLES["histogram_events_value"]).fetchall())


def test_without_a_finite_width_there_is_one_unnumbered_bucket(spark, tmp_path):
    spark.sql("select explode(array(1d, 2d, double('nan'))) as value").write.parquet(f"{tmp_path}/events.parquet")
    (r,) = registry.QUERIES["histogram_events_value"](spark, f"file://{tmp_path}").collect()
    assert r.bucket is None and r.n == 3
