"""Joins with a table of keys by hash: the same rows, heavy keys dealt out, and no sorting of the rows."""

from pyspark.sql import functions as F

from tablewright.llm import common


def test_hashed_gives_the_same_rows_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(common, "CROWDED", 5)
    rows = spark.range(400).select(F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("key"), "id")
    keyed = common.stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "keys")
    plain, hashed = (common.heavy_join(rows, keyed, ["key"], "c", hashed=h) for h in (False, True))
    got = sorted(map(tuple, hashed.select("key", "id", "c").collect()))
    assert got == sorted(map(tuple, plain.select("key", "id", "c").collect())) and len(got) > 200
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    common.dropped(keyed)
