"""What loads leave on disk: no staged rows, no shuffle files, no versions that a query's own table has superseded; jobs of few buckets give the same table."""

import time
from pathlib import Path

import pytest

from tablewright import queries as registry
from tablewright.sources import bucketed


def shuffled(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [blocks.apply(i).getName() for i in range(blocks.size())]
    return {n for n in names if n.startswith("shuffle_")}


@pytest.mark.parametrize("at_once,task", [(2_000_000, 250_000), (200, 7)])
def test_a_load_leaves_only_its_version(spark, tmp_path, monkeypatch, at_once, task):
    monkeypatch.setattr(bucketed, "AT_ONCE", at_once)
    monkeypatch.setattr(bucketed, "TASK", task)
    frame = lambda first, v: spark.range(first, first + 600).selectExpr("cast(id % 500 as string) as k", "cast(id as int) as at", f"'{v}' as v")
    t = bucketed.BucketedTable(spark, f"file://{tmp_path}", frame(0, "").schema, ["k"], buckets=8)
    before = shuffled(spark)
    t.load(frame(100, "a"), 1)
    told = t.load(frame(0, "b"), 2)
    for _ in range(100):  # Spark deletes them beside its work
        time.sleep(0.1 if shuffled(spark) - before else 0)
    assert not shuffled(spark) - before
    assert (told.touched, told.rows_read) == (8, 500)
    assert {(r.k, r.at, r.v) for r in t.read().collect()} == {(str(i), i, "b" if i < 100 else "a") for i in range(500)} and t.read().count() == 500
    assert not list(Path(tmp_path, "staged").rglob("*.parquet")) and t.versions() == [1, 2]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("name", ["link_batches", "hub_batches", "sat_batches"])
def test_queries_keep_one_version(spark, sf, tmp_path, monkeypatch, name):
    monkeypatch.setattr(registry, "shared_folder", lambda spark, what: f"file://{tmp_path}/{what}")
    assert registry.QUERIES[name](spark, sf).count()
    assert len({p.parent.name for p in Path(tmp_path).rglob("*.parquet")}) == sum(1 for _ in Path(tmp_path).rglob("_bucket=*")) > 1
    assert len(list(Path(tmp_path).rglob("manifest/*.json"))) == 1


def test_equal_zeros_are_one_key(spark, tmp_path):
    rows = lambda x: spark.createDataFrame([(x, 1)], "k double, v int")
    t = bucketed.BucketedTable(spark, f"file://{tmp_path}", rows(0.0).schema, ["k"], buckets=64)
    t.load(rows(0.0), 1)
    t.load(rows(-0.0), 2)
    assert t.read().count() == 1
