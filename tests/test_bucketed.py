"""Bucketed tables: batches in any order, repeated, late and half written give equal tables; only touched buckets are read."""

import itertools

import pytest

from tablewright.sources.bucketed import BucketedTable, _with
from tablewright.streaming import loads

SCHEMA = "k string, at int, v string"
BATCHES = {
    1: [("a", 5, "x"), ("b", 5, "x"), (None, 1, "n")],
    2: [("a", 3, "y"), ("c", 9, None), ("c", 9, "z")],
    3: [("b", 7, "w"), (None, 1, "m"), ("d", None, "q")],
}
WANT = {"a": (3, "y"), "b": (5, "x"), "c": (9, None), "d": (None, "q"), None: (1, "m")}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, path, **options):
    return BucketedTable(spark, f"file://{path}", frame(spark, []).schema, ["k"], **options)


def content(t, version=None):
    rows = [tuple(r) for r in t.read(version).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {k: (at, v) for k, at, v in rows}


@pytest.mark.parametrize("order", [*itertools.permutations(BATCHES), (3, 1, 3, 2, 1)])
def test_any_order_gives_the_same_table(spark, tmp_path, order):
    t = table(spark, tmp_path, buckets=4)
    assert content(t) == {}
    told = [t.load(frame(spark, BATCHES[n]), n) for n in order]
    assert content(t) == WANT
    assert [x.replayed for x in told] == [n in order[:i] for i, n in enumerate(order)]


def test_only_touched_buckets_are_read_and_kept_versions_stay(spark, tmp_path):
    t = table(spark, tmp_path, buckets=32)
    t.load(frame(spark, [(str(i), i, "v") for i in range(640)]), 1)
    before = t.manifest()
    one = t.load(frame(spark, [("7", 0, "w")]), 2)
    assert one.touched == 1 and 0 < one.rows_read < 640 / 8
    after = t.manifest()
    assert sum(after["buckets"][b] != before["buckets"][b] for b in before["buckets"]) == 1
    assert content(t)["7"] == (0, "w") and content(t, 1)["7"] == (7, "v")
    t.load(frame(spark, []), 3)
    assert t.manifest()["batches"] == [[1, 3]] and t.manifest()["buckets"] == after["buckets"]
    assert t.vacuum(keep=2) == 1 and len(content(t)) == 640 and t.versions() == [2, 3]


def test_a_batch_that_dies_before_its_manifest_leaves_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, buckets=4)
    t.load(frame(spark, BATCHES[1]), 1)
    kept = content(t)
    with monkeypatch.context() as m, pytest.raises(KeyError):
        m.setattr(t, "_publish", lambda manifest: {}["lost"])
        t.load(frame(spark, BATCHES[2]), 2)
    assert content(t) == kept
    t.load(frame(spark, BATCHES[2]), 2)
    t.load(frame(spark, BATCHES[3]), 3)
    t.vacuum(keep=1)
    assert content(t) == WANT


def test_a_second_writer_is_told(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4)
    t.load(frame(spark, BATCHES[1]), 1)
    with pytest.raises(RuntimeError, match="another writer"):
        t._publish(t.manifest())


def test_greatest(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4, keep="greatest")
    for n in (2, 1):
        t.load(frame(spark, BATCHES[n]), n)
    assert content(t) == {"a": (5, "x"), "b": (5, "x"), "c": (9, "z"), None: (1, "n")}


def test_ranges():
    assert _with(_with(_with([], 3), 1), 2) == [[1, 3]] and _with([[1, 1]], 5) == [[1, 1], [5, 5]]


def test_stream(spark, tmp_path):
    t = table(spark, tmp_path / "t", buckets=4)
    for n in (1, 2, 3):
        frame(spark, BATCHES[n]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    loads.table_stream(stream, t, lambda batch: batch, str(tmp_path / "cp")).awaitTermination()
    assert content(t) == WANT
