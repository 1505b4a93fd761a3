"""Keys of tables too large for one job a level: the same keys, over the rows that repeat a part of them."""

import random

import pytest

from tablewright.operators import dependencies, lattice

from .test_discovery import brute_keys


@pytest.mark.parametrize("sample,told", [(0, 1_000_000), (40, 1_000_000), (40, 0), (400, 5)])
def test_random_tables(spark, monkeypatch, sample, told):
    monkeypatch.setattr(lattice, "SMALL", 100)
    monkeypatch.setattr(lattice, "TOLD", told)
    rng, names = random.Random(5), ["a", "b", "c", "d", "_k"]
    for nulls in (0.0, 0.002):
        rows = [tuple(None if rng.random() < nulls else v for v in (rng.randrange(200), f"t{rng.randrange(40)}", rng.randrange(30), float(rng.randrange(3)) or -0.0, rng.randrange(300))) for _ in range(600)]
        df = spark.createDataFrame(rows, "a long, b string, c int, d double, _k long").repartition(3)
        work = dependencies.Work()
        assert {k.columns for k in dependencies.find_keys(df, sample=sample, work=work)} == brute_keys(rows, names)
        assert work.refuted + work.counted == work.candidates


def test_nulls_within_the_bound(spark, monkeypatch):
    df = spark.range(300).selectExpr("if(id % 3 = 0, null, id) as a", "if(id % 5 = 0, null, id div 2) as b", "id % 2 as c", "cast(null as int) as d")
    small = dependencies.find_keys(df, max_null_pct=100.0)
    monkeypatch.setattr(lattice, "SMALL", 100)
    assert dependencies.find_keys(df, max_null_pct=100.0, sample=0) == small and len(small) == 2
    half = dependencies.find_keys(df, max_size=2, min_uniqueness=0.5, max_null_pct=50.0)
    monkeypatch.setattr(lattice, "SMALL", 1000)
    assert dependencies.find_keys(df, max_size=2, min_uniqueness=0.5, max_null_pct=50.0) == half


def test_rows_are_not_shuffled_for_each_set(spark, monkeypatch):
    """Sets that share a nearly unique part are settled over its few repeated rows."""
    monkeypatch.setattr(lattice, "SMALL", 100)
    df = spark.range(20_000).selectExpr("if(id = 7, 8, id) as a", *[f"id % {m} as c{m}" for m in (2, 3, 5, 7, 11, 13)])
    counted, keyed = [], []
    count, key = dependencies._Repeated._count, dependencies._keyed
    monkeypatch.setattr(dependencies._Repeated, "_count", lambda self, xs: (counted.append(xs), count(self, xs))[0])
    monkeypatch.setattr(dependencies, "_keyed", lambda table, *rest: (keyed.append(table.count()), key(table, *rest))[1])
    found = dependencies.find_keys(df, sample=2000)
    assert {k.columns for k in found} == {("a", f"c{m}") for m in (2, 3, 5, 7, 11, 13)} and counted == [(0,)] and set(keyed) == {2}
