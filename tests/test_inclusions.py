"""All references from one inverted index against a join for each pair."""

from decimal import Decimal

from pyspark.sql import functions as F

from tablewright.operators import relationships
from tablewright.plans.names import ColumnInfo
from tablewright.queries import tableset


def rows(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_same_as_a_join_for_each_pair(spark, sf):
    tables = tableset(spark, sf)
    found = rows(relationships.infer(tables.tables, tables.infos(), min_overlap=0.0, strip_prefix=True), relationships.INFERRED)
    assert len(found) >= 8
    for r in found:
        single = relationships.measure(tables[r[0]], r[1], tables[r[2]], r[3], (r[0], r[2]), 0.85)
        assert rows(single, relationships.INFERRED) == [r]


def test_values_of_many_types(spark):
    """Nulls, empty tables, decimals of two scales, signed zeros, NaN, long texts, timestamps and arrays."""
    left = spark.createDataFrame(
        [(1, "x" * 50, Decimal("1.00"), 0.0, [1, 2]), (2, "y" * 50, Decimal("2.50"), float("nan"), None), (None, None, None, None, [3]), (2, "\x00", Decimal("9.00"), -0.0, [1, 2])],
        "i int, s string, d decimal(10,2), f double, a array<int>",
    )
    right = spark.createDataFrame([(1, "x" * 50, Decimal("1.0000"), -0.0, [1, 2]), (5, "y" * 49 + "z", Decimal("2.5000"), float("nan"), [3])], "i bigint, s string, d decimal(12,4), f float, a array<int>")
    tables = {"l": left, "r": right, "none": right.where("false")}
    pairs = [("l", c, t, c) for c in "isdfa" for t in ("r", "none")] + [("none", "i", "l", "i"), ("l", "i", "l", "i")]
    got = {r.pair: (r.distinct_values, r.matched, r.total, r.nulls) for r in relationships.shared_values(tables, pairs).collect()}
    assert [got[i] for i in range(0, 10, 2)] == [(2, 1, 4, 1), (3, 1, 4, 1), (3, 2, 4, 1), (2, 2, 4, 1), (2, 2, 4, 1)]
    assert all(got[i][1] == 0 for i in range(1, 10, 2)) and got[10] == (0, 0, 0, 0) and got[11] == (2, 2, 4, 1)
    inside = {tuple(r)[:4] for r in relationships.inclusions(tables).collect()}
    assert ("l", "f", "r", "f") in inside and ("l", "a", "r", "a") in inside and ("l", "i", "r", "i") not in inside
    assert not any("none" in r for r in inside)
    assert ("l", "d", "r", "d") in {tuple(r)[:4] for r in relationships.inclusions(tables, 0.6).collect()}


def test_hot_values_take_no_square(spark):
    """A third of all rows hold one value in every column: a value's group has a row for each column, no more."""
    hot = spark.range(30_000).select(*[F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(6)])
    got = {tuple(r)[:4] for r in relationships.inclusions({"t": hot}, 0.0).collect()}
    assert len(got) == 30
    many = spark.range(20).select(*[(F.col("id") + int(i == 69)).alias(f"c{i}") for i in range(70)])  # more columns than a word has bits
    got = [(r.from_column, r.to_column) for r in relationships.inclusions({"t": many}).collect()]
    assert len(got) == 69 * 68 and not any("c69" in p for p in got)
    info = {"t": [ColumnInfo("t", "u_id", "bigint")], "u": [ColumnInfo("u", "id", "bigint", True)]}
    tables = {"t": hot.select(F.col("c0").alias("u_id")), "u": spark.range(0)}
    assert [r.overlap for r in relationships.infer(tables, info, min_overlap=0.0).collect()] == [0.0]
