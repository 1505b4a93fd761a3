"""A profile's passes take all columns in one scan each, with the values that numpy finds."""

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from tablewright.operators import profile

SHARES = list(profile.QUANTILES.values())


def test_scans_of_a_profile(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    data = {"a": rng.lognormal(3, 2, 3000), "b": rng.integers(0, 30, 3000).astype(float), "c": rng.permutation(3000.0 + np.arange(3000)), "d": np.full(3000, 4.0)}
    rows = [tuple(None if i % 7 == k else float("nan") if i % 11 == k else float(v) for k, v in enumerate(r)) for i, r in enumerate(zip(*data.values()))]
    spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(profile, "FEW", 50)
    monkeypatch.setattr(profile, "SAMPLED", 400)
    reads, inside = [], []
    for action in ("first", "collect"):

        def counted(self, *args, plain=getattr(DataFrame, action)):
            if not inside:  # first() collects
                reads.append(_scans(self))
            inside.append(1)
            try:
                return plain(self, *args)
            finally:
                inside.pop()

        monkeypatch.setattr(DataFrame, action, counted)
    found = {r.column: r for r in profile.columns(df, "t").collect()}
    assert max(reads[:-1]) == 1  # statistics and counts, and each pass of all columns
    assert reads[-1] <= len(data) + 1  # distinct values by column, and all intervals
    for k, (c, r) in enumerate(found.items()):
        kept = np.array([x[k] for x in rows if x[k] is not None and not np.isnan(x[k])])
        assert c == list(data)[k] and r.non_null == sum(x[k] is not None for x in rows) and r.total == 3000
        assert np.allclose([r[q] for q in profile.QUANTILES], np.quantile(kept, SHARES))


def _scans(df):
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum("parquet" in leaves.apply(i).toString() for i in range(leaves.size()))


def test_intervals_that_share_values(spark):
    """Small samples propose wide intervals, so those of neighbouring quantiles overlap."""
    x = np.random.default_rng(7).permutation(np.concatenate([np.arange(900.0), np.full(100, 450.0)]))
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(3)
    shares = [0.48, 0.5, 0.51, 0.52, 0.6]
    assert np.allclose(profile.exact_quantiles(df, "v", shares, accuracy=50, few=600, sampled=60), np.quantile(x, shares))


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 2, None)], "a double, b int, s string")
    a, b, s = sorted(profile.columns(df, "t").collect(), key=lambda r: r.position)
    assert (a.non_null, a.distinct, a.p50, a["min"]) == (0, 0, None, None) and (b.p25, b.p99, b.distinct) == (1.25, 1.99, 2) and (s.non_null, s.distinct) == (1, 1)
    assert [(r.total, r.distinct, r.p50) for r in profile.columns(df.where("b > 2"), "t").collect()] == [(0, 0, None)] * 3
