"""Edge cases that the driver's tables do not have: nulls, empty tables, ties, repeated rows, odd names."""

from tablewright.operators import dependencies, models, normalize, profile, quality, relationships
from tablewright.plans.dependencies import Dependency
from tablewright.sources import catalog


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_profile_of_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "`select` int, `名` string")
    got = {r.column: r for r in profile.columns(empty, "t").collect()}
    assert got["select"].total == 0 and got["select"].null_pct == 0 and not got["名"].is_unique
    nulls = spark.createDataFrame([(None,), (None,)], "a double")
    (r,) = profile.columns(nulls, "t").collect()
    assert (r.nulls, r.null_pct, r.distinct, r.mean, r.quality) == (2, 100.0, 0, None, 70.0)
    assert profile.histogram(nulls, "a").count() == 0 and profile.top_values(nulls, "a").count() == 0


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string")
    assert [r.value for r in profile.top_values(df, "v", 2).collect()] == ["c", "a"]


def test_dependency_with_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 5), (1, None), (2, None)], "x int, y int")
    (r,) = dependencies.check(df, ["x"], ["y"]).collect()
    assert (r.groups, r.violations, r.confidence) == (2, 1, 0.5)
    assert dependencies.violations(df, ["x"], "y").count() == 0  # nulls in X drop out
    assert dependencies.discover(df.where("false")) == []


def test_discovery_prunes_supersets(spark):
    df = spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (2, 1, "p"), (2, 2, "q")], "a int, b int, c string")
    found = {(d.determinant, d.dependent) for d in dependencies.discover(df, min_confidence=1.0)}
    assert found == {(("b",), "c"), (("c",), "b")}
    assert [k.columns for k in dependencies.find_keys(df)] == [("a", "b"), ("a", "c")]


def test_key_needs_values(spark):
    df = spark.createDataFrame([(None,), (1,)], "a int")
    (r,) = dependencies.check_keys(df, [["a"]]).collect()
    assert r.uniqueness == 1.0 and r.null_pct == 50.0 and dependencies.find_keys(df) == []


def test_references(spark):
    a, b = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int"), spark.createDataFrame([(1,), (2,), (2,)], "k int")
    (r,) = relationships.measure(a, "k", b, "k", ("a", "b"), 0.95).collect()
    assert (r.overlap, r.cardinality, r.null_pct) == (0.5, "1:N", 25.0)
    assert rows(relationships.orphans(a, "k", b, "k")) == [(9, 1)]


def test_rules_can_be_switched(spark):
    rules = quality.RuleSet()
    rules.add(quality.Rule("kinds", "kind", "in_set", 100.0, "LOW", values=("a", "b")))
    rules.enable("id_uniqueness", False)
    df = spark.createDataFrame([(1, "a"), (1, "z")], "x_id int, kind string")
    assert {(r.rule, r.passed) for r in quality.validate(df, "t", rules).collect()} == {("id_no_nulls", True), ("kinds", False)}
    assert rules.remove("kinds") and not rules.remove("kinds")
    assert quality.validate(df.select(), "t").count() == 0


def test_first_normal_form(spark):
    df = spark.createDataFrame([(1, ["x", "y"], "p, q,p", 7, None), (2, [], "", None, None)], "id int, tags array<string>, list string, phone1 int, phone2 int")
    assert rows(normalize.explode_array(df, ["id"], "tags", "t")) == [(1, "x", 1), (1, "y", 2)]
    assert rows(normalize.split_values(df, ["id"], "list", "t", ",")) == [(1, "p"), (1, "q")]
    assert rows(normalize.unpivot_group(df.select("id", "phone1", "phone2"), ["id"], ["phone1", "phone2"], "phone")) == [(1, "phone1", 7)]
    assert normalize.non_atomic(df) == ["tags"]


def test_lossless_and_lossy(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "k", "b")], "id int, k string, v string")
    assert rows(normalize.lost_or_gained(df, normalize.relations(df, [("id", "k"), ("k", "v")]))) == [(0, 0)]
    bad = spark.createDataFrame([(1, "k", "a"), (2, "k", "b")], "id int, k string, v string")
    assert rows(normalize.lost_or_gained(bad, normalize.relations(bad, [("id", "k"), ("k", "v")]))) == [(0, 2)]


def test_history_intervals_are_disjoint(spark):
    h = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 2, 2), (1, "b", 3, 3), (1, "c", 3, 4), (1, None, 5, 5)], "k int, v string, t int, i int")
    got = rows(models.scd2(h, ["k"], ["v"], "t", "i"))
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(None, 5, None, True), ("a", 1, 3, False), ("c", 3, 5, False)] or {(r[1], r[2], r[3]) for r in got} == {("a", 1, 3), ("c", 3, 5), (None, 5, None)}
    (r,) = models.scd3(h, ["k"], "v", "t", "i").collect()
    assert (r.current_v, r.previous_v) == (None, "c")


def test_satellite_increment(spark):
    stage = lambda data: models.vault_stage(spark.createDataFrame(data, "k int, v string, t timestamp_ntz"), "HK", ["k"], ["v"], "s", __import__("pyspark").sql.functions.col("t"))
    from datetime import datetime as dt

    old = models.satellite(stage([(1, "a", dt(2024, 1, 1)), (1, "b", dt(2024, 1, 2))]), "HK")
    new = models.satellite(stage([(1, "b", dt(2024, 1, 3)), (1, "c", dt(2024, 1, 4)), (2, "x", dt(2024, 1, 1))]), "HK", old)
    assert sorted(r.v for r in new.collect()) == ["c", "x"]
    again = models.satellite(stage([(1, "b", dt(2024, 1, 2))]), "HK", old)
    assert again.count() == 0


def test_ghost_once(spark):
    hub = models.hub(spark.createDataFrame([("a",), (None,)], "k string"), "h", ["k"], "s", __import__("pyspark").sql.functions.lit("2024-01-01").cast("date"))
    one = models.with_ghost(hub, "HK_h", ["k"])
    assert one.count() == 2 and models.with_ghost(one, "HK_h", ["k"]).count() == 2


def test_catalog(spark, tmp_path):
    t = catalog.TableSet(spark, {"Orders": spark.range(3).toDF("a"), "items": spark.range(2).toDF("b")})
    assert t.select(["^ord"]) == ["Orders"] and t.select(exclude=["item"]) == ["Orders"]
    assert rows(t.list_tables("i%")) == [("items", 2, 1)]
    assert t.query("select * from items", fetch_size=1).count() == 1
    assert catalog.redact("jdbc:postgresql://me:secret@host/db") == "jdbc:postgresql://me:***@host/db"
    (tmp_path / "d.json").write_text('{"a": 1}')
    assert catalog.load_document(str(tmp_path / "d.json")) == {"a": 1}
    catalog.write_files({"x/y.sql": "select 1"}, str(tmp_path))
    assert (tmp_path / "x/y.sql").read_text() == "select 1"


def test_dependency_row_shape(spark):
    df = dependencies.as_frame(spark, [Dependency(("a",), "b")])
    assert df.columns == ["determinant", "dependent", "confidence", "support", "groups", "violations", "is_partial", "is_transitive"]


def test_hub_stream(spark, tmp_path):
    from tablewright.streaming import loads

    src, out = str(tmp_path / "in"), str(tmp_path / "hub")
    spark.sql("select 1 as k, date'2024-01-01' as LOAD_DTS").write.parquet(src)
    for extra in (None, "select explode(array(1, 2)) as k, date'2024-01-02' as LOAD_DTS"):
        if extra:
            spark.sql(extra).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k int, LOAD_DTS date").parquet(src)
        loads.hub_stream(stream, "h", ["k"], "s", out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]


def test_personal_data_by_type_and_name():
    assert quality.pii_exposure({"mail": "email", "card_number": "unknown", "x": "unknown"}) == [("mail", "INFO", "email"), ("card_number", "HIGH", "credit card")]


def test_connectors_retry_and_break(spark):
    from tablewright.sources.registry import Connector, Registry, Unavailable

    waits, left = [], [2]

    def flaky(operation, params):
        if left[0]:
            left[0] -= 1
            raise OSError(operation)
        return spark.range(params["n"])

    r = Registry()
    r.add(Connector("a", flaky, ("query",), pause=waits.append))
    assert r.call("query", n=3).count() == 3 and waits == [1.0, 2.0]
    left[0] = 9
    for error in (OSError, Unavailable, Unavailable):
        try:
            r.call("query", "a" if error is OSError else None, n=1)
            raise AssertionError
        except error:
            pass
    r.connectors["a"].reset()
    assert r.able("query") == ["a"] and r.connectors["a"].healthy()


def test_exact_quantiles(spark):
    import numpy as np

    x = np.concatenate([np.random.default_rng(0).normal(size=5000), np.full(3000, 0.5)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    shares = [0.0, 0.1, 0.5, 0.73, 0.999, 1.0]
    assert np.allclose(profile.exact_quantiles(df, "v", shares, accuracy=100), np.quantile(x, shares))
    assert profile.exact_quantiles(df.where("false"), "v", [0.5]) == [None]


def test_selection_narrows(spark):
    """Few values a pass and small samples, over ties, skew and integers: as numpy says."""
    import numpy as np

    rng = np.random.default_rng(2)
    shares = [0.0, 0.1, 0.25, 0.5, 0.73, 0.999, 1.0]
    for x in (rng.lognormal(3, 4, 6000), np.repeat([1.0, 2.0, 2.5], [3000, 10, 2990]), np.full(500, 7.0), np.arange(4000.0), np.array([1.0, 2.0]), rng.integers(0, 40, 5000).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "v double").repartition(3)
        assert np.allclose(profile.exact_quantiles(df, "v", shares, accuracy=50, few=40, sampled=150), np.quantile(x, shares))


def test_samples_are_the_least_hashes(spark):
    import hashlib

    for n, copies in ((50, 1), (3000, 5)):
        df = spark.range(n * copies).selectExpr(f"concat('v', id % {n}) as v").union(spark.sql("select cast(null as string)"))
        want = sorted((f"v{i}" for i in range(n)), key=lambda v: hashlib.md5(v.encode()).hexdigest())[:100]
        assert [r.value for r in profile.sample_values(df, "v").collect()] == want
    assert profile.sample_values(df.where("false"), "v").count() == 0


def test_dimension_keeps_the_least_row(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, None, 1), (2, "z", 0)], "k int, x string, y int")
    assert sorted(tuple(r)[1:] for r in models.dimension(df, "d", ["k"], ["x", "y"]).collect()) == [(1, "a", 9), (2, None, 1)]
