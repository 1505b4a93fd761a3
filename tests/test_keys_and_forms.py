"""Key choice, rule-based types, first normal form, vaults and documents on small cases."""

import pytest
from pyspark.sql import functions as F

from tablewright import pipeline
from tablewright.operators import dependencies, normalize, vault
from tablewright.plans import keys, semantics
from tablewright.plans.design import Design, DesignColumn, DesignTable, Relation
from tablewright.sources.catalog import TableSet


def key(*columns, uniqueness=1.0, null_pct=0.0):
    return dependencies.Key(columns, uniqueness, null_pct)


def test_recommended_key():
    found = [key("label"), key("code_name"), key("user_id"), key("id"), key("a", "b")]
    assert keys.recommend(found, declared=("x",)).columns == ("x",)
    for want in ("id", "user_id", "code_name", "label"):
        assert keys.recommend(found).columns == (want,)
        found = [k for k in found if k.columns != (want,)]
    assert keys.recommend([key("a", "b", "c"), key("a", "b")]).columns == ("a", "b")
    assert keys.recommend([], table="t", columns=("ID", "x")).columns == ("pk",)
    assert keys.surrogate("t", ("id", "pk", "row_id", "surrogate_id")) == "t_id"
    assert keys.best([key("a", "b"), key("a"), key("c")], recommended=("c",)).columns == ("c",) and keys.best([key("a", "b"), key("a")]).columns == ("a",) and keys.best([]) is None


def test_types_by_rules():
    assert semantics.by_rules("anything", "bigint", primary_key=True).type == "primary_key"
    assert semantics.by_rules("customer_email").type == "email" and semantics.by_rules("x", "jsonb").type == "json" and semantics.by_rules("zzz").type == "unknown"
    assert [semantics.quick_type(*c) for c in (("work_email", ""), ("order_date", "date"), ("unit_price", ""), ("is_new", ""), ("customer_id", ""), ("q", "uuid"), ("q", ""))] == ["email", "timestamp", "currency", "boolean", "foreign_key", "uuid", "unknown"]
    assert semantics.quick_type("id", "", primary_key=True) == "primary_key"


def test_first_form(spark):
    df = spark.createDataFrame(
        [(1, "a", None, ["x", "y"], '{"n": 1, "f": 1.5}', '["p"]', "[1]", "u, v,u", "Ann Lee"), (2, None, "b", [], '{"n": 2}', None, '{"k": 1}', None, "Bo")],
        "id int, phone1 string, phone2 string, tags array<string>, j string, l string, m string, list string, who string",
    )
    got = normalize.first_form(df, "t", ["id"], {"list": ","}, {"who": " "} and None)
    assert set(got) == {"t", "t_phone", "t_tags", "t_l", "t_list"} and got["t"].columns == ["id", "who", "j_f", "j_n"]
    assert sorted(map(tuple, got["t"].collect())) == [(1, "Ann Lee", 1.5, 1), (2, "Bo", None, 2)]
    assert sorted(map(tuple, got["t_phone"].collect())) == [(1, "phone1", "a"), (2, "phone2", "b")]
    assert sorted(map(tuple, got["t_tags"].collect())) == [(1, "x", 1), (1, "y", 2)]
    assert sorted(map(tuple, got["t_l"].collect())) == [(1, "p", 1)] and sorted(r[1] for r in got["t_list"].collect()) == ["u", "v"]
    side = normalize.first_form(df.select("id", "j"), "t", ["id"], separate=True)
    assert side["t"].columns == ["id"] and side["t_j"].columns == ["t_id", "f", "n"] and side["t_j"].count() == 2


def test_vault(spark):
    people = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, "c", None)], "pid int, name string, city int")
    cities = spark.createDataFrame([(7, "x"), (9, "y")], "cid int, title string")
    column = lambda n, r="attribute": DesignColumn(n, role=r)
    design = Design("data_vault", (
        DesignTable("dim_person", "dimension", (column("pid", "business_key"), column("name")), "people"), DesignTable("city", "", (column("cid", "business_key"), column("title")), "cities"),
        DesignTable("fact_lives", "fact", (), "people"), DesignTable("odd", "", (), "people"),
    ), (Relation("fact_lives", ("pid",), "dim_person", ("pid",)), Relation("fact_lives", ("city",), "city", ("cid",))))
    assert [vault.kind(t) for t in design.tables] == ["hub", "hub", "link", None]
    snapshots = spark.sql("select timestamp_ntz'2024-02-01' as snapshot")
    got = vault.build({"people": people, "cities": cities}, design, F.lit("2024-01-01").cast("timestamp_ntz"), "test", snapshots, ghosts=True)
    assert {t: df.count() for t, df in got.items()} == {"HUB_person": 4, "SAT_person": 3, "PIT_person": 3, "HUB_city": 3, "SAT_city": 2, "PIT_city": 2, "LINK_lives": 2}
    failed = {(r.table, r.column, r.test): r.failures for r in vault.checks(got).collect() if r.failures}
    assert failed == {("LINK_lives", "HK_city", "refers"): 1}


def test_document_and_summary(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (2, "a@b.co"), (3, None)], "id int, email string")
    got = pipeline.document(df, "t")
    assert got["rows"] == 3 and [c["column"] for c in got["columns"]] == ["id", "email"]
    assert got["columns"][1]["patterns"][0]["pattern"] == "email" and got["columns"][1]["top_values"][0]["n"] == 2 and len(got["columns"][0]["samples"]) == 3
    analysis = pipeline.analyze(TableSet(spark, {"t": df}), max_determinant=1, max_key=1)
    row = pipeline.summary(analysis).first()
    assert (row.tables, row.columns, row.rows, row.keys) == (1, 2, 3, 1)


@pytest.mark.parametrize("word, table, same", [("category", "categories", True), ("Box", "boxes", True), ("knife", "knives", True), ("person", "people", True), ("news", "new", False), ("user", "orders", False)])
def test_same_noun(word, table, same):
    from tablewright.plans.names import same_noun

    assert same_noun(word, table) == same


def test_declared_references_are_told_and_not_measured(spark):
    from tablewright.operators import relationships
    from tablewright.plans.names import ColumnInfo

    tables = {"users": spark.createDataFrame([(1,), (2,)], "id int"), "orders": spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id int, user_id int")}
    info = {"users": [ColumnInfo("users", "id", "int", True, True, False)], "orders": [ColumnInfo("orders", "id", "int", True, True, False), ColumnInfo("orders", "user_id", "int")]}
    assert [(r.overlap, r.confidence) for r in relationships.infer(tables, info).collect()] == [(1.0, "HIGH")]
    got = relationships.infer(tables, info, references=(("orders", "user_id", "users", "id"),)).collect()
    assert [(r.from_column, r.to_table, r.cardinality, r.overlap, r.confidence) for r in got] == [("user_id", "users", "1:N", None, "HIGH")]


def test_json_paths_of_any_depth(spark):
    """Escapes, brackets in strings, empty containers, deep nesting, scalars, text that is no JSON."""
    deep = "[" * 12 + "1" + "]" * 12
    texts = [r'{"a\"]": "[{\\", "b": {}}', "[]", "3", '"s"', "null", "no json", None, "", deep, '[{"x": [1]}, [{"x": false}]]']
    got = {(r.path, r.type): r.n for r in normalize.json_paths(spark.createDataFrame([(t,) for t in texts], "j string"), "j").collect()}
    assert got[('$.a"]', "string")] == 1 and got[("$.b", "object")] == 1 and got[("$", "integer")] == 1 and got[("$", "string")] == 1 and got[("$", "null")] == 1
    assert got[("$" + "[]" * 12, "integer")] == 1 and got[("$[][].x", "boolean")] == 1 and got[("$[].x[]", "integer")] == 1 and got[("$", "array")] == 3
    assert normalize.json_paths(spark.createDataFrame([], "j string"), "j").count() == 0


def test_structures_of_all_text_columns(spark):
    df = spark.createDataFrame([("[1,2]", '{"k": 1}', "a|b", None), ("[]", '{"k": 2}', "c|d", None), ("[3]", "x", "e|f", None)] * 2, "arr string, obj string, list string, none string")
    got = {r.column: r for r in normalize.structures(df).collect()}
    assert (got["arr"].kind, got["arr"].mean_length, got["arr"].is_json) == ("array", 1.0, True)
    assert (got["obj"].kind, got["obj"].is_json, got["list"].delimiter, got["list"].kind) == ("object", False, "|", None)
    assert (got["none"].n, got["none"].is_json, got["none"].delimiter) == (0, False, None)
    assert normalize.structures(df.where("false")).count() == 4 and normalize.structures(df.selectExpr("1 as x")).count() == 0
