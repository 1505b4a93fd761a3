"""Semantic types, designs, generated text and whole runs."""

import pytest

from tablewright import pipeline
from tablewright.plans import design, semantics
from tablewright.plans.dependencies import Dependency
from tablewright.sources.catalog import TableMeta, TableSet

DOC = {
    "strategy": "star",
    "dimensions": [{"name": "dim_customer", "source": "customer", "columns": [{"name": "customer_key", "primary_key": True}, {"name": "c_custkey", "role": "natural_key"}, {"name": "c_name"}]}],
    "facts": [{"name": "fact_orders", "source": "orders", "grain": "one row per order", "columns": [{"name": "orders_key", "primary_key": True}, {"name": "o_orderkey", "role": "natural_key"}, {"name": "o_custkey", "role": "foreign_key"}], "measures": ["o_totalprice"]}],
    "relationships": [{"from_table": "fact_orders", "from_column": "o_custkey", "to_table": "dim_customer", "to_column": "c_custkey"}],
}


def test_semantic_types():
    assert semantics.infer("email", "varchar", [("email", "HIGH")]).type == "email"
    assert semantics.infer("order_status", "varchar", (), semantics.Statistics(10_000, 3, 0, False)).type == "status"
    assert semantics.infer("zzz").type == "unknown"
    assert semantics.category("price") == "financial" and semantics.sensitivity("ssn") == "restricted" and semantics.infer("ssn", "text").is_pii
    assert semantics.profile_type("x", [("uuid", "HIGH")], True, 0) == ("uuid", "HIGH") and semantics.profile_type("customer_id", [], False, 0) == ("foreign_key", "MEDIUM")


def test_design_checks():
    d = design.from_document(DOC)
    assert [p for p in design.check(d) if p[0] in ("CRITICAL", "HIGH")] == []
    loop = design.Design("star", d.tables, (*d.relations, design.Relation("dim_customer", ("c_custkey",), "fact_orders", ("o_custkey",)), design.Relation("fact_orders", ("nope",), "gone", ("x",))))
    assert {p[2].split(" ")[0] for p in design.check(loop) if p[0] in ("CRITICAL", "HIGH")} == {"unknown", "reference"}
    create, drop = design.script(d)
    assert create.index("dim_customer (") < create.index("CREATE TABLE fact_orders") and drop.index("fact_orders") < drop.index("dim_customer")
    files = design.dbt_project(d)
    assert design.check_files(files) == [] and "models/fact/fact_orders.sql" in files
    assert design.check_files({"a.sql": "select {{ ref('b') }} from (x; drop table y"}) == [("a.sql", "unbalanced brackets"), ("a.sql", "unknown model b"), ("a.sql", "statement drop")]
    assert design.strategy("data_vault") == "vault" and design.vault_kind(d.table("fact_orders")) == "link"
    with pytest.raises(ValueError):
        design.strategy("none")


def test_ddl_parses(spark):
    spark.sql("explain " + design.ddl(design.DesignTable("t", "dimension", (design.DesignColumn("a", "int", nullable=False), design.DesignColumn("b")))))


def test_star_joins(spark, sf):
    tables = TableSet.parquet(spark, sf, ["customer", "orders"])
    star = pipeline.build_star(tables, design.from_document(DOC))
    fact = star["fact_orders"]
    assert fact.join(star["dim_customer"], "customer_key").count() == fact.count() == tables["orders"].count()


def test_analyze_and_normalize(spark, sf):
    tables = TableSet.parquet(spark, sf, ["nation", "region"])
    tables.meta = {"region": TableMeta(("r_regionkey",)), "nation": TableMeta(("n_nationkey",))}
    got = pipeline.analyze(tables)
    assert [tuple(r)[:4] for r in got["references"].collect()] == [("nation", "n_regionkey", "region", "r_regionkey")]
    assert got["forms"]["region"] == "BCNF" and ("n_nationkey",) in [k.columns for k in got["keys"]["nation"]]
    parts = pipeline.normalize_3nf(tables["nation"], [Dependency(("n_nationkey",), c) for c in ("n_name", "n_regionkey")])
    assert list(parts) == ["n_nationkey"]
    enriched = semantics.enrich(tables["nation"], got["types"])
    assert enriched.schema["n_name"].metadata["semantic_type"] == "name"
