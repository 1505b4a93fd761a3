"""The strict scans run every rule; the rule with look-aheads is written for DuckDB as a plain pattern and exclusions."""

import duckdb

from tablewright import queries as registry
from tablewright.functions import patterns

NO_SSN = r"^(?:000|666|9[0-9]{2})|^[0-9]{3}-00|0000$"
PLAIN_SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"


def condition(p):
    if p.name == "ssn":
        return f"regexp_matches(trim(v), '{PLAIN_SSN}') and not regexp_matches(trim(v), '{NO_SSN}')"
    return f"regexp_matches(trim(v), '{p.regex}')"


def duck(sf):
    c = duckdb.connect()
    c.sql(f"create view customer as select * from '{sf}/customer.parquet'")
    c.sql(f"create view m as {registry.DUCK_MIXED}")
    return c


def test_exclusions_say_what_the_look_aheads_say(spark):
    values = ["123-45-6789", "000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000", "1234-45-678", " 123-45-6789 "]
    c = duckdb.connect()
    c.sql(f"create view m as select unnest({values}) as v")
    want = dict(c.sql(f"select v, {condition(patterns.BY_NAME['ssn'])} from m").fetchall())
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert dict(map(tuple, df.select("v", patterns.matches(df.v, "ssn")).collect())) == want
    assert sum(want.values()) == 2


def test_classify_values_runs_every_rule(spark, sf):
    cases = " ".join(f"when {condition(p)} then '{p.name}'" for p in sorted(patterns.STRICT, key=lambda p: p.priority))
    want = sorted(duck(sf).sql(f"select c_custkey, case {cases} end as kind from m").fetchall())
    got = sorted(map(tuple, registry.QUERIES["classify_values"](spark, sf).select("c_custkey", "kind").collect()))
    assert got == want and any(kind == "ssn" for _, kind in got)


def test_strict_patterns_runs_every_rule(spark, sf):
    c = duck(sf)
    total = c.sql("select count(*) from m").fetchall()[0][0]
    found = [(p, c.sql(f"select count(*) from m where {condition(p)}").fetchall()[0][0]) for p in patterns.STRICT]
    want = {p.name: n for p, n in found if n * 100 / total >= 5}
    got = {r.pattern: r.n for r in registry.QUERIES["strict_patterns"](spark, sf).collect()}
    assert got == want and "ssn" in got
