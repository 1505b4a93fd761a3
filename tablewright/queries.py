"""The library's queries by name, each with the SQL that an independent engine runs for comparison where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns
from .functions.keys import hash_diff, hash_key
from .operators import dependencies, marts, models, normalize, profile, quality, relationships, vault
from .plans import keys
from .plans.dependencies import Dependency, synthesize_3nf
from .plans.design import Design, DesignColumn, DesignTable, Relation
from .session import shared_folder
from .sources.bucketed import BucketedTable
from .sources.catalog import TableMeta, TableSet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Columns and types of the tables that the driver provides.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def fields(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in TABLES[table].split(", ")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---------------------------------------------------------------- profiling

ROUNDED = {"mean": 4, "stddev": 4, "p25": 6, "p50": 6, "p75": 6, "p90": 6, "p99": 6, "avg_len": 4}


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in ROUNDED.items() if c in df.columns})


def profile_sql(source: str, table: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, t) in enumerate(columns):
        number, text = t in ("int", "bigint", "double"), t == "string"
        x = f"cast({c} as double)"
        q = f"quantile_cont({x}, {{}})" if number else "cast(null as double)"
        quantiles = ", ".join(f"round({q.format(v)}, 6) as {k}" if number else f"{q} as {k}" for k, v in profile.QUANTILES.items())
        stats = f"min({x}) as min, max({x}) as max, round(avg({x}), 4) as mean, round(stddev_samp({x}), 4) as stddev" if number else "cast(null as double) as min, cast(null as double) as max, cast(null as double) as mean, cast(null as double) as stddev"
        lens = f"min(length({c})) as min_len, max(length({c})) as max_len, round(avg(length({c})), 4) as avg_len, count(*) filter (where {c} = '') as empties" if text else "cast(null as bigint) as min_len, cast(null as bigint) as max_len, cast(null as double) as avg_len, cast(null as bigint) as empties"
        parts.append(f"select '{table}' as \"table\", count(*) as total, '{c}' as \"column\", '{t}' as dtype, cast({i} as integer) as position, count({c}) as non_null, count(distinct {c}) as \"distinct\", {stats}, {quantiles}, {lens} from {source}")
    return f"""
with p as ({" union all ".join(parts)}),
d as (select *, total - non_null as nulls, case when total = 0 then 0.0 else floor((total - non_null) * 10000.0 / total + 0.5) / 100 end as null_pct,
    case when non_null = 0 then 0.0 else floor("distinct" * 10000.0 / non_null + 0.5) / 100 end as distinct_pct, "distinct" = non_null and non_null > 0 as is_unique from p),
s as (select *, 100.0 - case when null_pct > 50 then 30 when null_pct > 20 then 15 when null_pct > 5 then 5 else 0 end - case when "distinct" = 1 and total > 10 then 20 else 0 end
    - case when distinct_pct > 99 and total < 100 then 5 else 0 end - case when coalesce(empties, 0) > total * 0.1 then 10 else 0 end as score from d)
select * exclude (score, null_pct, distinct_pct), cast(null_pct as double) as null_pct, cast(distinct_pct as double) as distinct_pct,
    cast(greatest(0.0, case when is_unique and null_pct = 0 then least(100.0, score + 5) else score end) as double) as quality from s"""


def _profile(table: str):
    return lambda spark, sf_dir: rounded(profile.columns(read(spark, sf_dir, table), table))


for _t in TABLES:
    query(f"profile_{_t}", profile_sql(_t, _t, fields(_t)))(_profile(_t))

#: orders with nulls, constants and empty strings put in, to exercise the scores.
HOLED = "select o_orderkey, case when o_custkey % 3 = 0 then null else o_custkey end as o_custkey, case when o_orderkey % 10 < 6 then null else o_orderstatus end as o_orderstatus, case when o_orderkey % 5 = 0 then '' else o_orderpriority end as o_orderpriority, 1 as one from orders"
HOLED_FIELDS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string"), ("one", "int")]


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(HOLED)


query("column_quality", profile_sql(f"({HOLED})", "holed", HOLED_FIELDS))(lambda spark, sf_dir: rounded(profile.columns(holed(spark, sf_dir), "holed")))

_TWO = f"(select * from ({profile_sql(f'({HOLED})', 'holed', HOLED_FIELDS)}) union all select * from ({profile_sql('customer', 'customer', fields('customer'))}))"


def two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.columns(holed(spark, sf_dir), "holed").unionByName(profile.columns(read(spark, sf_dir, "customer"), "customer"))


def best_pattern_sql(source: str, table: str, columns: list[tuple[str, str]]) -> str:
    """The best pattern's share of each text column that matches any."""
    rows = " union all ".join(f"select '{c}' as \"column\", '{k}' as pattern, {j} as j, count(*) filter (where regexp_matches({c}, '{r.replace(chr(39), chr(39) * 2)}')) as n, count({c}) as v from {source}" for c, t in columns if t == "string" for j, (k, r) in enumerate(patterns.PROFILE.items()))
    return f"select '{table}' as \"table\", \"column\", pattern, cast(floor(n * 10000.0 / v + 0.5) / 100 as double) as pct from ({rows}) where n > 0 qualify row_number() over (partition by \"column\" order by n desc, j) = 1"


_BEST = f"(select * from ({best_pattern_sql(f'({HOLED})', 'holed', HOLED_FIELDS)}) union all select * from ({best_pattern_sql('customer', 'customer', fields('customer'))}))"


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.best_patterns(holed(spark, sf_dir), "holed").unionByName(profile.best_patterns(read(spark, sf_dir, "customer"), "customer"))


query("best_patterns", best_pattern_sql("pages", "pages", fields("pages")) + " union all " + best_pattern_sql("events", "events", fields("events")) + " union all " + best_pattern_sql("documents", "documents", fields("documents")))(
    lambda spark, sf_dir: reduce(DataFrame.unionByName, [profile.best_patterns(read(spark, sf_dir, t), t) for t in ("pages", "events", "documents")])
)


@query("table_quality", f'select t."table", round(avg(100 - null_pct), 6) as completeness, round(avg(distinct_pct), 6) as uniqueness, round(avg(coalesce(b.pct, 100.0)), 6) as consistency, round((avg(100 - null_pct) + avg(distinct_pct) + avg(coalesce(b.pct, 100.0))) / 3, 6) as overall from {_TWO} t left join {_BEST} b on t."table" = b."table" and t."column" = b."column" group by 1')
def table_quality(spark, sf_dir):
    return profile.table_scores(two(spark, sf_dir), best(spark, sf_dir)).select("table", *[F.round(c, 6).alias(c) for c in ("completeness", "uniqueness", "consistency", "overall")])


@query("quality_issues", f"""with p as {_TWO}, t as (select "table", (avg(100 - null_pct) + avg(distinct_pct) + 100) / 3 as overall from p group by "table")
select "table", cast(null as varchar) as "column", 'low_table_quality' as issue from t where overall < 90
union all select distinct "table", cast(null as varchar), 'no_primary_key' from p where "table" not in (select "table" from p where is_unique and null_pct = 0)
union all select "table", "column", 'high_nulls' from p where null_pct > 50
union all select "table", "column", 'low_column_quality' from p where quality < 90""")
def quality_issues(spark, sf_dir):
    p = two(spark, sf_dir)
    return profile.issues(p, profile.table_scores(p), threshold=90)


@query("profile_summary", f'select count(distinct "table") as tables, count(*) as columns, round(avg(quality), 6) as avg_quality, count(*) filter (where quality >= 80) as high, count(*) filter (where quality >= 50 and quality < 80) as medium, count(*) filter (where quality < 50) as low from {_TWO}')
def profile_summary(spark, sf_dir):
    return profile.summary(two(spark, sf_dir)).withColumn("avg_quality", F.round("avg_quality", 6))


query("primary_key_guess", f'select "table", arg_min("column", position) as primary_key from {_TWO} where is_unique and null_pct = 0 group by "table"')(lambda spark, sf_dir: profile.primary_key_guess(two(spark, sf_dir)))

_EVENTS = profile_sql("events", "events", fields("events"))
query("foreign_key_guesses", f"""select "table", "column", lower("column")[:length("column") - 3] as potential_reference, 'medium' as confidence from ({_EVENTS}) where lower("column") like '%\\_id' escape '\\' and not is_unique""")(lambda spark, sf_dir: profile.foreign_key_guesses(profile.columns(read(spark, sf_dir, "events"), "events")))

#: events with a UUID made of the user, which repeats.
SESSIONS = "select event_id, {uuid} as session, user_id from events"
_U = "substr(md5(cast(user_id as varchar)), {}, {})"
_SESSIONS = SESSIONS.format(uuid=" || '-' || ".join(_U.format(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


@query("foreign_key_guesses_uuid", "select 'sessions' as \"table\", 'user_id' as \"column\", 'user' as potential_reference, 'medium' as confidence from (select count(distinct user_id) as d, count(user_id) as n from events) where d <> n union all select 'sessions', 'session', 'unknown', 'low' from (select count(distinct user_id) as d, count(user_id) as n from events) where d <> n")
def foreign_key_guesses_uuid(spark, sf_dir):
    read(spark, sf_dir, "events").createOrReplaceTempView("events")
    rows = spark.sql(_SESSIONS.replace("as varchar", "as string"))
    return profile.foreign_key_guesses(profile.columns(rows, "sessions"), profile.best_patterns(rows, "sessions"))


query("top_values_events_type", "select event_type as value, count(*) as n, floor(count(*) * 10000.0 / (select count(*) from events) + 0.5) / 100 as pct from events where event_type is not null group by 1 order by n desc, value limit 10")(lambda spark, sf_dir: profile.top_values(read(spark, sf_dir, "events"), "event_type"))
query("top_values_customer_segment", "select c_mktsegment as value, count(*) as n, floor(count(*) * 10000.0 / (select count(*) from customer) + 0.5) / 100 as pct from customer where c_mktsegment is not null group by 1 order by n desc, value limit 3")(lambda spark, sf_dir: profile.top_values(read(spark, sf_dir, "customer"), "c_mktsegment", 3))


def histogram_sql(table: str, column: str, n: int = 20) -> str:
    return f"""with e as (select min({column})::double as lo, max({column})::double as hi from {table})
select cast(floor(({column} - lo) / ((hi + 1 - lo) / {n})) as bigint) + 1 as bucket, count(*) as n, min({column})::double as low, max({column})::double as high from {table}, e where {column} is not null and lo < hi group by 1"""


query("histogram_events_value", histogram_sql("events", "value"))(lambda spark, sf_dir: profile.histogram(read(spark, sf_dir, "events"), "value"))
query("histogram_part_size", histogram_sql("part", "p_size"))(lambda spark, sf_dir: profile.histogram(read(spark, sf_dir, "part"), "p_size"))
query("sample_values_part", "select value from (select distinct p_name as value from part where p_name is not null) order by md5(value), value limit 100")(lambda spark, sf_dir: profile.sample_values(read(spark, sf_dir, "part"), "p_name"))

# ---------------------------------------------------------------- patterns


def pattern_sql(source: str, column: str, table: dict[str, str]) -> str:
    quoted = {k: r.replace("'", "''") for k, r in table.items()}
    rows = " union all ".join(f"select '{k}' as pattern, count(*) filter (where regexp_matches({column}, '{r}')) as n, count({column}) as v from {source}" for k, r in quoted.items())
    return f"select pattern, n, floor(n * 10000.0 / v + 0.5) / 100 as pct, case when n * 100.0 / v > 95 then 'HIGH' when n * 100.0 / v > 80 then 'MEDIUM' else 'LOW' end as confidence from ({rows}) where n > 0"


query("pattern_scan_pages_url", pattern_sql("pages", "url", patterns.PROFILE))(lambda spark, sf_dir: profile.patterns(read(spark, sf_dir, "pages"), "url"))
query("pattern_scan_events_props", pattern_sql("events", "props", patterns.PROFILE))(lambda spark, sf_dir: profile.patterns(read(spark, sf_dir, "events"), "props"))

#: Values of many formats made from customer keys.
MIXED = """select c_custkey, case c_custkey % 8 when 0 then 'user' || c_custkey || '@example.com' when 1 then '+1-555-' || lpad(cast(c_custkey % 10000 as string), 4, '0') || '-99' when 2 then '4' || lpad(cast(c_custkey as string), 15, '0')
    when 3 then '123-45-' || lpad(cast(c_custkey % 9999 + 1 as string), 4, '0') when 4 then '10.0.' || (c_custkey % 300) || '.7' when 5 then '2024-0' || (c_custkey % 9 + 1) || '-15' when 6 then cast(c_custkey % 100 as string) || '.5%' else c_name end as v from customer"""
DUCK_MIXED = MIXED.replace(" as string)", " as varchar)")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(MIXED)


def strict_condition(p: patterns.Pattern, v: str = "trim(v)") -> str:
    """A strict rule for DuckDB, which has no look-ahead: the ssn rule is a plain pattern without what it excludes."""
    if p.name == "ssn":
        return f"(regexp_matches({v}, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') and not regexp_matches({v}, '^(000|666|9..)') and {v}[5:6] <> '00' and {v}[8:] <> '0000')"
    return f"regexp_matches({v}, '{p.regex}')"


def strict_sql(rules, least: float = 5.0) -> str:
    rows = " union all ".join(f"select '{p.name}' as pattern, count(*) filter (where {strict_condition(p)}) as n, count(*) as c, {p.threshold * 100} as t, {p.priority} as pr from m" for p in rules)
    return f"""with m as ({DUCK_MIXED}), r as ({rows}) select pattern, n, floor(n * 10000.0 / c + 0.5) / 100 as pct, case when n * 100.0 / c >= 95 then 'HIGH' when n * 100.0 / c >= t then 'MEDIUM' else 'LOW' end as confidence,
    cast(row_number() over (order by n desc, pr) as integer) as rank from r where n > 0 and n * 100.0 / c >= {least}"""


query("strict_patterns", strict_sql(patterns.STRICT))(lambda spark, sf_dir: profile.strict_patterns(mixed(spark, sf_dir), "v", patterns.STRICT, least_pct=5.0))
query("sensitive_scan", strict_sql(patterns.SENSITIVE, 0.0))(lambda spark, sf_dir: profile.strict_patterns(mixed(spark, sf_dir), "v", patterns.SENSITIVE, least_pct=0.0))

_FIRST = " ".join(f"when {strict_condition(p)} then '{p.name}'" for p in sorted(patterns.STRICT, key=lambda p: p.priority))
query("classify_values", f"select c_custkey, case {_FIRST} end as kind from ({DUCK_MIXED})")(lambda spark, sf_dir: mixed(spark, sf_dir).select("c_custkey", patterns.first_match(F.col("v")).alias("kind")))


@query("mask_values", f"""select c_custkey, '***-**-' || right(v, 4) as ssn, repeat('*', greatest(length(v) - 4, 0)) || right(v, 4) as card,
    case when len(string_split(v, '@')) = 2 and length(string_split(v, '@')[1]) > 1 then left(v, 1) || '***@' || string_split(v, '@')[2] else v end as email,
    case when length(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 then '***-***-' || right(regexp_replace(v, '[^0-9]', '', 'g'), 4) else v end as phone from ({DUCK_MIXED})""")
def mask_values(spark, sf_dir):
    v = F.col("v")
    return mixed(spark, sf_dir).select("c_custkey", patterns.mask(v, "ssn").alias("ssn"), patterns.mask(v, "credit_card").alias("card"), patterns.mask(v, "email").alias("email"), patterns.mask(v, "phone").alias("phone"))


query("json_shape_events_props", "select key, case json_type(props, '$.\"' || key || '\"') when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'number' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' else lower(json_type(props, '$.\"' || key || '\"')) end as type, count(*) as n from (select props, unnest(json_keys(props)) as key from events where json_valid(props)) group by 1, 2")(lambda spark, sf_dir: normalize.json_shape(read(spark, sf_dir, "events"), "props"))

#: events as nested and mixed JSON: objects in objects, arrays of objects, plain values, and text that is no JSON.
NESTED = """select event_id, case event_id % 5 when 0 then '{"a": {"b": ' || event_id || ', "c": [1, 2.5, "x"]}, "k": null}' when 1 then '{"a": {"b": true}, "k": ["' || event_type || '"]}'
    when 2 then '[{"n": ' || user_id || '}, {"n": "s"}]' when 3 then 'plain ' || event_type else '{"k": "' || event_type || '"}' end as doc,
    event_type || '; ' || (event_id % 7) as list, 'Ann Lee' as full_name from events"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(NESTED)


_PATHS = [(0, "$", "object"), (0, "$.a", "object"), (0, "$.a.b", "integer"), (0, "$.a.c", "array"), (0, "$.a.c[]", "integer"), (0, "$.a.c[]", "number"), (0, "$.a.c[]", "string"), (0, "$.k", "null"), (1, "$", "object"), (1, "$.a", "object"), (1, "$.a.b", "boolean"), (1, "$.k", "array"), (1, "$.k[]", "string"), (2, "$", "array"), (2, "$[]", "object"), (2, "$[]", "object"), (2, "$[].n", "integer"), (2, "$[].n", "string"), (4, "$", "object"), (4, "$.k", "string")]
query("json_paths_nested", "select path, type, sum(n)::bigint as n from (" + " union all ".join(f"select '{p}' as path, '{t}' as type, count(*) as n from events where event_id % 5 = {i}" for i, p, t in _PATHS) + ") group by 1, 2 having sum(n) > 0")(lambda spark, sf_dir: normalize.json_paths(nested(spark, sf_dir), "doc"))
query("json_paths_events", "select '$' as path, 'object' as type, count(*) as n from events union all select '$.' || key, case json_type(props, '$.\"' || key || '\"') when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'number' when 'VARCHAR' then 'string' else lower(json_type(props, '$.\"' || key || '\"')) end, count(*) from (select props, unnest(json_keys(props)) as key from events) group by 1, 2")(lambda spark, sf_dir: normalize.json_paths(read(spark, sf_dir, "events"), "props"))
query("text_structures", """with m as (select event_id % 5 as r, count(*) as n from events group by 1), t as (select sum(n)::bigint as n, coalesce(sum(n) filter (where r <> 3), 0)::bigint as parsed, coalesce(sum(n) filter (where r in (0, 1, 4)), 0)::bigint as objects, coalesce(sum(n) filter (where r = 2), 0)::bigint as arrays from m)
    select 'doc' as "column", n, parsed, objects, arrays, 2.0::double as mean_length, 'mixed' as kind, objects + arrays >= 0.8 * n as is_json, ',' as delimiter from t
    union all select 'list', n, 0, 0, 0, null, null, false, ';' from t union all select 'full_name', n, 0, 0, 0, null, null, false, null from t""")(lambda spark, sf_dir: normalize.structures(nested(spark, sf_dir)))


def _decided(part: str):
    return lambda spark, sf_dir: normalize.first_form(nested(spark, sf_dir).drop("doc"), "events", ["event_id"], decide=True)[part]


query("first_form_decided", "select event_id, 'Ann' as first_name, 'Lee' as last_name from events")(_decided("events"))
query("first_form_decided_list", "select distinct event_id as events_event_id, unnest([event_type, cast(event_id % 7 as varchar)]) as list_value from events")(_decided("events_list"))

# ---------------------------------------------------------------- dependencies, keys, references


def fd_sql(source: str, xs: list[str], ys: list[str]) -> str:
    left = ", ".join(xs)
    part = "select [{x}] as determinant, '{y}' as dependent, count(*) as groups, count(*) filter (where d > 1) as violations, floor((1 - count(*) filter (where d > 1) / count(*)) * 10000 + 0.5) / 10000 as confidence from (select {left}, count(distinct {y}) as d from {source} where {y} is not null group by {left})"
    return " union all ".join(part.format(x=", ".join(f"'{x}'" for x in xs), y=y, left=left, source=source) for y in ys)


def _fd(name: str, table: str, xs: list[str], ys: list[str]) -> None:
    query(name, fd_sql(table, xs, ys))(lambda spark, sf_dir: dependencies.check(read(spark, sf_dir, table), xs, ys).withColumn("confidence", F.col("confidence").cast("double")))


_fd("fd_check_documents", "documents", ["text"], ["lang", "n_chars", "source"])
_fd("fd_check_lineitem_order", "lineitem", ["l_orderkey"], ["l_returnflag", "l_linestatus", "l_suppkey", "l_shipdate"])
_fd("fd_check_lineitem_pair", "lineitem", ["l_partkey", "l_suppkey"], ["l_orderkey", "l_quantity", "l_tax"])
query("fd_check_with_nulls", fd_sql(f"({HOLED})", ["o_custkey"], ["o_orderstatus", "o_orderpriority", "one"]))(lambda spark, sf_dir: dependencies.check(holed(spark, sf_dir), ["o_custkey"], ["o_orderstatus", "o_orderpriority", "one"]))
query("fd_verify_lineitem", f"select * from ({fd_sql('lineitem', ['l_orderkey', 'l_partkey'], ['l_tax'])}) where confidence >= 0.95")(lambda spark, sf_dir: dependencies.verify(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "l_tax").withColumn("confidence", F.col("confidence").cast("double")))
query("fd_violations_lineitem", "select l.* from lineitem l join (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(distinct l_partkey) > 1) using (l_orderkey, l_linenumber) order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 100")(
    lambda spark, sf_dir: dependencies.violations(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", tie=["l_suppkey"])
)


def discover_sql(table: str, most: int = 3, least: float = 0.95) -> str:
    """Dependencies of every left side of up to `most` columns, but for those that a smaller left side has."""
    names = [c for c, _ in fields(table)]
    parts = []
    for xs in (xs for size in range(1, min(most, len(names) - 1) + 1) for xs in combinations(names, size)):
        ys = [c for c in names if c not in xs]
        each = ", ".join(f"count(distinct {y}) as d{i}" for i, y in enumerate(ys))
        told = ", ".join(f"count(*) filter (where d{i} > 0) as g{i}, count(*) filter (where d{i} > 1) as v{i}" for i in range(len(ys)))
        inner = f"(select {told} from (select {each} from {table} group by {', '.join(xs)}))"
        parts += [f"select [{', '.join(map(repr, xs))}] as determinant, '{y}' as dependent, g{i} as groups, v{i} as violations from {inner}" for i, y in enumerate(ys)]
    return f"""with c as ({" union all ".join(parts)}), f as (select *, floor((1 - violations / groups) * 10000 + 0.5) / 10000 as confidence from c where groups > 0),
    k as (select * from f where confidence >= {least}), m as (select * from k where not exists (select 1 from k s where s.dependent = k.dependent and len(s.determinant) < len(k.determinant) and list_has_all(k.determinant, s.determinant)))
    select determinant, dependent, confidence, confidence as support, groups, violations, len(determinant) > 1 and exists (select 1 from m s where s.dependent = m.dependent and len(s.determinant) = 1 and list_has_all(m.determinant, s.determinant)) as is_partial,
    exists (select 1 from m s where list_contains(m.determinant, s.dependent) and s.determinant <> m.determinant and not list_has_all(s.determinant, m.determinant)) as is_transitive from m"""


def _discovered(table: str):
    return lambda spark, sf_dir: dependencies.as_frame(spark, dependencies.discover(read(spark, sf_dir, table)))


for _t in ("nation", "documents", "region", "customer", "supplier", "orders", "pages", "labels", "conversations"):
    query(f"fd_discover_{_t}", discover_sql(_t))(_discovered(_t))

KEY_SETS = [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey"], ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]]


def key_sql(source: str, sets: list[list[str]]) -> str:
    out = []
    for xs in sets:
        full = " and ".join(f"{x} is not null" for x in xs)
        out.append(f"select [{', '.join(repr(x) for x in xs)}] as columns, count(distinct row({', '.join(xs)})) filter (where {full}) as distinct_keys, case when count(*) filter (where {full}) > 0 then count(distinct row({', '.join(xs)})) filter (where {full}) / count(*) filter (where {full}) else 0.0 end as uniqueness, (count(*) - count(*) filter (where {full})) * 100.0 / count(*) as null_pct from {source}")
    return " union all ".join(out)


query("key_check_lineitem", key_sql("lineitem", KEY_SETS))(lambda spark, sf_dir: dependencies.check_keys(read(spark, sf_dir, "lineitem"), KEY_SETS))
query("key_check_with_nulls", key_sql(f"({HOLED})", [["o_orderkey"], ["o_custkey"], ["o_custkey", "o_orderpriority"]]))(lambda spark, sf_dir: dependencies.check_keys(holed(spark, sf_dir), [["o_orderkey"], ["o_custkey"], ["o_custkey", "o_orderpriority"]]))


def keys_sql(table: str, most: int = 4) -> str:
    """Column sets that are unique and without nulls, but for those that contain a smaller one."""
    names = [c for c, _ in fields(table)]
    sets = [xs for size in range(1, most + 1) for xs in combinations(names, size)]
    tests = " union all ".join(f"select [{', '.join(map(repr, xs))}] as columns, (select count(*) > 0 and count(*) = count(distinct row({', '.join(xs)})) and count(*) = count(*) filter (where {' and '.join(f'{x} is not null' for x in xs)}) from {table}) as key" for xs in sets)
    return f"with k as ({tests}) select '{table}' as \"table\", columns from k where key and not exists (select 1 from k s where s.key and len(s.columns) < len(k.columns) and list_has_all(k.columns, s.columns))"


def _keys(table: str):
    def run(spark, sf_dir):
        found = dependencies.find_keys(read(spark, sf_dir, table))
        return spark.createDataFrame([(table, list(k.columns)) for k in found], "table string, columns array<string>")

    return run


for _t in TABLES:
    query(f"candidate_keys_{_t}", keys_sql(_t))(_keys(_t))


#: Keys of one column of every table.
query("single_column_keys", " union all ".join(f"select * from ({keys_sql(t, 1)})" for t in TABLES))(
    lambda spark, sf_dir: spark.createDataFrame([(t, list(k.columns)) for t in TABLES for k in dependencies.find_single_keys(read(spark, sf_dir, t))], "table string, columns array<string>")
)

#: Tables and the key that the names recommend among those found.
_OWN = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id"}


@query("recommended_keys", " union all ".join(f"select * from ({keys_sql(t)}) where columns = ['{c}']" for t, c in _OWN.items()))
def recommended_keys(spark, sf_dir):
    """The recommended one of all keys of up to four columns."""
    found = {t: dependencies.find_keys(read(spark, sf_dir, t)) for t in _OWN}
    return spark.createDataFrame([(t, list(keys.recommend(k, table=t).columns)) for t, k in found.items()], "table string, columns array<string>")


#: events with numbered columns, an array and a JSON array put in.
WIDE_EVENTS = "select event_id, event_type, props, value as value_1, case when event_id % 3 = 0 then null else value * 2 end as value_2, {array} as tags, '[' || (event_id % 4) || ',\"x\"]' as codes from events"


def _first_form(part: str):
    def run(spark, sf_dir):
        read(spark, sf_dir, "events").createOrReplaceTempView("events")
        return normalize.first_form(spark.sql(WIDE_EVENTS.format(array="array(event_type, cast(event_id % 2 as string))")), "events", ["event_id"])[part]

    return run


_WIDE = WIDE_EVENTS.format(array="[event_type, cast(event_id % 2 as varchar)]")
query("first_form_events", "select event_id, event_type, cast(json_extract(props, '$.k') as bigint) as props_k from events")(_first_form("events"))
query("first_form_events_value", f"select event_id as events_event_id, 'value_1' as value_type, value_1 as value from ({_WIDE}) where value_1 is not null union all select event_id, 'value_2', value_2 from ({_WIDE}) where value_2 is not null")(_first_form("events_value"))
query("first_form_events_tags", f"select event_id as events_event_id, unnest(tags) as tags_value, cast(generate_subscripts(tags, 1) as integer) as sequence from ({_WIDE})")(_first_form("events_tags"))
query("first_form_events_codes", f"select event_id as events_event_id, unnest([cast(event_id % 4 as varchar), 'x']) as codes_value, unnest([1, 2]) as sequence from ({_WIDE})")(_first_form("events_codes"))

VAULT = Design("data_vault", (
    DesignTable("dim_customer", "dimension", (DesignColumn("c_custkey", role="business_key"), DesignColumn("c_name"), DesignColumn("c_acctbal")), "customer"),
    DesignTable("dim_nation", "dimension", (DesignColumn("n_nationkey", role="business_key"), DesignColumn("n_name")), "nation"),
    DesignTable("fact_home", "fact", (DesignColumn("c_mktsegment"),), "customer"),
), (Relation("fact_home", ("c_custkey",), "dim_customer", ("c_custkey",)), Relation("fact_home", ("c_nationkey",), "dim_nation", ("n_nationkey",))))


def built_vault(spark, sf_dir) -> dict[str, DataFrame]:
    return vault.build({t: read(spark, sf_dir, t) for t in ("customer", "nation")}, VAULT, F.lit("2024-01-01").cast("timestamp_ntz"), "crm")


_RESTRICT = [("HUB_customer", "select distinct c_custkey from customer where c_custkey is not null"), ("SAT_customer", "select distinct c_custkey from customer"), ("HUB_nation", "select distinct n_nationkey from nation"), ("SAT_nation", "select distinct n_nationkey from nation"), ("LINK_home", "select distinct c_custkey, c_nationkey from customer where c_nationkey is not null"), ("SAT_home", "select distinct c_custkey, c_nationkey from customer where c_nationkey is not null")]


@query("vault_tables", " union all ".join(f"select '{t}' as \"table\", count(*) as rows from ({q})" for t, q in _RESTRICT))
def vault_tables(spark, sf_dir):
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows") for t, df in built_vault(spark, sf_dir).items()])


_CHECKS = [("HUB_customer", "HK_customer", "not_null"), ("HUB_customer", "HK_customer", "unique"), ("HUB_nation", "HK_nation", "not_null"), ("HUB_nation", "HK_nation", "unique"), ("LINK_home", "LK_home", "not_null"), ("LINK_home", "LK_home", "unique"), ("LINK_home", "HK_customer", "refers"), ("LINK_home", "HK_nation", "refers"), ("SAT_customer", "HK_customer", "refers"), ("SAT_customer", "HK_customer", "unique_at_a_time"), ("SAT_home", "LK_home", "refers"), ("SAT_home", "LK_home", "unique_at_a_time"), ("SAT_nation", "HK_nation", "refers"), ("SAT_nation", "HK_nation", "unique_at_a_time")]
query("vault_checks", " union all ".join(f"select '{t}' as \"table\", '{c}' as \"column\", '{k}' as test, {'(select count(*) from customer where c_nationkey not in (select n_nationkey from nation))' if (c, k) == ('HK_nation', 'refers') and t == 'LINK_home' else '0'}::bigint as failures" for t, c, k in _CHECKS))(lambda spark, sf_dir: vault.checks(built_vault(spark, sf_dir)))


def measure_sql(source: str, c: str, target: str, k: str, names: tuple[str, str], likeness: float) -> str:
    return f"""with s as (select {c} as v, count(*) as n from {source} group by 1), m as (select count(v) as d, count(k) as hit, sum(n) as total, coalesce(sum(n) filter (where v is null), 0) as nulls, avg(n) filter (where v is not null) as refs from s left join (select distinct {k} as k from {target} where {k} is not null) on v = k),
o as (select *, case when d > 0 then hit / d else 0.0 end as overlap, greatest(0.0, least(1.0, {likeness} * 0.4 + case when d > 0 then hit / d else 0.0 end * 0.5 + case when coalesce(refs = 1, false) then -0.05 else 0.1 end)) as score from m)
select '{names[0]}' as from_table, '{c}' as from_column, '{names[1]}' as to_table, '{k}' as to_column, round(overlap, 6) as overlap, case when coalesce(refs <= 1.1, false) then '1:1' else '1:N' end as cardinality, cast(floor(nulls * 10000.0 / total + 0.5) / 100 as double) as null_pct, round(score, 6) as score, case when round(score, 6) >= 0.85 then 'HIGH' when round(score, 6) >= 0.65 then 'MEDIUM' else 'LOW' end as confidence from o"""


def _inclusion(name: str, source: str, c: str, target: str, k: str) -> None:
    query(name, measure_sql(source, c, target, k, (source, target), 0.85))(lambda spark, sf_dir: relationships.measure(read(spark, sf_dir, source), c, read(spark, sf_dir, target), k, (source, target), 0.85))


_inclusion("inclusion_orders_customer", "orders", "o_custkey", "customer", "c_custkey")
_inclusion("inclusion_lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey")
_inclusion("inclusion_lineitem_part", "lineitem", "l_partkey", "part", "p_partkey")
_inclusion("inclusion_labels_documents", "labels", "doc_id", "documents", "doc_id")
_inclusion("inclusion_customer_supplier", "customer", "c_custkey", "supplier", "s_suppkey")

DECLARED = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",)}


def tableset(spark: SparkSession, sf_dir: str, names=tuple(TABLES)) -> TableSet:
    out = TableSet.parquet(spark, sf_dir, list(names))
    out.meta = {n: TableMeta(primary_key=DECLARED.get(n, ())) for n in names}
    return out


_FOUND = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id")]
_INFER = " union all ".join(f"select * from ({measure_sql(s, c, t, k, (s, t), 0.85)})" for s, c, t, k in _FOUND)


@query("infer_relationships", f"select * from ({_INFER}) where overlap >= 0.8")
def infer_relationships(spark, sf_dir):
    tables = tableset(spark, sf_dir)
    return relationships.infer(tables.tables, tables.infos(), strip_prefix=True)


_DOMAINS = {"int": "i", "bigint": "i", "double": "d", "string": "s"}
_VALUES = " union all ".join(f"select distinct '{t}' as t, '{c}' as c, '{_DOMAINS.get(k, k)}' as k, cast({c} as varchar) as v from {t} where {c} is not null" for t in TABLES for c, k in fields(t))


@query("inclusion_dependencies", f"with v as ({_VALUES}), n as (select t, c, count(*) as n from v group by 1, 2), m as (select a.t, a.c, b.t as u, b.c as d, count(*) as hit from v a join v b on a.k = b.k and a.v = b.v and (a.t <> b.t or a.c <> b.c) group by 1, 2, 3, 4) select m.t as from_table, m.c as from_column, u as to_table, d as to_column, n as n_values, 1.0::double as overlap from m join n on m.t = n.t and m.c = n.c where hit = n")
def inclusion_dependencies(spark, sf_dir):
    """Columns of all tables whose values are all in another column."""
    return relationships.inclusions(tableset(spark, sf_dir).tables)


query("orphan_values", "select c_custkey as value, count(*) as n from customer where c_custkey not in (select s_suppkey from supplier) group by 1")(lambda spark, sf_dir: relationships.orphans(read(spark, sf_dir, "customer"), "c_custkey", read(spark, sf_dir, "supplier"), "s_suppkey"))

# ---------------------------------------------------------------- catalog

query("list_tables", " union all ".join(f"select '{t}' as \"table\", (select count(*) from {t}) as rows, cast({len(fields(t))} as integer) as columns" for t in TABLES))(lambda spark, sf_dir: tableset(spark, sf_dir).list_tables())
_COLUMNS = " union all ".join(f"select '{t}' as \"table\", '{c}' as \"column\", {i + 1}::integer as position, '{k}' as type, {str(c not in DECLARED.get(t, ())).lower()} or true as nullable, {str(c in DECLARED.get(t, ())).lower()} as primary_key, cast(null as varchar) as \"references\"" for t in TABLES for i, (c, k) in enumerate(fields(t)))
query("list_columns", _COLUMNS)(lambda spark, sf_dir: tableset(spark, sf_dir).list_columns())
query("adhoc_sql", "select c_mktsegment, count(*) as n from customer where c_acctbal > 5000 group by 1")(lambda spark, sf_dir: tableset(spark, sf_dir).query("select c_mktsegment, count(*) as n from customer where c_acctbal > :least group by 1", {"least": 5000}))

# ---------------------------------------------------------------- quality rules

#: orders under names that the default rules know, with some bad values.
RULED = "select o_orderkey as id, case when o_custkey % 7 = 0 then null else o_custkey end as customer_id, o_totalprice - 1500 as total_amount, o_orderdate as order_date, case when o_orderkey % 4 = 0 then '' else o_orderstatus end as status_name, case when o_orderkey % 9 = 0 then 'none' else 'a' || o_orderkey || '@b.org' end as email from orders"


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(RULED)


def _rule(column: str, rule: str, severity: str, threshold: float, observed: str, bad: str) -> str:
    return f"select 'ruled' as \"table\", '{column}' as \"column\", '{rule}' as rule, '{severity}' as severity, cast({threshold} as double) as threshold, round({observed}, 4) as observed, not coalesce({observed} {bad}, false) as passed from r"


_NULLS = "(count(*) - count({c})) * 100.0 / count(*)"
_VALIDATE = f"with r as ({RULED}) " + " union all ".join([
    _rule("id", "pk_no_nulls", "CRITICAL", 0, _NULLS.format(c="id"), "> 0"), _rule("id", "pk_uniqueness", "CRITICAL", 100, "count(distinct id) * 100.0 / count(id)", "< 100"),
    _rule("customer_id", "id_no_nulls", "CRITICAL", 0, _NULLS.format(c="customer_id"), "> 0"), _rule("customer_id", "id_uniqueness", "HIGH", 100, "count(distinct customer_id) * 100.0 / count(customer_id)", "< 100"),
    _rule("total_amount", "amount_non_negative", "HIGH", 100, "count(*) filter (where total_amount >= 0) * 100.0 / count(total_amount)", "< 100"), _rule("total_amount", "total_non_negative", "MEDIUM", 100, "count(*) filter (where total_amount >= 0) * 100.0 / count(total_amount)", "< 100"),
    _rule("order_date", "date_reasonable_range", "LOW", 100, "count(*) filter (where year(order_date) between 1900 and 2100) * 100.0 / count(order_date)", "< 100"),
    _rule("status_name", "status_completeness", "MEDIUM", 5, _NULLS.format(c="status_name"), "> 5"), _rule("status_name", "name_min_length", "LOW", 1, "min(length(status_name))::double", "< 1"),
    _rule("email", "email_format", "MEDIUM", 95, f"count(*) filter (where regexp_matches(email, '{quality.FORMATS['email']}')) * 100.0 / count(email)", "< 95"),
])
query("quality_rules", _VALIDATE)(lambda spark, sf_dir: quality.validate(ruled(spark, sf_dir), "ruled"))
query("quality_report", f"""select "table", count(*) as checks, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed, floor(count(*) filter (where passed) * 10000.0 / count(*) + 0.5) / 100 as pass_rate,
    cast(greatest(0.0, 100.0 - sum(case when passed then 0.0 else case severity when 'CRITICAL' then 20.0 when 'HIGH' then 10.0 when 'MEDIUM' then 5.0 when 'LOW' then 2.0 else 0.5 end end)) as double) as score from ({_VALIDATE}) group by 1""")(lambda spark, sf_dir: quality.report(quality.validate(ruled(spark, sf_dir), "ruled")))
query("referential_integrity", "select count(*) as rows, count(s_suppkey) as matched, floor(count(s_suppkey) * 10000.0 / count(*) + 0.5) / 100 as pct, (select list(cast(c_custkey as varchar) order by cast(c_custkey as varchar)) from (select distinct c_custkey from customer where c_custkey not in (select s_suppkey from supplier) order by 1 limit 5)) as missing from customer left join supplier on c_custkey = s_suppkey where c_custkey is not null")(lambda spark, sf_dir: quality.referential(read(spark, sf_dir, "customer"), "c_custkey", read(spark, sf_dir, "supplier"), "s_suppkey"))
query("test_unique_lineitem", "select l_orderkey as value, count(*) as n from lineitem where l_orderkey is not null group by 1 having count(*) > 1")(lambda spark, sf_dir: quality.failing(read(spark, sf_dir, "lineitem"), "unique", "l_orderkey"))
query("test_not_null", f"select * from ({RULED}) where customer_id is null")(lambda spark, sf_dir: quality.failing(ruled(spark, sf_dir), "not_null", "customer_id"))
query("test_relationships", "select c_nationkey as value, count(*) as n from customer where c_nationkey not in (select r_regionkey from region) group by 1")(lambda spark, sf_dir: quality.failing(read(spark, sf_dir, "customer"), "relationships", "c_nationkey", read(spark, sf_dir, "region"), "r_regionkey"))

# ---------------------------------------------------------------- normalization on data

query("bridge_embeddings", "select vec_id as embeddings_vec_id, embedding[i] as embedding_value, cast(i as integer) as sequence from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)")(lambda spark, sf_dir: normalize.explode_array(read(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", "embeddings"))
query("split_part_names", "select distinct p_partkey as part_p_partkey, trim(w) as p_name_value from (select p_partkey, unnest(string_split(p_name, ' ')) as w from part) where trim(w) <> ''")(lambda spark, sf_dir: normalize.split_values(read(spark, sf_dir, "part"), ["p_partkey"], "p_name", "part", " "))
query("unpivot_prices", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_discount' as rate_type, l_discount as rate from lineitem where l_discount is not null union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_tax', l_tax from lineitem where l_tax is not null")(lambda spark, sf_dir: normalize.unpivot_group(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_discount", "l_tax"], "rate"))
query("json_columns_events", "select event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k') as props_k from events")(lambda spark, sf_dir: normalize.json_columns(read(spark, sf_dir, "events"), "props", {"k": "string"}))
query("delimiter_documents", "with c as (select count(*) as v, " + ", ".join(f"count(*) filter (where contains(text, {('chr(9)', 'chr(10)')[d == chr(10)] if d in (chr(9), chr(10)) else repr(d)})) as n{i}" for i, d in enumerate(normalize.DELIMITERS)) + " from documents where text is not null) select d as delimiter, n, v as values from (" + " union all ".join(f"select {('chr(9)', 'chr(10)')[d == chr(10)] if d in (chr(9), chr(10)) else repr(d)} as d, {i} as i, n{i} as n, v from c" for i, d in enumerate(normalize.DELIMITERS)) + ") where n >= 3 and n >= 0.1 * v order by n desc, i limit 1")(lambda spark, sf_dir: normalize.delimiter(read(spark, sf_dir, "documents"), "text"))

@query("split_part_type", "select p_partkey, nullif(split_part(trim(p_type), ' ', 1), '') as kind, case when strpos(trim(p_type), ' ') > 0 then trim(trim(p_type)[strpos(trim(p_type), ' ') + 1:]) end as rest from part")
def split_part_type(spark, sf_dir):
    return normalize.split_compound(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", " ", ("kind", "rest"))


@query("lookup_nation_region", "select distinct c_nationkey, n_name, n_regionkey from (select o_orderkey, o_custkey, o_totalprice, c_name, c_nationkey, n_name, n_regionkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)")
def lookup_nation_region(spark, sf_dir):
    return normalize.lookup(wide(spark, sf_dir), ["c_nationkey"], ["n_name", "n_regionkey"])[1]


@query("partial_dependency_lineitem", "select distinct l_orderkey, o_custkey, o_orderdate from lineitem join orders on l_orderkey = o_orderkey")
def partial_dependency_lineitem(spark, sf_dir):
    """Order columns hang on part of the key of order lines."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "l_suppkey", "o_custkey", "o_orderdate", "l_quantity")
    fds = [Dependency(("l_orderkey",), c) for c in ("o_custkey", "o_orderdate")]
    return normalize.partial_dependencies(rows, ("l_orderkey", "l_partkey", "l_suppkey"), "lines", fds)["lines_l_orderkey"]


@query("effectivity_order_customer", "with c as (select user_id, event_type, ts as LOAD_DTS, event_id, lag(event_type) over w as b from events window w as (partition by user_id order by ts, event_type)), d as (select * from c where b is null or b <> event_type) select user_id, event_type, LOAD_DTS as EFFECTIVE_FROM, lead(LOAD_DTS) over (partition by user_id order by LOAD_DTS, event_type) as EFFECTIVE_TO from d")
def effectivity_order_customer(spark, sf_dir):
    history = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("LOAD_DTS"))
    return models.effectivity(history, "user_id", "event_type")


@query("light_profile_part", 'select "table", "column", dtype, total, non_null, "distinct", null_pct from (' + profile_sql("part", "part", fields("part")) + ")")
def light_profile_part(spark, sf_dir):
    return profile.light(read(spark, sf_dir, "part"), "part").drop("min", "max", "mean")


WIDE = "select o_orderkey, o_custkey, o_totalprice, c_name, c_nationkey, n_name, n_regionkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
WIDE_FDS = [Dependency(("o_orderkey",), c) for c in ("o_custkey", "o_totalprice")] + [Dependency(("o_custkey",), c) for c in ("c_name", "c_nationkey")] + [Dependency(("c_nationkey",), c) for c in ("n_name", "n_regionkey")]
WIDE_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "c_name", "c_nationkey", "n_name", "n_regionkey"]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("orders", "customer", "nation"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(WIDE)


def _relation(i: int):
    parts = [r for r, _ in synthesize_3nf(WIDE_COLUMNS, WIDE_FDS)]
    return lambda spark, sf_dir: normalize.relations(wide(spark, sf_dir), parts)[i]


for _i, (_cols, _key) in enumerate(synthesize_3nf(WIDE_COLUMNS, WIDE_FDS)):
    query(f"relation_3nf_{_key[0]}", f"select distinct {', '.join(_cols)} from ({WIDE})")(_relation(_i))


@query("lossless_proof", "select cast(0 as bigint) as lost, cast(0 as bigint) as gained")
def lossless_proof(spark, sf_dir):
    df = wide(spark, sf_dir)
    return normalize.lost_or_gained(df, normalize.relations(df, [r for r, _ in synthesize_3nf(WIDE_COLUMNS, WIDE_FDS)]))


# ---------------------------------------------------------------- models


def _sur(*columns: str) -> str:
    return "md5(" + " || '-' || ".join(f"coalesce(cast({c} as varchar), '_null_')" for c in columns) + ")"


def _hk(*columns: str) -> str:
    return "md5(" + " || '|' || ".join(f"coalesce(cast({c} as varchar), '^^')" for c in columns) + ")"


query("staging_orders", "select o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")(lambda spark, sf_dir: models.staging(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"]))
query("dim_customer", f"select {_sur('c_custkey')} as customer_key, c_custkey, c_name, c_mktsegment, n_name from customer left join nation on c_nationkey = n_nationkey")(
    lambda spark, sf_dir: models.dimension(models.join_on(read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), [("c_nationkey", "n_nationkey")], ["n_name"]), "customer", ["c_custkey"], ["c_name", "c_mktsegment", "n_name"])
)
query("fact_lineitem", f"select {_sur('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} as lineitem_key, {_sur('l_partkey')} as part_key, {_sur('l_suppkey')} as supplier_key, l_orderkey, l_quantity, l_extendedprice from lineitem")(
    lambda spark, sf_dir: models.fact(read(spark, sf_dir, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], {"part": ["l_partkey"], "supplier": ["l_suppkey"]}, ["l_quantity", "l_extendedprice"], ["l_orderkey"])
)
query("date_dimension", "select cast(strftime(d, '%Y%m%d') as integer) as date_key, cast(d as date) as date, cast(year(d) as integer) as year, cast(quarter(d) as integer) as quarter, cast(month(d) as integer) as month, cast(day(d) as integer) as day, cast(isodow(d) - 1 as integer) as weekday, isodow(d) > 5 as is_weekend from (select unnest(range(timestamp '2023-12-25', timestamp '2025-01-11', interval 1 day)) as d)")(lambda spark, sf_dir: models.date_dimension(spark, "2023-12-25", "2025-01-10"))
query("junk_dimension", f"select distinct {_sur('l_returnflag', 'l_linestatus')} as flags_key, l_returnflag, l_linestatus from lineitem")(lambda spark, sf_dir: models.junk_dimension(read(spark, sf_dir, "lineitem"), "flags", ["l_returnflag", "l_linestatus"]))
query("measure_additive", "select l_returnflag, round(sum(l_quantity), 2) as sum_l_quantity from lineitem group by 1")(lambda spark, sf_dir: models.additive(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("sum_l_quantity", F.round("sum_l_quantity", 2)))
query("measure_semi_additive", "select user_id, arg_max(value, row(ts, event_id)) as last_value from events group by 1")(lambda spark, sf_dir: models.semi_additive(read(spark, sf_dir, "events"), ["user_id"], "value", "ts", "event_id"))
query("measure_ratio", "select l_linestatus, round(sum(l_tax) / sum(l_quantity), 8) as tax_per_unit from lineitem group by 1")(lambda spark, sf_dir: models.ratio(read(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_tax", "l_quantity", "tax_per_unit").withColumn("tax_per_unit", F.round("tax_per_unit", 8)))
query("bridge_allocation", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, 1.0 / count(*) over (partition by l_orderkey) as allocation_factor from lineitem")(lambda spark, sf_dir: models.allocation(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"]).withColumn("allocation_factor", F.col("allocation_factor").cast("double")))

_VERSIONS = "with h as (select user_id, ts, arg_max(event_type, event_id) as event_type from events group by 1, 2), c as (select *, lag(event_type) over w as b, row_number() over w as r from h window w as (partition by user_id order by ts)), v as (select user_id, event_type, ts as valid_from, lead(ts) over (partition by user_id order by ts) as valid_to from c where r = 1 or event_type is distinct from b) "
query("scd0_first", "select user_id, arg_min(event_type, row(ts, event_id)) as event_type, arg_min(value, row(ts, event_id)) as value from events group by 1")(lambda spark, sf_dir: models.scd0(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_type", "value"))
query("scd1_latest", "select user_id, arg_max(event_type, row(ts, event_id)) as event_type, arg_max(value, row(ts, event_id)) as value from events group by 1")(lambda spark, sf_dir: models.scd1(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_type", "value"))
query("scd2_events_user", _VERSIONS + "select user_id, event_type, valid_from, valid_to, valid_to is null as is_current from v")(lambda spark, sf_dir: models.scd2(read(spark, sf_dir, "events"), ["user_id"], ["event_type"], "ts", "event_id"))
query("scd3_previous", _VERSIONS + ", p as (select *, lag(event_type) over (partition by user_id order by valid_from) as pr from v) select user_id, event_type as current_event_type, pr as previous_event_type, valid_from as changed_at from p where valid_to is null")(lambda spark, sf_dir: models.scd3(read(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", "event_id"))

def loaded():
    """Load time of the batch loads."""
    return F.lit("2024-01-01").cast("date")

query("hub_customer", f"select {_hk('c_custkey')} as HK_customer, c_custkey, date '2024-01-01' as LOAD_DTS, 'crm' as RECORD_SOURCE from customer")(lambda spark, sf_dir: models.hub(read(spark, sf_dir, "customer"), "customer", ["c_custkey"], "crm", loaded()))
query("hub_increment", f"select {_hk('c_custkey')} as HK_customer, c_custkey, date '2024-01-01' as LOAD_DTS, 'crm' as RECORD_SOURCE from customer where c_custkey % 3 <> 0")(
    lambda spark, sf_dir: models.hub(read(spark, sf_dir, "customer"), "customer", ["c_custkey"], "crm", loaded(), models.hub(read(spark, sf_dir, "customer").where("c_custkey % 3 = 0"), "customer", ["c_custkey"], "old", loaded()))
)
query("link_order_customer", f"select {_hk('o_orderkey', 'o_custkey')} as LK_order_customer, {_hk('o_orderkey')} as HK_order, {_hk('o_custkey')} as HK_customer, date '2024-01-01' as LOAD_DTS, 'erp' as RECORD_SOURCE from orders")(lambda spark, sf_dir: models.link(read(spark, sf_dir, "orders"), "order_customer", {"order": ["o_orderkey"], "customer": ["o_custkey"]}, "erp", loaded()))
query("ghost_hub", f"select {_hk('r_name')} as HK_region, r_name, date '2024-01-01' as LOAD_DTS, 'crm' as RECORD_SOURCE from region union all select repeat('0', 32), '-1', date '1900-01-01', 'SYSTEM'")(lambda spark, sf_dir: models.with_ghost(models.hub(read(spark, sf_dir, "region"), "region", ["r_name"], "crm", loaded()), "HK_region", ["r_name"]))


def user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.vault_stage(read(spark, sf_dir, "events"), "HK_user", ["user_id"], ["event_type"], "web", F.col("ts"))


_SAT = f"with h as (select {_hk('user_id')} as HK_user, ts as LOAD_DTS, user_id, {_hk('event_type')} as HASHDIFF, event_type from events), d as (select HK_user, LOAD_DTS, user_id, max(HASHDIFF) as HASHDIFF, arg_max(event_type, HASHDIFF) as event_type from h group by 1, 2, 3), c as (select *, lag(HASHDIFF) over (partition by HK_user order by LOAD_DTS) as b from d), s as (select HK_user, LOAD_DTS, HASHDIFF, user_id, event_type, 'web' as RECORD_SOURCE, lead(LOAD_DTS) over (partition by HK_user order by LOAD_DTS) as LOAD_END_DTS from c where b is null or HASHDIFF <> b) "
query("sat_user", _SAT + "select * from s")(lambda spark, sf_dir: models.satellite(user_history(spark, sf_dir), "HK_user"))


def loaded_in_batches(spark: SparkSession, rows: DataFrame, part: Column, key: list[str], by: list[str], keep: str = "least") -> DataFrame:
    """rows in four batches by part (0 to 3), which come late, twice and interrupted by one another, in a table of 16 buckets.

    Only the last version is read, so the files of those before are deleted as they are superseded.
    """
    table = BucketedTable(spark, shared_folder(spark, "vault"), rows.schema, key, by, buckets=16, keep=keep)
    for batch in (2, 0, 2, 3, 1, 0):
        table.load(rows.where(part == batch), batch)
        table.vacuum(keep=1)
    return table.read()


@query("hub_batches", f"select {_hk('o_custkey')} as HK_customer, o_custkey, min(o_orderdate) as LOAD_DTS, 'erp' as RECORD_SOURCE from orders group by o_custkey")
def hub_batches(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(hash_key("o_custkey").alias("HK_customer"), "o_custkey", F.col("o_orderdate").alias("LOAD_DTS"), F.lit("erp").alias("RECORD_SOURCE"), F.pmod("o_orderkey", F.lit(4)).alias("part"))
    return loaded_in_batches(spark, rows, F.col("part"), ["HK_customer", "o_custkey"], ["HK_customer"]).drop("part")


@query("link_batches", f"select {_hk('l_partkey', 'l_suppkey')} as LK_part_supplier, {_hk('l_partkey')} as HK_part, {_hk('l_suppkey')} as HK_supplier, min(l_shipdate) as LOAD_DTS from lineitem group by l_partkey, l_suppkey")
def link_batches(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(hash_key("l_partkey", "l_suppkey").alias("LK_part_supplier"), hash_key("l_partkey").alias("HK_part"), hash_key("l_suppkey").alias("HK_supplier"), F.col("l_shipdate").alias("LOAD_DTS"), F.pmod("l_orderkey", F.lit(4)).alias("part"))
    return loaded_in_batches(spark, rows, F.col("part"), ["LK_part_supplier", "HK_part", "HK_supplier"], ["LK_part_supplier"]).drop("part")


@query("sat_batches", _SAT + "select * from s")
def sat_batches(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    staged = models.vault_stage(rows, "HK_user", ["user_id"], ["event_type"], "web", F.col("ts")).select("HK_user", "LOAD_DTS", "HASHDIFF", "user_id", "event_type", "RECORD_SOURCE")
    history = loaded_in_batches(spark, staged, F.pmod(F.dayofmonth("LOAD_DTS"), F.lit(4)), ["HK_user", "LOAD_DTS"], ["HK_user"], keep="greatest")
    return models.satellite(history, "HK_user")


query("hashdiff_customer", f"select c_custkey, {_hk('c_mktsegment', 'c_name', 'c_nationkey')} as hashdiff from customer")(lambda spark, sf_dir: read(spark, sf_dir, "customer").select("c_custkey", hash_diff("c_nationkey", "c_name", "c_mktsegment").alias("hashdiff")))


@query("pit_user", _SAT + ", t as (select unnest([timestamp '2024-01-02', timestamp '2024-01-15', timestamp '2024-06-01']) as snapshot), k as (select distinct HK_user from s) select k.HK_user, t.snapshot, coalesce((select max(LOAD_DTS) from s where s.HK_user = k.HK_user and s.LOAD_DTS <= t.snapshot), timestamp '1900-01-01') as sat_LOAD_DTS from k, t")
def pit_user(spark, sf_dir):
    sat = models.satellite(user_history(spark, sf_dir), "HK_user")
    snaps = spark.sql("select explode(array(timestamp_ntz'2024-01-02', timestamp_ntz'2024-01-15', timestamp_ntz'2024-06-01')) as snapshot")
    return models.point_in_time(sat.select("HK_user").distinct(), snaps, "HK_user", {"sat": sat})


query("bridge_vault", f"select {_hk('o_orderkey', 'o_custkey')} as LK_order_customer, o_orderkey, o_custkey from orders")(
    lambda spark, sf_dir: models.bridge(
        models.link(read(spark, sf_dir, "orders"), "order_customer", {"order": ["o_orderkey"], "customer": ["o_custkey"]}, "erp", loaded()),
        [models.hub(read(spark, sf_dir, "orders"), "order", ["o_orderkey"], "erp", loaded()), models.hub(read(spark, sf_dir, "orders"), "customer", ["o_custkey"], "erp", loaded())], ["order", "customer"],
    ).select("LK_order_customer", "o_orderkey", "o_custkey")
)

# ---------------------------------------------------------------- marts and hierarchies

REFERENCES = [("orders", ("o_custkey",), "customer", ("c_custkey",)), ("customer", ("c_nationkey",), "nation", ("n_nationkey",)), ("nation", ("n_regionkey",), "region", ("r_regionkey",)), ("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)), ("supplier", ("s_nationkey",), "nation", ("n_nationkey",)), ("lineitem", ("l_partkey",), "part", ("p_partkey",))]


def _mart(root: str):
    return lambda spark, sf_dir: marts.mart(tableset(spark, sf_dir).tables, root, REFERENCES)


query("mart_orders", "select o.*, c.* exclude (c_custkey), n.* exclude (n_nationkey), r.* exclude (r_regionkey) from orders o left join customer c on o_custkey = c_custkey left join nation n on c_nationkey = n_nationkey left join region r on n_regionkey = r_regionkey")(_mart("orders"))
query("mart_lineitem", "select l.*, s.* exclude (s_suppkey), n.* exclude (n_nationkey), r.* exclude (r_regionkey), p.* exclude (p_partkey) from lineitem l left join supplier s on l_suppkey = s_suppkey left join nation n on s_nationkey = n_nationkey left join region r on n_regionkey = r_regionkey left join part p on l_partkey = p_partkey")(_mart("lineitem"))

#: A hierarchy of customers (a binary tree by number).
_TREE = "select c_custkey as node, cast(floor(c_custkey / 2) as bigint) as above from customer where floor(c_custkey / 2) > 0"


@query("hierarchy_customers", f"with recursive h as ({_TREE}), up as (select node, above as ancestor, 1::bigint as depth from h union all select up.node, h.above, up.depth + 1 from up join h on up.ancestor = h.node) select node, ancestor, depth, false as circular from up")
def hierarchy_customers(spark, sf_dir):
    """Everything above each customer in a hierarchical link."""
    read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return marts.ancestors(spark.sql(_TREE), "node", "above")
