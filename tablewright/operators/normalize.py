"""Normalization carried out on data: first normal form by explode and unpivot, relations by projection, and the proof by re-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def explode_array(df: DataFrame, key: list[str], column: str, table: str) -> DataFrame:
    """Bridge (key columns prefixed by the table, value, sequence from 1) of an array column; null and empty arrays give no rows."""
    return df.select(*[F.col(k).alias(f"{table}_{k}") for k in key], F.posexplode(column).alias("_at", f"{column}_value")).withColumn("sequence", F.col("_at") + 1).drop("_at")


def split_values(df: DataFrame, key: list[str], column: str, table: str, delimiter: str) -> DataFrame:
    """Bridge of the distinct trimmed non-empty parts of a delimited text column."""
    parts = F.explode(F.split(F.col(column), "\\Q" + delimiter + "\\E"))
    out = df.select(*[F.col(k).alias(f"{table}_{k}") for k in key], parts.alias("_part")).withColumn(f"{column}_value", F.trim("_part")).drop("_part")
    return out.where(F.col(f"{column}_value") != "").distinct()


def unpivot_group(df: DataFrame, key: list[str], columns: list[str], base: str) -> DataFrame:
    """Child table (key, `<base>_type`, `<base>`) of a repeating group; null members give no rows."""
    return df.unpivot(key, columns, f"{base}_type", base).where(F.col(base).isNotNull())


def json_columns(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """The table with a JSON object column replaced by `<column>_<field>` columns."""
    parsed = df.withColumn("_json", F.from_json(column, ", ".join(f"`{k}` {t}" for k, t in fields.items())))
    return parsed.select("*", *[F.col(f"_json.`{k}`").alias(f"{column}_{k}") for k in fields]).drop("_json", column)


def json_shape(df: DataFrame, column: str) -> DataFrame:
    """Keys of the JSON objects in a column with the JSON type of their values and the number of rows; other text is skipped."""
    rows = df.where(F.json_object_keys(column).isNotNull()).select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "raw"))
    kind = F.when(F.col("raw").isNull(), "null").when(F.col("raw").rlike(r"^-?[0-9]+$"), "integer").when(F.col("raw").rlike(r"^-?[0-9]*\.[0-9]+([eE][+-]?[0-9]+)?$"), "number").when(F.col("raw").isin("true", "false"), "boolean").when(F.col("raw").rlike(r"(?s)^\{.*\}$"), "object").when(F.col("raw").rlike(r"(?s)^\[.*\]$"), "array").otherwise("string")
    return rows.groupBy("key", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


#: Delimiters of lists in text, by preference (fixed values).
DELIMITERS = (",", ";", "|", "\t", "\n", " / ", " - ")


def delimiter(df: DataFrame, column: str, least_rows: int = 3, least_share: float = 0.1, delimiters: tuple[str, ...] = DELIMITERS) -> DataFrame:
    """The delimiter that most values contain (first of equals), if at least least_rows and least_share of values do."""
    c = F.col(column)
    wide = df.where(c.isNotNull()).agg(F.count(F.lit(1)).alias("values"), *[F.count_if(c.contains(d)).alias(f"n{i}") for i, d in enumerate(delimiters)])
    rows = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.lit(i).alias("i"), F.col(f"n{i}").alias("n")) for i, d in enumerate(delimiters)])
    best = wide.select("values", F.explode(rows).alias("r")).select("values", "r.*").orderBy(F.desc("n"), "i").limit(1)
    return best.where((F.col("n") >= least_rows) & (F.col("n") >= least_share * F.col("values"))).select("delimiter", "n", "values")


def non_atomic(df: DataFrame) -> list[str]:
    """Columns whose type holds several values."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def relations(df: DataFrame, parts: list[tuple[str, ...]]) -> list[DataFrame]:
    """The projections of a table, without repeated rows."""
    return [df.select(*[f"`{c}`" for c in p]).distinct() for p in parts]


def rejoin(parts: list[DataFrame]) -> DataFrame:
    """The natural join, nulls equal to nulls; each next part shares columns with what is joined already."""

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in b.columns if c in a.columns]
        right = b.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in shared else F.col(f"`{c}`") for c in b.columns])
        on = reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_r_{c}`")) for c in shared])
        return a.join(right, on).drop(*[f"_r_{c}" for c in shared])

    left, rest = parts[0], list(parts[1:])
    while rest:
        nxt = next(p for p in rest if set(p.columns) & set(left.columns))
        rest.remove(nxt)
        left = join(left, nxt)
    return left


def lost_or_gained(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """One row: distinct rows of df that the re-join lacks, and rows that it adds. Both are 0 for a lossless decomposition."""
    again = rejoin(parts).select(*df.columns)
    base = df.distinct()
    lost, gained = base.exceptAll(again).agg(F.count(F.lit(1)).alias("lost")), again.exceptAll(base).agg(F.count(F.lit(1)).alias("gained"))
    return lost.join(gained, F.lit(True))


#: Names that hold several values in one, and what they split into (fixed values).
COMPOUND = {
    "full_name": ("first_name", "last_name"), "name": ("first_name", "last_name"), "fullname": ("first_name", "last_name"),
    "address": ("street", "city", "state", "postal_code", "country"), "full_address": ("street", "city", "state", "postal_code", "country"), "location": ("city", "state", "country"),
    "datetime": ("date", "time"), "date_time": ("date", "time"), "phone_fax": ("phone", "fax"), "start_end": ("start", "end"), "min_max": ("min_value", "max_value"), "first_last": ("first", "last"),
    "lat_long": ("latitude", "longitude"), "latitude_longitude": ("latitude", "longitude"), "coordinates": ("latitude", "longitude"),
}


#: Those of them whose parts a space separates.
NAMES = ("full_name", "name", "fullname", "first_last")


def split_compound(df: DataFrame, column: str, separator: str = " ", parts: tuple[str, ...] | None = None) -> DataFrame:
    """The table with a compound column replaced by its parts; the last part takes what is left, missing parts are null."""
    names = parts or COMPOUND[column.lower()]
    pieces = F.split(F.trim(F.col(column)), "\\Q" + separator + "\\E", len(names))
    return df.select("*", *[F.trim(F.get(pieces, F.lit(i))).alias(n) for i, n in enumerate(names)]).drop(column)


def partial_dependencies(df: DataFrame, key: tuple[str, ...], table: str, fds) -> dict[str, DataFrame]:
    """Second normal form on data: a table for each part of the key that determines other columns, and the rest."""
    from ..plans.dependencies import decompose_2nf

    parts = decompose_2nf(df.columns, key, fds)
    return {table if k == tuple(key) else "_".join((table, *k)): r for (_, k), r in zip(parts, relations(df, [c for c, _ in parts]))}


def lookup(df: DataFrame, determinant: list[str], dependents: list[str]) -> tuple[DataFrame, DataFrame]:
    """Third normal form on data: (the table without the dependents, the lookup table of the determinant)."""
    return df.drop(*dependents).distinct(), df.select(*determinant, *dependents).distinct()


#: Share of values that must be JSON objects or arrays for a text column to count as JSON.
JSON_SHARE = 0.8


def structures(df: DataFrame, columns: list[str] | None = None, delimiters: tuple[str, ...] = DELIMITERS) -> DataFrame:
    """A row for each text column: what it holds, from one aggregation over all of them.

    n is its non-null values, parsed those that are JSON, objects and arrays those of these kinds, mean_length that of the arrays;
    kind is object or array where all that is JSON is that, else mixed (null where nothing is JSON), is_json whether objects and
    arrays make up `JSON_SHARE` of the values, delimiter the one that most values contain (first of equals) if it is in 3 and a tenth of them.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    schema = "column string, n bigint, parsed bigint, objects bigint, arrays bigint, mean_length double, kind string, is_json boolean, delimiter string"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    parsed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).withColumns({f"t{i}": F.schema_of_variant(F.try_parse_json(F.col(f"c{i}"))) for i in range(len(names))})
    wide = parsed.agg(*[e.alias(f"{k}{i}") for i in range(len(names)) for k, e in {
        "n": F.count(f"c{i}"), "p": F.count_if(F.col(f"t{i}").isNotNull()), "o": F.count_if(F.col(f"t{i}").startswith("OBJECT")), "a": F.count_if(F.col(f"t{i}").startswith("ARRAY")),
        "l": F.avg(F.when(F.col(f"t{i}").startswith("ARRAY"), F.json_array_length(f"c{i}"))), "d": F.array(*[F.count_if(F.col(f"c{i}").contains(d)) for d in delimiters]),
    }.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(n) for k, n in (("n", "n"), ("p", "parsed"), ("o", "objects"), ("a", "arrays"), ("l", "mean_length"), ("d", "held"))]) for i, c in enumerate(names)]))
    out = wide.select(rows.alias("r")).select("r.*")
    kind = F.when(F.col("parsed") == 0, None).when(F.col("objects") == F.col("parsed"), "object").when(F.col("arrays") == F.col("parsed"), "array").otherwise("mixed")
    most = F.array_max("held")
    sign = F.when((most >= 3) & (most >= 0.1 * F.col("n")), F.element_at(F.array(*map(F.lit, delimiters)), F.array_position("held", most).cast("int")))
    is_json = (F.col("n") > 0) & (F.col("objects") + F.col("arrays") >= JSON_SHARE * F.col("n"))
    return out.select("column", "n", "parsed", "objects", "arrays", "mean_length", kind.alias("kind"), is_json.alias("is_json"), sign.alias("delimiter"))


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """(path, type, n): every path in the JSON values of a column, however deep, with the type of what stands there and the number of times.

    The whole value has the path `$`, a field `$.a`, the values of an array `$.a[]`. Types are object, array, integer, number, string,
    boolean and null. Text that is no JSON is skipped. One aggregation tells how deep brackets are nested, and all levels are one plan.
    """
    texts = df.select(F.col(f"`{column}`").cast("string").alias("text")).withColumn("value", F.try_parse_json("text")).where("value is not null")
    brackets = F.regexp_replace(F.regexp_replace("text", r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    nested = F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]
    most, values = texts.agg(F.coalesce(F.max(nested), F.lit(0))).first()[0], texts.select("value")
    spark, level, levels = df.sparkSession, values.select(F.lit("$").alias("path"), "value"), []
    for _ in range(most + 1):
        levels.append(level)
        inner = level.alias("l").lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).alias("e"), how="inner")
        level = inner.select(F.concat(F.col("l.path"), F.coalesce(F.concat(F.lit("."), F.col("e.key")), F.lit("[]"))).alias("path"), F.col("e.value").alias("value"))
    kind = F.schema_of_variant("value")
    named = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "number").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise(F.lower(kind))
    return reduce(DataFrame.unionAll, levels).groupBy("path", named.alias("type")).agg(F.count(F.lit(1)).alias("n"))


#: Spark types of JSON types; a field with several, or with none of these, is text.
JSON_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean"}


def json_fields(df: DataFrame, column: str) -> dict[str, str]:
    """Field names of the objects in a column, by name, with the type that holds all their values."""
    kinds: dict[str, set[str]] = {}
    for r in json_shape(df, column).collect():  # a row per field and type
        kinds.setdefault(r.key, set()).add(r.type)
    told = {k: types - {"null"} for k, types in kinds.items()}
    return {k: "double" if told[k] == {"integer", "number"} else JSON_TYPES.get(next(iter(told[k])), "string") if len(told[k]) == 1 else "string" for k in sorted(told)}


def first_form(
    df: DataFrame, table: str, key: list[str], delimiters: dict[str, str] | None = None, compound: dict[str, str] | None = None, separate: bool = False, most_fields: int = 10, decide: bool = False,
) -> dict[str, DataFrame]:
    """A table in first normal form: the table itself and a table for each thing that it held several times.

    In this order: columns that differ by a number become rows of `<table>_<base>`; arrays become `<table>_<column>` with a row
    for each value; objects in JSON text become columns (with separate, or with more than most_fields fields, the table
    `<table>_<column>`), JSON arrays a table like arrays, and mixed JSON goes; lists in text (column: delimiter) become tables;
    compound columns (column: separator) become their parts. Keys keep their names with the table's before them. With decide,
    lists and compounds that are not given are found: lists by the delimiter that structures() tells, names of persons (`NAMES`) by
    a space in them. What every text column holds comes from one aggregation.
    """
    from ..plans.violations import numbered_groups

    out: dict[str, DataFrame] = {}
    main = df
    named = lambda part: part.select(*[F.col(f"`{k}`").alias(f"{table}_{k}") for k in key], *[f"`{c}`" for c in part.columns if c not in key])
    for base, group in numbered_groups([c for c in df.columns if c not in key]).items():
        if len({dict(df.dtypes)[c] for c in group}) == 1:  # values of one kind
            out[f"{table}_{base}"] = named(unpivot_group(main, key, group, base).select(*key, f"{base}_type", base))
            main = main.drop(*group)
    for f in main.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out[f"{table}_{f.name}"] = explode_array(main, key, f.name, table)
            main = main.drop(f.name)
    texts = [f.name for f in main.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in key]
    told = {r.column: r for r in structures(main, texts).collect()}  # a row per text column
    for f in main.schema.fields:
        what = told[f.name].kind if f.name in told and told[f.name].is_json else None
        if what == "object":
            fields = json_fields(main, f.name)
            if separate or len(fields) > most_fields:
                side = json_columns(main.select(*key, f.name), f.name, fields)
                out[f"{table}_{f.name}"] = named(side).toDF(*[f"{table}_{k}" for k in key], *fields)
                main = main.drop(f.name)
            else:
                main = json_columns(main, f.name, fields)
        elif what == "array":
            parsed = main.where(F.col(f.name).isNotNull()).select(*key, F.from_json(f.name, "array<string>").alias(f.name))
            out[f"{table}_{f.name}"] = explode_array(parsed, key, f.name, table)
            main = main.drop(f.name)
        elif what == "mixed":
            main = main.drop(f.name)
    if decide:
        names = {c: " " for c in told if c.lower() in NAMES and c in main.columns and c not in (delimiters or {})}
        compound = names | (compound or {})
        delimiters = {c: r.delimiter for c, r in told.items() if r.delimiter and c in main.columns and c not in compound} | (delimiters or {})
    for column, sign in (delimiters or {}).items():
        out[f"{table}_{column}"] = split_values(main, key, column, table, sign)
        main = main.drop(column)
    for column, sign in (compound or {}).items():
        main = split_compound(main, column, sign)
    return {table: main} | out
