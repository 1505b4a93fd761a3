"""Implicit foreign keys: inclusion of distinct values, cardinality and a confidence score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.names import Candidate, ColumnInfo, candidates, compatible

INFERRED = ("from_table", "from_column", "to_table", "to_column", "overlap", "cardinality", "null_pct", "score", "confidence")


def score(similarity: Column, overlap: Column, unique: Column) -> Column:
    """0.4 of the name's likeness, 0.5 of the overlap, and 0.1 more for repeated values or 0.05 less for unique ones."""
    raw = similarity * 0.4 + overlap * 0.5 + F.when(unique, -0.05).otherwise(0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def _rated(row: DataFrame, similarity: Column, ends: list[Column]) -> DataFrame:
    """distinct_values, matched, total, nulls and refs of a reference as a row of INFERRED."""
    row = row.withColumn("overlap", F.when(F.col("distinct_values") > 0, F.col("matched") / F.col("distinct_values")).otherwise(0.0))
    row = row.withColumn("unique", F.coalesce(F.col("refs") == 1, F.lit(False)))
    row = row.withColumn("score", F.round(score(similarity, F.col("overlap"), F.col("unique")), 6))
    return row.select(
        *ends, F.round("overlap", 6).alias("overlap"),
        F.when(F.coalesce(F.col("refs") <= 1.1, F.lit(False)), "1:1").otherwise("1:N").alias("cardinality"),
        F.when(F.col("total") > 0, F.floor(F.col("nulls") * 10000.0 / F.col("total") + 0.5) / 100).otherwise(0.0).alias("null_pct"),
        "score", F.when(F.col("score") >= 0.85, "HIGH").when(F.col("score") >= 0.65, "MEDIUM").otherwise("LOW").alias("confidence"),
    )


def measure(source: DataFrame, column: str, target: DataFrame, key: str, names: tuple[str, str], similarity: float) -> DataFrame:
    """One row for a reference: share of distinct source values found in the target, cardinality, null share, score.

    Both sides are reduced to distinct values before they meet.
    """
    counts = source.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    keys = target.select(F.col(key).alias("key")).where("key is not null").distinct()
    matched = counts.join(keys, F.col("value") == F.col("key"), "left")
    row = matched.agg(
        F.count("value").alias("distinct_values"), F.count("key").alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.avg(F.when(F.col("value").isNotNull(), F.col("n"))).alias("refs"),
    )
    return _rated(row, F.lit(similarity), [F.lit(x).alias(c) for c, x in zip(INFERRED, (names[0], column, names[1], key))])


#: Texts longer than this are known by their MD5, so whole texts are not shuffled.
_LONG = 32


def _domain(a: str, b: str) -> str:
    """How values of two compatible types are compared: as integers, decimals, doubles, or as text of one type."""
    a, b = a.lower(), b.lower()
    if a in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if a.startswith("decimal") and b.startswith("decimal"):
        return "decimal"
    return "double" if a.startswith(("decimal", "float", "double")) else "text" if a.startswith(("string", "varchar", "char")) else a


def _value(column: str, domain: str) -> tuple[Column, Column]:
    """A value as (whole number, text), one of them null; both are null for a null."""
    c = F.col(f"`{column}`")
    if domain == "integer":
        return c.cast("long"), F.lit(None).cast("string")
    if domain == "decimal":
        text = c.cast("string")
        text = F.when(text.contains("."), F.regexp_replace(text, "\\.?0+$", "")).otherwise(text)
    elif domain == "double":
        text = (c.cast("double") + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    else:
        text = F.when(c.isNotNull(), F.to_json(F.struct(c))) if any(k in domain for k in ("<", "variant")) else c.cast("string")
    return F.lit(None).cast("long"), F.when(F.length(text) > _LONG, F.concat(F.lit("\x00"), F.md5(text))).otherwise(text)


#: Columns for each word of a set of columns.
_BITS = 63


def shared_values(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """For each pair (table, column, table, column): distinct_values, matched, total, nulls and refs, in one plan for all pairs.

    The data are inverted: each table is read once for the columns of any pair, distinct values by column are shuffled, and the
    columns that hold a value become bits of the value's set. Values with equal sets are counted, and only these counts meet the
    pairs, so what a value costs is bounded by the schema. Rows and nulls come from a second, narrow aggregation. NaN is a
    value. A pair of an empty table has zeros. Each pair's types must be compatible; its place in `pairs` is the column `pair`.
    """
    spark = next(iter(tables.values())).sparkSession
    kind = {(t, f.name): f.dataType.simpleString() for t, df in tables.items() for f in df.schema.fields}
    domains = [_domain(kind[t, c], kind[u, k]) for t, c, u, k in pairs]
    holders = sorted({(t, c, d) for (t, c, _, _), d in zip(pairs, domains)} | {(u, k, d) for (_, _, u, k), d in zip(pairs, domains)})
    number, kinds = {h: i for i, h in enumerate(holders)}, sorted(set(domains))
    words = [f"m{w}" for w in range((len(holders) - 1) // _BITS + 1)]
    values, plain = [], []
    for t in sorted({t for t, _, _ in holders}):
        own = [h for h in holders if h[0] == t]
        each = [F.struct(F.lit(number[h] // _BITS).alias("word"), F.lit(1 << number[h] % _BITS).cast("long").alias("bit"), F.lit(kinds.index(h[2])).alias("kind"), *[v.alias(n) for v, n in zip(_value(h[1], h[2]), ("number", "text"))]) for h in own]
        values.append(tables[t].select(F.explode(F.array(*each)).alias("v")).select("v.*").where("number is not null or text is not null"))
        wide = tables[t].agg(F.count(F.lit(1)).alias("total"), *[F.count(F.col(f"`{h[1]}`")).alias(f"n{number[h]}") for h in own])
        plain.append(wide.select("total", F.explode(F.array(*[F.struct(F.lit(number[h]).alias("holder"), F.col(f"n{number[h]}").alias("filled")) for h in own])).alias("h")).select("h.*", "total"))
    bit = lambda w: F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))
    distinct = reduce(DataFrame.unionAll, values).distinct()
    sets = distinct.groupBy("kind", "number", "text").agg(*[F.bit_or(bit(w)).alias(m) for w, m in enumerate(words)]).groupBy(*words).agg(F.count(F.lit(1)).alias("values"))
    has = lambda word, bit: F.element_at(F.array(*words), F.col(word) + 1).bitwiseAND(F.col(bit)) != 0
    ends = [(number[t, c, d], number[u, k, d]) for (t, c, u, k), d in zip(pairs, domains)]
    asked = spark.createDataFrame([(i, a, a // _BITS, 1 << a % _BITS, b // _BITS, 1 << b % _BITS) for i, (a, b) in enumerate(ends)], "pair int, holder int, w int, b long, tw int, tb long")
    met = sets.join(F.broadcast(asked), has("w", "b")).groupBy("pair").agg(F.sum("values").alias("distinct_values"), F.sum(F.when(has("tw", "tb"), F.col("values")).otherwise(0)).alias("matched"))
    out = asked.join(F.broadcast(reduce(DataFrame.unionAll, plain)), "holder").join(F.broadcast(met), "pair", "left")  # a row per column, a row per pair
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = out.select("pair", zero("distinct_values"), zero("matched"), "total", (F.col("total") - F.col("filled")).alias("nulls"))
    return out.withColumn("refs", F.when(F.col("distinct_values") > 0, (F.col("total") - F.col("nulls")) / F.col("distinct_values")))


def _told(spark, pairs: list[tuple[str, str, str, str]], similarity: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, *p, float(s)) for i, (p, s) in enumerate(zip(pairs, similarity))], "pair int, from_table string, from_column string, to_table string, to_column string, similarity double")


def inclusions(tables: dict[str, DataFrame], min_overlap: float = 1.0) -> DataFrame:
    """Every pair of columns, whatever their names, where at least min_overlap of the distinct values of one are in the other.

    Columns are paired where their types are compatible and compared alike; columns without values are in none. One job.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]
    pairs = [(t, c, u, k) for t, c, a in columns for u, k, b in columns if (t, c) != (u, k) and compatible(a, b)]
    names = _told(spark, pairs, [0.0] * len(pairs))
    out = shared_values(tables, pairs).join(F.broadcast(names), "pair").where("distinct_values > 0")
    out = out.withColumn("overlap", F.col("matched") / F.col("distinct_values")).where(F.col("overlap") >= min_overlap)
    return out.select(*INFERRED[:4], F.col("distinct_values").alias("n_values"), F.round("overlap", 6).alias("overlap"))


def infer(
    tables: dict[str, DataFrame], info: dict[str, list[ColumnInfo]], min_overlap: float = 0.8, declared: set[tuple[str, str]] = frozenset(), strip_prefix: bool = False,
    references: tuple[tuple[str, str, str, str], ...] = (),
) -> DataFrame | None:
    """All references that names and types allow and whose overlap reaches the threshold; declared ones are not measured.

    All candidates are measured by one job (see shared_values). references (table, column, table, column) are declared ones
    that come into the result as they are, 1:N and HIGH, with an overlap and share of nulls that are not known.
    """
    known = set(declared) | {(t, c) for t, c, _, _ in references}
    found: list[Candidate] = [c for c in candidates(info, strip_prefix) if compatible(c.source.type, c.target.type) and (c.source.table, c.source.name) not in known]
    spark = next(iter(tables.values())).sparkSession if tables else None
    parts = []
    if found:
        pairs = [(c.source.table, c.source.name, c.target.table, c.target.name) for c in found]
        rows = shared_values(tables, pairs).join(F.broadcast(_told(spark, pairs, [c.similarity for c in found])), "pair")
        parts.append(_rated(rows, F.col("similarity"), [F.col(c) for c in INFERRED[:4]]).where(F.col("overlap") >= min_overlap))
    if references:
        told = [(t, c, u, k, None, "1:N", None, 1.0, "HIGH") for t, c, u, k in references]
        parts.append(spark.createDataFrame(told, "from_table string, from_column string, to_table string, to_column string, overlap double, cardinality string, null_pct double, score double, confidence string"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def orphans(source: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Distinct source values that the target lacks, with their number of rows."""
    counts = source.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(target.select(F.col(key).alias("value")), "value", "left_anti")
