"""Target models carried out on data: star schemas, slowly changing dimensions, measures and Data Vault loads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import GHOST_KEY, hash_diff, hash_key, surrogate_key


def staging(df: DataFrame, key: list[str]) -> DataFrame:
    """Key columns first, then the others."""
    return df.select(*key, *[c for c in df.columns if c not in key])


def join_on(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], keep: list[str], how: str = "left") -> DataFrame:
    """left with the columns `keep` of right, matched on all (left, right) column pairs."""
    side = right.select(*[F.col(r).alias(f"_k{i}") for i, (_, r) in enumerate(pairs)], *keep)
    on = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(pairs)])
    return left.join(side, on, how).drop(*[f"_k{i}" for i in range(len(pairs))])


def dimension(df: DataFrame, name: str, key: list[str], attributes: list[str]) -> DataFrame:
    """`<name>_key` (hash of the key columns), the natural key and the attributes; one row per key, of several the least."""
    least = df.groupBy(*key).agg(F.min(F.struct(*attributes)).alias("_least")) if attributes else df.select(*key).distinct()
    rows = least.select(*key, *[F.col(f"_least.`{a}`").alias(a) for a in attributes])
    return rows.select(surrogate_key(*key).alias(f"{name}_key"), *key, *attributes)


def fact(df: DataFrame, name: str, key: list[str], references: dict[str, list[str]], measures: list[str], degenerate: list[str] = ()) -> DataFrame:
    """`<name>_key`, a `<dimension>_key` for each reference (same hash as the dimension's, so no join is needed; null references
    give a null key), degenerate columns and measures."""
    refs = [F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]), surrogate_key(*cols)).alias(f"{d}_key") for d, cols in references.items()]
    return df.select(surrogate_key(*key).alias(f"{name}_key"), *refs, *degenerate, *measures)


def date_dimension(spark, first: str, last: str) -> DataFrame:
    """One row per day from first to last."""
    days = spark.sql(f"select explode(sequence(date '{first}', date '{last}', interval 1 day)) as date")
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"), "date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"), F.weekday("date").alias("weekday"), (F.weekday("date") >= 5).alias("is_weekend"),
    )


def junk_dimension(df: DataFrame, name: str, flags: list[str]) -> DataFrame:
    """The combinations of low-cardinality flags that occur, with a key."""
    return df.select(*flags).distinct().select(surrogate_key(*flags).alias(f"{name}_key"), *flags)


def additive(df: DataFrame, by: list[str], measure: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(measure).alias(f"sum_{measure}"))


def semi_additive(df: DataFrame, by: list[str], measure: str, order: str, tie: str) -> DataFrame:
    """The measure of the last row by (order, tie) in each group: balances add over everything but time."""
    return df.groupBy(*by).agg(F.max_by(measure, F.struct(order, tie)).alias(f"last_{measure}"))


def ratio(df: DataFrame, by: list[str], numerator: str, denominator: str, alias: str) -> DataFrame:
    """Ratio of sums: ratios themselves do not add."""
    return df.groupBy(*by).agg((F.sum(numerator) / F.sum(denominator)).alias(alias))


def allocation(df: DataFrame, group: list[str]) -> DataFrame:
    """Bridge rows with the share 1 / (members of the group)."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, group).withColumn("allocation_factor", 1.0 / F.col("_n")).drop("_n")


def scd0(history: DataFrame, key: list[str], order: str, tie: str) -> DataFrame:
    """The first row of each key."""
    rows = history.groupBy(*key).agg(F.min_by(F.struct(*[c for c in history.columns if c not in key]), F.struct(order, tie)).alias("_r"))
    return rows.select(*key, "_r.*")


def scd1(history: DataFrame, key: list[str], order: str, tie: str) -> DataFrame:
    """The last row of each key."""
    rows = history.groupBy(*key).agg(F.max_by(F.struct(*[c for c in history.columns if c not in key]), F.struct(order, tie)).alias("_r"))
    return rows.select(*key, "_r.*")


def scd2(history: DataFrame, key: list[str], attributes: list[str], order: str, tie: str) -> DataFrame:
    """One row per change of the attributes, with valid_from, valid_to (null: open) and is_current.

    Of several rows at one time the last by `tie` counts, so intervals never have zero length.
    """
    at = Window.partitionBy(*key).orderBy(order)
    last = history.groupBy(*key, order).agg(F.max_by(F.struct(*attributes), tie).alias("_a"))
    changed = last.withColumn("_before", F.lag("_a").over(at)).withColumn("_first", F.row_number().over(at) == 1).where(F.col("_first") | ~F.col("_a").eqNullSafe(F.col("_before")))
    out = changed.withColumn("valid_to", F.lead(order).over(at))
    return out.select(*key, "_a.*", F.col(order).alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"))


def scd3(history: DataFrame, key: list[str], attribute: str, order: str, tie: str) -> DataFrame:
    """Current and previous value of an attribute (the one before its last change)."""
    versions = scd2(history, key, [attribute], order, tie)
    previous = versions.withColumn("_p", F.lag(attribute).over(Window.partitionBy(*key).orderBy("valid_from")))
    return previous.where("is_current").select(*key, F.col(attribute).alias(f"current_{attribute}"), F.col("_p").alias(f"previous_{attribute}"), F.col("valid_from").alias("changed_at"))


def vault_stage(df: DataFrame, hash_name: str, key: list[str], attributes: list[str], source: str, load_time: Column, algorithm: str = "md5") -> DataFrame:
    """Source columns with hash key, change hash, load time and record source."""
    return df.select(hash_key(*key, algorithm=algorithm).alias(hash_name), hash_diff(*attributes, algorithm=algorithm).alias("HASHDIFF"), *key, *[a for a in attributes if a not in key], load_time.alias("LOAD_DTS"), F.lit(source).alias("RECORD_SOURCE"))


def _new(rows: DataFrame, key: str, existing: DataFrame | None) -> DataFrame:
    first = rows.groupBy(key).agg(F.min(F.struct("LOAD_DTS", *[c for c in rows.columns if c not in (key, "LOAD_DTS")])).alias("_r")).select(key, "_r.*").select(*rows.columns)
    return first if existing is None else first.join(existing.select(key), key, "left_anti")


def hub(df: DataFrame, name: str, key: list[str], source: str, load_time: Column, existing: DataFrame | None = None, algorithm: str = "md5") -> DataFrame:
    """New business keys: HK_<name>, key columns, LOAD_DTS, RECORD_SOURCE. Rows with a null in the key are left out."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return _new(df.where(ok).select(hash_key(*key, algorithm=algorithm).alias(f"HK_{name}"), *key, load_time.alias("LOAD_DTS"), F.lit(source).alias("RECORD_SOURCE")), f"HK_{name}", existing)


def link(df: DataFrame, name: str, hubs: dict[str, list[str]], source: str, load_time: Column, existing: DataFrame | None = None, algorithm: str = "md5") -> DataFrame:
    """New relations: LK_<name> over the keys of all hubs in the given order, each HK_<hub>, LOAD_DTS, RECORD_SOURCE."""
    every = [c for cols in hubs.values() for c in cols]
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in every])
    rows = df.where(ok).select(hash_key(*every, algorithm=algorithm).alias(f"LK_{name}"), *[hash_key(*cols, algorithm=algorithm).alias(f"HK_{h}") for h, cols in hubs.items()], load_time.alias("LOAD_DTS"), F.lit(source).alias("RECORD_SOURCE"))
    return _new(rows, f"LK_{name}", existing)


def satellite(history: DataFrame, hash_name: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows of staged history (hash key, HASHDIFF, attributes, LOAD_DTS) whose HASHDIFF differs from the one before, with LOAD_END_DTS.

    existing holds the satellite's rows so far; only its latest row of each key matters. Of rows with equal key and time the
    one with the greatest HASHDIFF counts.
    """
    cols = [c for c in history.columns if c not in (hash_name, "LOAD_DTS")]
    rows = history.groupBy(hash_name, "LOAD_DTS").agg(F.max(F.struct("HASHDIFF", *[c for c in cols if c != "HASHDIFF"])).alias("_r")).select(hash_name, "LOAD_DTS", "_r.*").withColumn("_old", F.lit(False))
    if existing is not None:
        latest = existing.groupBy(hash_name).agg(F.max(F.struct("LOAD_DTS", *cols)).alias("_r")).select(hash_name, "_r.*").withColumn("_old", F.lit(True))
        rows = latest.select(*rows.columns).unionByName(rows)
    at = Window.partitionBy(hash_name).orderBy("LOAD_DTS")
    changed = rows.withColumn("_before", F.lag("HASHDIFF").over(at)).where("_before is null or HASHDIFF <> _before")
    return changed.withColumn("LOAD_END_DTS", F.lead("LOAD_DTS").over(at)).where("not _old").drop("_before", "_old")


def point_in_time(hub_rows: DataFrame, snapshots: DataFrame, hash_name: str, satellites: dict[str, DataFrame]) -> DataFrame:
    """For each hub key and snapshot the latest LOAD_DTS, not after it, of each satellite; 1900-01-01 where there is none.

    The as-of join runs over one ordered stream of satellite rows and snapshots per key, not over pairs.
    """
    out = hub_rows.select(hash_name).crossJoin(snapshots.select("snapshot"))  # the result itself is hub x snapshots
    for name, sat in satellites.items():
        stream = out.select(hash_name, F.col("snapshot").alias("_at"), F.lit(1).alias("_ask")).unionByName(sat.select(hash_name, F.col("LOAD_DTS").alias("_at"), F.lit(0).alias("_ask")))
        seen = F.max(F.when(F.col("_ask") == 0, F.col("_at"))).over(Window.partitionBy(hash_name).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0))
        asked = stream.withColumn(f"{name}_LOAD_DTS", F.coalesce(seen, F.lit("1900-01-01").cast("timestamp_ntz").cast(dict(stream.dtypes)["_at"]))).where("_ask = 1").select(hash_name, F.col("_at").alias("snapshot"), f"{name}_LOAD_DTS")
        out = out.join(asked, [hash_name, "snapshot"])
    return out


def with_ghost(rows: DataFrame, hash_name: str, key: list[str]) -> DataFrame:
    """The hub with a record of unknown key, if it is absent: zeros, -1, 1900-01-01, SYSTEM."""
    values = {hash_name: F.lit(GHOST_KEY), "LOAD_DTS": F.lit("1900-01-01").cast("date"), "RECORD_SOURCE": F.lit("SYSTEM")} | {k: F.lit("-1") for k in key}
    ghost = rows.sparkSession.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionByName(ghost.join(rows.select(hash_name), hash_name, "left_anti"))


def bridge(link_rows: DataFrame, hubs: list[DataFrame], names: list[str]) -> DataFrame:
    """Hash keys of a link with its hubs' business keys, for queries without joins."""
    out = link_rows
    for h, n in zip(hubs, names):
        out = out.join(h.drop("LOAD_DTS", "RECORD_SOURCE"), f"HK_{n}", "left")
    return out


def effectivity(history: DataFrame, driving: str, link_key: str) -> DataFrame:
    """When each relation of a driving key held: EFFECTIVE_FROM, EFFECTIVE_TO (null: still)."""
    at = Window.partitionBy(driving).orderBy("LOAD_DTS", link_key)
    changed = history.withColumn("_b", F.lag(link_key).over(at)).where(F.col("_b").isNull() | (F.col("_b") != F.col(link_key)))
    return changed.select(driving, link_key, F.col("LOAD_DTS").alias("EFFECTIVE_FROM"), F.lead("LOAD_DTS").over(at).alias("EFFECTIVE_TO"))
