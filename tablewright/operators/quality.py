"""Data-quality rules: column globs bound to checks, evaluated on whole columns in one aggregation per table."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.semantics import PII
from . import profile

#: Cost of an issue in the table's score (fixed values).
COST = {"CRITICAL": 20.0, "HIGH": 10.0, "MEDIUM": 5.0, "LOW": 2.0, "INFO": 0.5}

#: Patterns that columns of these names should follow (fixed values).
FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\+]?[(]?[0-9]{1,4}[)]?[-\s\.]?[(]?[0-9]{1,4}[)]?[-\s\.]?[0-9]{1,9}$",
    "url": r"(?i)^https?://[^\s/$.?#].[^\s]*$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
}


@dataclass(frozen=True)
class Rule:
    """check is null_pct, unique_pct, pattern_pct, date_range, non_negative, min_length, max_length or in_set."""

    name: str
    glob: str
    check: str
    threshold: float
    severity: str
    enabled: bool = True
    regex: str | None = None
    values: tuple = ()

    def applies(self, column: str) -> bool:
        return self.enabled and fnmatch.fnmatch(column.lower(), self.glob.lower())


#: The rules that hold unless the caller gives others (fixed values).
DEFAULT = (
    Rule("id_no_nulls", "*_id", "null_pct", 0.0, "CRITICAL"),
    Rule("id_uniqueness", "*_id", "unique_pct", 100.0, "HIGH"),
    Rule("pk_no_nulls", "id", "null_pct", 0.0, "CRITICAL"),
    Rule("pk_uniqueness", "id", "unique_pct", 100.0, "CRITICAL"),
    Rule("email_format", "*email*", "pattern_pct", 95.0, "MEDIUM"),
    Rule("date_reasonable_range", "*date*", "date_range", 100.0, "LOW"),
    Rule("created_at_range", "created_at", "date_range", 100.0, "LOW"),
    Rule("updated_at_range", "updated_at", "date_range", 100.0, "LOW"),
    Rule("amount_non_negative", "*amount*", "non_negative", 100.0, "HIGH"),
    Rule("price_non_negative", "*price*", "non_negative", 100.0, "HIGH"),
    Rule("cost_non_negative", "*cost*", "non_negative", 100.0, "HIGH"),
    Rule("total_non_negative", "*total*", "non_negative", 100.0, "MEDIUM"),
    Rule("phone_format", "*phone*", "pattern_pct", 90.0, "LOW"),
    Rule("url_format", "*url*", "pattern_pct", 95.0, "LOW"),
    Rule("uuid_format", "*uuid*", "pattern_pct", 100.0, "HIGH"),
    Rule("status_completeness", "*status*", "null_pct", 5.0, "MEDIUM"),
    Rule("name_min_length", "*name*", "min_length", 1.0, "LOW"),
)


class RuleSet:
    """Rules by name: add, remove, enable, disable, list."""

    def __init__(self, rules: tuple[Rule, ...] = DEFAULT):
        self._rules = {r.name: r for r in rules}

    def add(self, rule: Rule) -> None:
        self._rules[rule.name] = rule

    def remove(self, name: str) -> bool:
        return self._rules.pop(name, None) is not None

    def enable(self, name: str, on: bool = True) -> None:
        self._rules[name] = Rule(**{**self._rules[name].__dict__, "enabled": on})

    def __iter__(self):
        return iter(self._rules.values())


def _observed(rule: Rule, c: Column, field: T.StructField) -> Column | None:
    """The figure that a rule looks at, or None where it does not apply to the type."""
    kind, values = field.dataType, F.count(c)
    share = lambda n: F.when(values > 0, n * 100.0 / values)
    if rule.check == "null_pct":
        total = F.count(F.lit(1))
        return F.when(total > 0, (total - values) * 100.0 / total).otherwise(0.0)
    if rule.check == "unique_pct":
        return values  # the share follows from distinct counts, which are made column by column
    if rule.check == "pattern_pct":
        regex = rule.regex or next((p for k, p in FORMATS.items() if k in field.name.lower()), None)
        return share(F.count_if(c.cast("string").rlike(regex))) if regex else None
    if rule.check == "date_range" and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return share(F.count_if(F.year(c).between(1900, 2100)))
    if rule.check == "non_negative" and isinstance(kind, T.NumericType):
        return share(F.count_if(c >= 0))
    if rule.check in ("min_length", "max_length") and isinstance(kind, T.StringType):
        return (F.min if rule.check == "min_length" else F.max)(F.length(c)).cast("double")
    if rule.check == "in_set":
        return share(F.count_if(c.isin(*rule.values)))
    return None


def _fails(rule: Rule, value: Column) -> Column:
    over = rule.check in ("null_pct", "max_length")
    return F.coalesce(value > rule.threshold if over else value < rule.threshold, F.lit(False))


def validate(df: DataFrame, name: str, rules=DEFAULT) -> DataFrame:
    """One row per rule and column it applies to: the observed figure and whether it passes. Columns without values pass."""
    bound = [(r, f, o) for f in df.schema.fields for r in rules if r.applies(f.name) and (o := _observed(r, F.col(f"`{f.name}`"), f)) is not None]
    schema = "table string, column string, rule string, severity string, threshold double, observed double, passed boolean"
    if not bound:
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(*[o.cast("double").alias(f"o{i}") for i, (_, _, o) in enumerate(bound)])
    unique = [i for i, (r, _, _) in enumerate(bound) if r.check == "unique_pct"]
    if unique:  # one narrow count for each column instead of rows that are multiplied by their number
        fields = list({bound[i][1].name: bound[i][1] for i in unique}.values())
        counts = profile.distinct_counts(df, fields).agg(F.map_from_entries(F.collect_list(F.struct("position", "distinct"))).alias("_distinct"))
        wide = wide.join(F.broadcast(counts), F.lit(True))  # one row and one row
        place = {f.name: k for k, f in enumerate(fields)}
        wide = wide.withColumns({f"o{i}": F.when(F.col(f"o{i}") > 0, F.element_at("_distinct", F.lit(place[bound[i][1].name])) * 100.0 / F.col(f"o{i}")) for i in unique})
    rows = [
        F.struct(F.lit(name).alias("table"), F.lit(f.name).alias("column"), F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(float(r.threshold)).alias("threshold"), F.round(f"o{i}", 4).alias("observed"), (~_fails(r, F.col(f"o{i}"))).alias("passed"))
        for i, (r, f, _) in enumerate(bound)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def report(results: DataFrame) -> DataFrame:
    """Per table: checks, passed, failed, pass rate and score (100 less the cost of each issue)."""
    cost = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in COST.items()], F.lit(5.0))
    out = results.groupBy("table").agg(F.count(F.lit(1)).alias("checks"), F.count_if("passed").alias("passed"), F.sum(F.when(F.col("passed"), 0.0).otherwise(cost)).alias("_cost"))
    return out.select("table", "checks", "passed", (F.col("checks") - F.col("passed")).alias("failed"), (F.floor(F.col("passed") * 10000.0 / F.col("checks") + 0.5) / 100).alias("pass_rate"), F.greatest(F.lit(0.0), 100.0 - F.col("_cost")).alias("score"))


def referential(source: DataFrame, column: str, target: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """Values, matching values, their share and the smallest missing values (at most `examples`)."""
    counts = source.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    keys = target.select(F.col(key).alias("key")).distinct()
    both = counts.join(keys, F.col("value") == F.col("key"), "left")
    sums = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("matched"))
    missing = both.where("key is null").orderBy("value").limit(examples).agg(F.array_sort(F.collect_list(F.col("value").cast("string"))).alias("missing"))
    return sums.join(missing, F.lit(True)).select("rows", "matched", F.when(F.col("rows") > 0, F.floor(F.col("matched") * 10000.0 / F.col("rows") + 0.5) / 100).otherwise(100.0).alias("pct"), "missing")


def failing(df: DataFrame, test: str, column: str, target: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows against a column test: not_null, unique (values with their count) or relationships (values with their count)."""
    if test == "not_null":
        return df.where(F.col(column).isNull())
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if test == "unique":
        return counts.where("n > 1")
    return counts.join(target.select(F.col(key).alias("value")), "value", "left_anti")


#: Column names that tell of personal data (fixed values).
TELLING = {
    "SSN": r"ssn|social.?security", "credit card": r"credit.?card|card.?number", "passport": r"passport", "driver's license": r"driver.?license|license.?number",
    "tax ID": r"tax.?id|ein|itin", "medical record": r"medical.?record|health.?id", "bank account": r"bank.?account|routing.?number",
}


def pii_exposure(types: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column, severity, what) from inferred types: a type that identifies people is noted; a telling name without one is worse."""
    out = [(c, "INFO", t) for c, t in types.items() if t in PII]
    named = lambda c: next((k for k, r in TELLING.items() if re.search(r, c.lower())), None)
    return out + [(c, "HIGH", named(c)) for c, t in types.items() if t not in PII and named(c)]
