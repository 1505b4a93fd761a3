"""Whole runs: analyse tables, normalize them, build a star."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import dependencies, models, normalize, profile, relationships
from .plans import semantics
from .plans.dependencies import synthesize_3nf, verdict
from .plans.design import Design
from .sources.catalog import TableSet


def analyze(tables: TableSet, max_determinant: int = 3, max_key: int = 4) -> dict:
    """Profiles, dependencies, keys, references and semantic types of all tables."""
    prof = reduce(DataFrame.unionByName, [profile.columns(df, n) for n, df in tables.tables.items()]).persist()
    stats = {(r.table, r.column): r for r in prof.collect()}  # a row per column
    found = {n: dependencies.discover(df, max_size=max_determinant) for n, df in tables.tables.items()}
    types = [semantics.infer(c, r.dtype, (), semantics.Statistics(r.total, r.distinct or 0, r.null_pct, bool(r.is_unique))) for (_, c), r in stats.items()]
    declared = tuple((n, c, t, k) for n, m in tables.meta.items() for c, t, k in m.foreign_keys)
    return {
        "profile": prof, "scores": profile.table_scores(prof), "dependencies": found, "keys": {n: dependencies.find_keys(df, max_size=max_key) for n, df in tables.tables.items()},
        "forms": {n: verdict(tables[n].columns, fds)["form"] for n, fds in found.items()}, "references": relationships.infer(tables.tables, tables.infos(), strip_prefix=True, references=declared), "types": types,
    }


def summary(analysis: dict) -> DataFrame:
    """One row of an analysis: tables, columns, rows, mean quality, dependencies, keys, references, and tables by normal form."""
    prof = analysis["profile"]
    counts = {"dependencies": sum(map(len, analysis["dependencies"].values())), "keys": sum(map(len, analysis["keys"].values())), "references": analysis["references"].count() if analysis["references"] is not None else 0}
    forms = [f for f in analysis["forms"].values()]
    rows = prof.groupBy("table").agg(F.first("total").alias("total"), F.count(F.lit(1)).alias("columns"), F.sum("quality").alias("quality"))
    row = rows.agg(F.count(F.lit(1)).alias("tables"), F.sum("columns").alias("columns"), F.sum("total").alias("rows"), (F.sum("quality") / F.sum("columns")).alias("mean_quality"))
    return row.select("*", *[F.lit(n).alias(k) for k, n in counts.items()], *[F.lit(forms.count(f)).alias(f"form_{f.lower()}") for f in ("UNNORMALIZED", "1NF", "2NF", "3NF", "BCNF")])


def document(df: DataFrame, name: str, values: int = 5, samples: int = 5, patterns: int = 3) -> dict:
    """A table's profile as a document: statistics of each column with its best patterns, most frequent values and samples.

    Reports of a fixed size for each column; only they come to the driver.
    """
    out = {"table": name, "columns": []}
    for r in sorted(profile.columns(df, name).collect(), key=lambda r: r.position):
        column = r.asDict()
        text = dict(df.dtypes)[r.column] == "string"
        found = profile.patterns(df, r.column).orderBy(F.desc("pct"), "pattern").limit(patterns).collect() if text else []
        column["patterns"] = [p.asDict() for p in found]
        simple = not any(sign in dict(df.dtypes)[r.column] for sign in ("array", "map", "struct"))
        column["top_values"] = [v.asDict() for v in profile.top_values(df, r.column, values).collect()] if simple else []
        column["samples"] = [v.value for v in profile.sample_values(df.select(F.col(f"`{r.column}`").cast("string").alias(r.column)), r.column).limit(samples).collect()] if simple else []
        out["columns"].append(column)
    return out | {"rows": out["columns"][0]["total"] if out["columns"] else 0}


def normalize_3nf(df: DataFrame, fds) -> dict[str, DataFrame]:
    """The relations of a table in third normal form, named by their keys."""
    parts = synthesize_3nf(df.columns, fds)
    return dict(zip(["_".join(k) for _, k in parts], normalize.relations(df, [r for r, _ in parts])))


def build_star(tables: TableSet, design: Design) -> dict[str, DataFrame]:
    """Dimensions (versioned where the design says type 2 and names an order column last) and facts of a star design."""
    out = {}
    for t in design.tables:
        source = tables[t.source] if t.source else None
        if t.role == "dimension":
            out[t.name] = models.dimension(source, t.name.removeprefix("dim_"), t.of("natural_key", "business_key"), t.of("attribute"))
        elif t.role == "fact":
            refs = {r.target.removeprefix("dim_"): list(r.source_columns) for r in design.relations if r.source == t.name}
            out[t.name] = models.fact(source, t.name.removeprefix("fact_"), t.of("natural_key", "business_key"), refs, t.of("measure"), t.of("attribute"))
    return out
