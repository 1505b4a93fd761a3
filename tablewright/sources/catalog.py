"""Named tables with the keys that files cannot carry, catalog listings, ad-hoc SQL and file sources and sinks."""

from __future__ import annotations

import fnmatch
import json
import re
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.names import ColumnInfo

SYSTEM = ("information_schema", "pg_catalog", "pg_toast")


@dataclass
class TableMeta:
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # column, table, column


@dataclass
class TableSet:
    """DataFrames by name with declared keys; loaders register under a name and are called on first use."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, TableMeta] = field(default_factory=dict)

    @staticmethod
    def parquet(spark: SparkSession, folder: str, names: list[str]) -> TableSet:
        return TableSet(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    @staticmethod
    def jdbc(spark: SparkSession, url: str, names: list[str], **options: str) -> TableSet:
        """Tables of a database; filters and projections are pushed down by the source."""
        return TableSet(spark, {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names})

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def select(self, include: list[str] = (), exclude: list[str] = ()) -> list[str]:
        """Names that match any include pattern (all without one) and no exclude pattern: case-insensitive search."""
        hit = lambda ps, n: any(re.search(p, n, re.I) for p in ps)
        return [n for n in sorted(self.tables) if (not include or hit(include, n)) and not hit(exclude, n)]

    def list_tables(self, like: str = "%") -> DataFrame:
        """table, rows, columns, by name; rows are counted exactly, in one plan for all tables."""
        glob = like.replace("%", "*").replace("_", "?") if "%" in like or "_" in like else like
        names = [n for n in sorted(self.tables) if fnmatch.fnmatch(n, glob)]
        rows = [self.tables[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(len(self.tables[n].columns)).alias("columns")) for n in names]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "table string, rows bigint, columns int")

    def list_columns(self, names: list[str] | None = None) -> DataFrame:
        """table, column, position, type, nullable, primary_key, foreign key target."""
        out = []
        for n in names or sorted(self.tables):
            m = self.meta.get(n, TableMeta())
            refs = {c: f"{t}.{k}" for c, t, k in m.foreign_keys}
            out += [(n, f.name, i + 1, f.dataType.simpleString(), f.nullable, f.name in m.primary_key, refs.get(f.name)) for i, f in enumerate(self.tables[n].schema.fields)]
        return self.spark.createDataFrame(out, "table string, column string, position int, type string, nullable boolean, primary_key boolean, references string")

    def infos(self) -> dict[str, list[ColumnInfo]]:
        out = {}
        for n, df in self.tables.items():
            m = self.meta.get(n, TableMeta())
            single = {u[0] for u in (*m.unique, m.primary_key) if len(u) == 1}
            out[n] = [ColumnInfo(n, f.name, f.dataType.simpleString(), f.name in m.primary_key, f.name in single, f.nullable and f.name not in m.primary_key) for f in df.schema.fields]
        return out

    def query(self, text: str, args: dict | None = None, fetch_size: int | None = None) -> DataFrame:
        """Ad-hoc SQL over the set's tables as views, with named parameters and an optional row limit."""
        for n, df in self.tables.items():
            df.createOrReplaceTempView(n)
        out = self.spark.sql(text, args=args or {})
        return out if fetch_size is None else out.limit(fetch_size)

    def sample(self, name: str, n: int = 10) -> DataFrame:
        return self.tables[name].limit(n)


def schemas(spark: SparkSession, like: str = "*", system: bool = False) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases(like) if system or d.name not in SYSTEM)


def load_document(path: str) -> dict:
    """A JSON or YAML document by suffix; other suffixes are tried as JSON, then as YAML where it is installed."""
    text, suffix = Path(path).read_text(encoding="utf-8"), Path(path).suffix.lower()
    if suffix not in (".yaml", ".yml"):
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            if suffix == ".json":
                raise
    import yaml

    return yaml.safe_load(text)


def redact(url: str) -> str:
    """A connection URL without its password."""
    return re.sub(r"(://[^:/@]+):[^@]*@", r"\1:***@", url)


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def write_files(files: dict[str, str], folder: str) -> list[str]:
    """Generated text files below a folder; names may not leave it."""
    root = Path(folder).resolve()
    out = []
    for name, text in files.items():
        path = (root / name).resolve()
        if root not in path.parents:
            raise ValueError(f"{name} is outside of {folder}")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        out.append(str(path))
    return out
