"""A whole Data Vault from a design and its source tables: hubs, links, satellites, points in time, and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.design import Design, DesignTable
from . import models

#: What becomes a hub, and what a link (fixed values).
HUBS = frozenset(("dimension", "hub", "entity", "lookup"))
LINKS = frozenset(("fact", "junction", "link", "bridge"))


def kind(table: DesignTable) -> str | None:
    """hub, link or satellite; a table of another role is a hub if it has a business key, else nothing."""
    if table.role in HUBS:
        return "hub"
    if table.role in LINKS:
        return "link"
    return "satellite" if table.role == "satellite" else "hub" if table.of("business_key", "natural_key") else None


def short(name: str) -> str:
    """A table's name without the prefix of its role."""
    head, _, tail = name.partition("_")
    return tail if tail and head in ("dim", "fact", "hub", "link", "sat", "bridge", "lkp") else name


def build(sources: dict[str, DataFrame], design: Design, load_time: Column, record_source: str, snapshots: DataFrame | None = None, ghosts: bool = False) -> dict[str, DataFrame]:
    """HUB_x and SAT_x of every entity, LINK_x and, where it has attributes, SAT_x of every relation; PIT_x with snapshots.

    A link joins the hubs of the relations that start at its table, by the columns named there. Links over fewer than two
    hubs, and hubs without a key, are left out. ghosts adds the record of unknown key to hubs.
    """
    out: dict[str, DataFrame] = {}
    keys = {t.name: t.of("business_key", "natural_key") for t in design.tables}
    for t in design.tables:
        if kind(t) != "hub" or not keys[t.name]:
            continue
        name, rows = short(t.name), sources[t.source or t.name]
        made = models.hub(rows, name, keys[t.name], record_source, load_time)
        out[f"HUB_{name}"] = models.with_ghost(made, f"HK_{name}", keys[t.name]) if ghosts else made
        attributes = t.of("attribute", "measure")
        if attributes:
            staged = models.vault_stage(rows, f"HK_{name}", keys[t.name], attributes, record_source, load_time).drop(*keys[t.name])
            out[f"SAT_{name}"] = models.satellite(staged, f"HK_{name}")
            if snapshots is not None:
                out[f"PIT_{name}"] = models.point_in_time(made, snapshots, f"HK_{name}", {f"SAT_{name}": out[f"SAT_{name}"]})
    for t in design.tables:
        if kind(t) != "link":
            continue
        hubs = {short(r.target): list(r.source_columns) for r in design.relations if r.source == t.name and f"HUB_{short(r.target)}" in out}
        if len(hubs) < 2:
            continue
        name, rows = short(t.name), sources[t.source or t.name]
        out[f"LINK_{name}"] = models.link(rows, name, hubs, record_source, load_time)
        every = [c for columns in hubs.values() for c in columns]
        attributes = [a for a in t.of("attribute", "measure") if a not in every]
        if attributes:
            known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in every])
            staged = models.vault_stage(rows.where(known), f"LK_{name}", every, attributes, record_source, load_time).drop(*every)
            out[f"SAT_{name}"] = models.satellite(staged, f"LK_{name}")
    return out


def checks(vault: dict[str, DataFrame]) -> DataFrame:
    """(table, column, test, failures): keys are there and unique, links refer to hubs, satellites to hubs or links."""
    parts = []

    def add(table: str, column: str, test: str, failures: DataFrame) -> None:
        parts.append(failures.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(table).alias("table"), F.lit(column).alias("column"), F.lit(test).alias("test"), "failures"))

    owner = {}
    for table, rows in vault.items():
        if table.startswith(("HUB_", "LINK_")):
            owner[rows.columns[0]] = rows
    for table, rows in vault.items():
        key = rows.columns[0]
        if table.startswith(("HUB_", "LINK_")):
            add(table, key, "not_null", rows.where(F.col(key).isNull()))
            add(table, key, "unique", rows.groupBy(key).count().where("count > 1"))
        if table.startswith("SAT_"):
            add(table, key, "unique_at_a_time", rows.groupBy(key, "LOAD_DTS").count().where("count > 1"))
        refers = [c for c in rows.columns if c.startswith("HK_") and table.startswith("LINK_")] + ([key] if table.startswith(("SAT_", "PIT_")) else [])
        for c in refers:
            add(table, c, "refers", rows.select(c).join(owner[c].select(c), c, "left_anti"))
    return reduce(DataFrame.unionByName, parts)
