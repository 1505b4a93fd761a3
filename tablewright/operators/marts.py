"""Wide tables from declared references, and hierarchies closed over their parent relation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """A join of a mart: the table that is joined, its place in the tree, and the columns of both ends."""

    path: tuple[str, ...]
    table: str
    source: tuple[str, ...]
    source_columns: tuple[str, ...]
    target_columns: tuple[str, ...]


def join_tree(root: str, references: list[tuple[str, tuple[str, ...], str, tuple[str, ...]]]) -> list[Step]:
    """The joins that follow all references (table, columns, table, columns) outward from the root, parents before children.

    A table that is reached in two ways is joined once for each, at its own place. References that lead back to a table on
    their own path are refused.
    """
    steps: list[Step] = []

    def follow(table: str, path: tuple[str, ...], passed: tuple[str, ...]) -> None:
        for source, columns, target, keys in references:
            if source != table:
                continue
            if target in passed:
                raise ValueError(f"references lead in a circle: {' -> '.join((*passed, target))}")
            twice = sum(s == source and t == target for s, _, t, _ in references) > 1
            place = (*path, f"{target}_by_{'_'.join(columns)}" if twice else target)
            steps.append(Step(place, target, path, tuple(columns), tuple(keys)))
            follow(target, place, (*passed, target))

    follow(root, (), (root,))
    return steps


def mart(tables: dict[str, DataFrame], root: str, references: list[tuple[str, tuple[str, ...], str, tuple[str, ...]]]) -> DataFrame:
    """One wide table with a row for each row of the root: its columns, and those of all tables that it refers to, directly or not.

    Columns keep their names while they are the only ones of that name; others get the path of their table before them. Target
    keys are left out, as the source columns hold the same values. References without a target give nulls. A target that
    repeats a key takes part with its least row, so rows never multiply. Joins are left to Catalyst: small targets are broadcast.
    """
    steps = join_tree(root, references)
    names = [c for c in tables[root].columns] + [c for s in steps for c in tables[s.table].columns if c not in s.target_columns]
    named = lambda path, c: c if not path or names.count(c) == 1 else "_".join((*path, c))
    at = {(): {c: c for c in tables[root].columns}}
    out = tables[root]
    for n, s in enumerate(steps):
        others = [c for c in tables[s.table].columns if c not in s.target_columns]
        target = tables[s.table].where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in s.target_columns]))
        rows = target.groupBy(*[F.col(f"`{c}`").alias(f"_k{n}_{i}") for i, c in enumerate(s.target_columns)])
        rows = rows.agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias(f"_v{n}")) if others else rows.agg(F.lit(None).alias(f"_v{n}"))
        own = at[s.source]
        on = reduce(lambda a, b: a & b, [F.col(f"`{own[c]}`") == F.col(f"_k{n}_{i}") for i, c in enumerate(s.source_columns)])
        out = out.join(rows, on, "left").select(*[F.col(f"`{c}`") for c in out.columns], *[F.col(f"_v{n}.`{c}`").alias(named(s.path, c)) for c in others])
        at[s.path] = {c: named(s.path, c) for c in others} | {k: own[c] for k, c in zip(s.target_columns, s.source_columns)}
    return out


def ancestors(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, depth, circular) of a hierarchical link: everything above each node with its least distance.

    A node that comes back to itself is its own ancestor, and its rows are circular. Links with a null end, and from a node to
    itself, are left out; repeated links count once. One recursive query, a join for each level of the hierarchy.
    """
    spark = links.sparkSession
    clean = links.select(F.col(child).alias("node"), F.col(parent).alias("above")).where("node is not null and above is not null and node <> above").distinct()
    clean.createOrReplaceTempView("_hierarchy")
    for limit in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        spark.conf.set(limit, -1)
    walked = spark.sql("""
        with recursive up(node, ancestor, depth, passed) as (
            select node, above, 1, array(node) from _hierarchy
            union all
            select up.node, h.above, up.depth + 1, array_append(up.passed, up.ancestor) from up join _hierarchy h on up.ancestor = h.node where not array_contains(up.passed, up.ancestor)
        )
        select node, ancestor, min(depth) as depth from up group by node, ancestor""")
    loops = walked.where("node = ancestor").select("node", F.lit(True).alias("_loop"))
    return walked.join(loops, "node", "left").select("node", "ancestor", F.col("depth").cast("long").alias("depth"), F.coalesce("_loop", F.lit(False)).alias("circular"))
