"""Sound pruning for searches over column sets: what a bounded sample of rows proves, and what counts imply.

Two rows of the sample that agree on X and differ in y are a violation of X -> y in the table, and two that agree on X are a
duplicate of X, whatever the other rows are. So a sample refutes and never confirms; which rows it holds changes the work
that is left, not the result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sample: the only rows that come to the driver, as 64-bit codes.
SAMPLE = 100_000
#: Column sets of a level that are keyed by one expression.
BATCH = 8
#: Rows of a table whose levels are counted by one job each, and whose codes are kept in memory.
SMALL = 200_000
#: Groups of equal rows that are told to every task.
TOLD = 1_000_000


def coded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as two 64-bit codes of its value, both null for a null: keys of fixed width, whatever the types.

    The first alone tells whether values of a group differ; both together make a group's key. -0.0 and 0.0 are equal, and NaN
    equals itself.
    """
    return df.select(*[code(df, c, seed).alias(f"{k}{i}") for i, c in enumerate(columns) for seed, k in ((1, "c"), (2, "d"))])


def code(df: DataFrame, column: str, seed: int) -> Column:
    """A 64-bit code of the column's value, null for a null."""
    v, kind = F.col(f"`{column}`"), dict(df.dtypes)[column]
    if kind in ("double", "float"):
        v = v + F.lit(0.0)
    if kind.startswith(("map", "variant")) or "map<" in kind:
        v = F.to_json(F.struct(v))
    return F.when(F.col(f"`{column}`").isNotNull(), F.xxhash64(F.lit(seed), v))


def spread(table: DataFrame) -> DataFrame:
    """The table in at least as many partitions as there are cores; a level's work is many times the reading of its rows."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


class Sample:
    """At most `SAMPLE` rows of a coded table: half of them neighbours, which often share a value, half from anywhere."""

    def __init__(self, table: DataFrame, total: int, n: int, size: int | None = None):
        size = SAMPLE if size is None else size
        codes = table.select(*[f"c{i}" for i in range(n)])
        if total <= size:
            got = codes.limit(size).toArrow()
        else:
            first = codes.take(size // 2)  # from as few partitions as have them: a limit would shuffle that many rows of each
            near = pa.table({c: pa.array([r[i] for r in first], pa.int64()) for i, c in enumerate(codes.columns)})
            got = pa.concat_tables([near, codes.sample(min(1.0, 0.6 * size / total), seed=7).limit(size // 2).toArrow().cast(near.schema)])
        small = pd.DataFrame({i: c.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) for i, c in enumerate(got.columns)})
        self.whole = total <= size
        if not self.whole:  # a row may be in both halves: equal rows prove no duplicate
            small = small.drop_duplicates()
        self.codes = [small[i].to_numpy() for i in range(n)]

    def _groups(self, xs: tuple[int, ...]) -> np.ndarray:
        """A number for each row, equal where all of xs are; nulls equal each other."""
        out = self.codes[xs[0]] + 1
        for x in xs[1:]:
            out = out * (self.codes[x].max(initial=0) + 2) + self.codes[x] + 1
            out = pd.factorize(out)[0].astype(np.int64)
        return out

    def violations(self, xs: tuple[int, ...], ys: list[int]) -> list[int]:
        """For each y, groups of X that hold two different values of it."""
        group = self._groups(xs)
        again = pd.Index(group).duplicated(keep=False)
        out = []
        for y in ys:
            held = again & (self.codes[y] >= 0)
            values = self.codes[y].max(initial=0) + 1
            pairs = pd.unique(group[held] * values + self.codes[y][held]) // values  # a group for each of its values
            out.append(len(pd.unique(pairs[pd.Index(pairs).duplicated()])))
        return out

    def repeats(self, xs: tuple[int, ...]) -> int:
        """How many rows agree on X with a different one before them, neither with a null in it."""
        filled = np.logical_and.reduce([self.codes[x] >= 0 for x in xs])
        return int(pd.Index(self._groups(xs)[filled]).duplicated().sum())


def level(columns: range, found: list[frozenset[int]], size: int) -> list[tuple[int, ...]]:
    """The sets of a size that contain none of found."""
    return [xs for xs in combinations(columns, size) if not any(f <= set(xs) for f in found)]
