"""Functional dependencies and candidate keys mined from data.

A left side is checked against all right sides in one groupBy: y depends on X where min(y) = max(y) in every group that has a y.
That needs no distinct counts, so partial aggregation applies. The lattice is walked on the driver, a job for each level, after a
bounded sample and counts have refuted what they can.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dependencies import Dependency, classify
from ..session import delete, shared_folder, tidy
from . import lattice

DEPENDENCY = "determinant array<string>, dependent string, confidence double, support double, groups bigint, violations bigint, is_partial boolean, is_transitive boolean"


def check(df: DataFrame, determinant: list[str], dependents: list[str]) -> DataFrame:
    """One row per right side: groups of X that hold a non-null y, groups with several y, confidence to four places.

    Nulls in X form groups like values. Right sides without any group have null confidence.
    """
    ys = [F.col(f"`{y}`") for y in dependents]
    per = df.groupBy(*[F.col(f"`{x}`").alias(f"x{i}") for i, x in enumerate(determinant)]).agg(
        *[F.min(y).alias(f"lo{i}") for i, y in enumerate(ys)], *[F.max(y).alias(f"hi{i}") for i, y in enumerate(ys)]
    )
    wide = per.agg(*[F.count(f"lo{i}").alias(f"g{i}") for i in range(len(ys))], *[F.count_if(F.col(f"lo{i}") != F.col(f"hi{i}")).alias(f"v{i}") for i in range(len(ys))])
    rows = F.array(*[F.struct(F.lit(y).alias("dependent"), F.col(f"g{i}").alias("groups"), F.col(f"v{i}").alias("violations")) for i, y in enumerate(dependents)])
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    confidence = F.when(F.col("groups") > 0, F.floor((1 - F.col("violations") / F.col("groups")) * 10000 + 0.5) / 10000)
    return out.select(F.array(*map(F.lit, determinant)).alias("determinant"), "dependent", "groups", "violations", confidence.alias("confidence"))


def _keyed(table: DataFrame, sets: list[tuple[int, tuple[int, ...]]], nulls: bool, ys: list[int]) -> DataFrame:
    """(s, k1, k2, and the codes of ys): a row for each row of a coded table and numbered set of columns, keyed by 128 bits.

    Rows with a null in the set count (nulls) or are left out.
    """
    part = lambda seed, k, xs: F.xxhash64(F.lit(seed), *[F.coalesce(F.col(f"{k}{x}"), F.lit(0)) for x in xs])
    keys = []
    for j, xs in sets:
        key = F.struct(F.lit(j).alias("s"), part(1, "c", xs).alias("k1"), part(2, "d", xs).alias("k2"))
        keys.append(key if nulls else F.when(F.expr(" and ".join(f"c{x} is not null" for x in xs)), key))
    rows = table.select(F.explode(F.array(*keys)).alias("k"), *[f"c{y}" for y in ys]).select("k.*", *[f"c{y}" for y in ys])
    return rows if nulls else rows.where("s is not null")


def _branches(wanted: list) -> list[list]:
    """Numbered parts of a level, small enough to compile well; all of them are one job."""
    numbered = list(enumerate(wanted))
    return [numbered[i : i + lattice.BATCH] for i in range(0, len(numbered), lattice.BATCH)]


def _counted(table: DataFrame, wanted: list[tuple[tuple[int, ...], list[int]]]) -> list[tuple[int, dict[int, tuple[int, int]]]]:
    """For each (X, ys) of a coded table: groups of X, and for each y its groups and violations. One job.

    A row goes to the shuffle once for each X, after partial aggregation, as a number, a key of 128 bits and the least and greatest code of each y.
    """
    parts = []
    for branch in _branches(wanted):
        ys = sorted({y for _, (_, each) in branch for y in each})
        groups = _keyed(table, [(j, xs) for j, (xs, _) in branch], True, ys).groupBy("s", "k1", "k2").agg(*[f(f"c{y}").alias(f"{name}{y}") for y in ys for f, name in ((F.min, "lo"), (F.max, "hi"))])
        sums = groups.groupBy("s").agg(F.count(F.lit(1)).alias("groups"), *[F.count(f"lo{y}").alias(f"g{y}") for y in ys], *[F.count_if(F.col(f"lo{y}") != F.col(f"hi{y}")).alias(f"v{y}") for y in ys])
        parts.append(sums.select("s", "groups", F.array(*[F.struct(F.lit(y).alias("y"), F.col(f"g{y}").alias("g"), F.col(f"v{y}").alias("v")) for y in ys]).alias("each")))
    got = {r.s: r for r in reduce(DataFrame.unionAll, parts).collect()} if parts else {}  # a row for each X
    return [(got[j].groups, {e.y: (e.g, e.v) for e in got[j].each}) for j in range(len(wanted))]


def _confidence(groups: int, violations: int) -> float:
    return math.floor((1 - violations / groups) * 10000 + 0.5) / 10000


@dataclass
class Work:
    """What a search over column sets did: (X, y) or X that pruning left, that a sample or counts refuted, that were counted, and jobs."""

    candidates: int = 0
    refuted: int = 0
    counted: int = 0
    jobs: int = 0


def discover(df: DataFrame, columns: list[str] | None = None, max_size: int = 3, min_confidence: float = 0.95, sample: int = lattice.SAMPLE, work: Work | None = None) -> list[Dependency]:
    """Dependencies with left sides of 1 to max_size columns; a right side that a smaller left side determines is skipped.

    Values are coded once. Each level's left sides are counted by one job, single columns first. From then on a candidate is refuted before any count where a sample of `sample` rows holds so many violations of X -> y
    that the confidence cannot be reached, X having at most as many groups as the product of its parts'. A left side whose groups
    are all single rows is a key and determines all, so no superset of it is looked at. Nulls in X form groups like values.
    """
    columns = list(columns or df.columns)
    work = Work() if work is None else work
    if len(columns) < 2:
        return []
    table = lattice.spread(lattice.coded(df, columns)).persist()
    found: list[Dependency] = []
    try:
        total = table.count()
        work.jobs += 1
        if not total:
            return []
        n, groups = len(columns), {}
        seen = None
        for size in range(1, min(max_size, n - 1) + 1):
            wanted = []
            for xs in combinations(range(n), size):
                names = {columns[x] for x in xs}
                done = {d.dependent for d in found if set(d.determinant) < names}
                ys = [y for y in range(n) if y not in xs and columns[y] not in done]
                work.candidates += len(ys)
                if size > 1 and ys:
                    if seen is None:
                        seen = lattice.Sample(table, total, n, sample)
                        work.jobs += 1 if seen.whole else 2
                    most = min(total, *(math.prod(groups[part] for part in parts) for parts in _splits(xs, groups)))
                    against = seen.violations(xs, ys)
                    kept = [y for y, v in zip(ys, against) if not v or _confidence(max(most, v), v) >= min_confidence]
                    work.refuted += len(ys) - len(kept)
                    ys = kept
                if ys:
                    wanted.append((xs, ys))
            work.jobs += bool(wanted)
            for (xs, ys), (groups[xs], each) in zip(wanted, _counted(table, wanted)):
                work.counted += len(ys)
                for y in ys:
                    g, v = each[y]
                    if g and (c := _confidence(g, v)) >= min_confidence:
                        found.append(Dependency(tuple(columns[x] for x in xs), columns[y], c, g, v))
    finally:
        table.unpersist()
    return sorted(classify(found), key=lambda d: (len(d.determinant), -d.confidence, d.determinant, d.dependent))


def _splits(xs: tuple[int, ...], groups: dict[tuple[int, ...], int]) -> list[list[tuple[int, ...]]]:
    """Ways to cut X into single columns, and into one counted part and single columns."""
    out = [[(x,) for x in xs]]
    for size in range(2, len(xs)):
        out += [[part, *((x,) for x in xs if x not in part)] for part in combinations(xs, size) if part in groups]
    return out


def verify(df: DataFrame, determinant: list[str], dependent: str, min_confidence: float = 0.95) -> DataFrame:
    """The dependency's row of check() if it reaches the confidence, else none."""
    return check(df, determinant, [dependent]).where(F.col("confidence") >= min_confidence)


def as_frame(spark, found: list[Dependency]) -> DataFrame:
    return spark.createDataFrame([(list(d.determinant), d.dependent, d.confidence, d.confidence, d.groups, d.violations, d.partial, d.transitive) for d in found], DEPENDENCY)


def violations(df: DataFrame, determinant: list[str], dependent: str, limit: int = 100, tie: list[str] = ()) -> DataFrame:
    """Rows of the groups of X with several y, ordered by X, y and tie, at most `limit`; groups with a null in X are left out."""
    bad = df.groupBy(*determinant).agg(F.min(dependent).alias("_lo"), F.max(dependent).alias("_hi")).where("_lo <> _hi").drop("_lo", "_hi")
    return df.join(bad, determinant).orderBy(*determinant, dependent, *tie).limit(limit)


@dataclass(frozen=True)
class Key:
    columns: tuple[str, ...]
    uniqueness: float
    null_pct: float


def check_keys(df: DataFrame, combos: list[list[str]]) -> DataFrame:
    """One row per column set: distinct share among rows without nulls in it, and share of rows with a null in it.

    Each set is counted by itself over its own columns, merged before the shuffle; no row is multiplied.
    """
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))  # one row
    each = []
    for xs in combos:
        kept = df.where(F.expr(" and ".join(f"`{c}` is not null" for c in xs)))
        counts = kept.groupBy(*[F.col(f"`{c}`").alias(f"k{j}") for j, c in enumerate(xs)]).agg(F.count(F.lit(1)).alias("rows"))
        each.append(counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("d")).select(F.array(*map(F.lit, xs)).alias("columns"), "n", "d"))
    out = reduce(DataFrame.unionByName, each).join(total)
    return out.select("columns", F.col("d").alias("distinct_keys"), F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(0.0).alias("uniqueness"), F.when(F.col("total") > 0, (F.col("total") - F.col("n")) * 100.0 / F.col("total")).otherwise(0.0).alias("null_pct"))


def find_keys(df: DataFrame, columns: list[str] | None = None, max_size: int = 4, min_uniqueness: float = 1.0, max_null_pct: float = 0.0, sample: int = lattice.SAMPLE, work: Work | None = None) -> list[Key]:
    """Column sets that are unique and without nulls, by size; supersets of a key are skipped.

    Values are coded. Before any count of a set, it is refuted where one of its columns has too many nulls, where its parts
    have too few values for that many rows, or (for full uniqueness) where two rows of a sample agree on it. What is left of a
    level is counted by one job; in tables of more than `lattice.SMALL` rows it is settled over the rows that repeat a part of it
    (`_Repeated`), so the disk holds one 64-bit key for each row at a time, however many sets there are.
    """
    columns = list(columns or df.columns)
    work = Work() if work is None else work
    n, keys = len(columns), []
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    work.jobs += 1
    total, filled = row.total, [row[f"n{i}"] for i in range(n)]
    if not total:
        return []
    large = total > lattice.SMALL
    once = max_size == 1 and min_uniqueness >= 1 and total <= sample  # one level, and the sample has all rows: codes that differ prove a key
    table = lattice.coded(df, columns) if large or once else lattice.spread(lattice.coded(df, columns)).persist()
    repeated = None
    try:
        seen = lattice.Sample(table, total, n, sample) if min_uniqueness >= 1 else None
        work.jobs += (1 if seen.whole else 2) if seen else 0
        repeated = _Repeated(df, columns, total, filled, seen, work) if large and seen else None
        values: dict[tuple[int, ...], int] = {}
        for size in range(1, min(max_size, n) + 1):
            wanted = []
            for xs in lattice.level(range(n), [frozenset(columns.index(c) for c in k.columns) for k in keys], size):
                work.candidates += 1
                least = total - sum(total - filled[x] for x in xs)  # rows without a null in X, at least
                few = size > 1 and all((x,) in values for x in xs) and min(math.prod(values[p] for p in parts) for parts in _splits(xs, values)) < min_uniqueness * least
                if any((total - filled[x]) * 100.0 / total > max_null_pct for x in xs) or few or seen and seen.repeats(xs):
                    work.refuted += 1
                else:
                    wanted.append(xs)
            work.counted += len(wanted)
            if once:
                counts = [(filled[x], filled[x]) for (x,) in wanted]
            elif repeated:
                counts = [(whole, whole) for whole in repeated.unique(wanted)]
            elif large:
                with tidy(df.sparkSession):
                    counts = [_distinct([(table, [xs])])[0] for xs in wanted]
                work.jobs += len(wanted)
            else:
                counts = _distinct([(table, wanted)])
                work.jobs += bool(wanted)
            for xs, (distinct, whole) in zip(wanted, counts):
                if not repeated:
                    values[xs] = distinct
                uniqueness, null_pct = distinct / whole if whole else 0.0, (total - whole) * 100.0 / total
                if whole and uniqueness >= min_uniqueness and null_pct <= max_null_pct:
                    keys.append(Key(tuple(columns[x] for x in xs), uniqueness, null_pct))
    finally:
        if repeated:
            repeated.close()
        table.unpersist()
    return keys


def _distinct(tables: list[tuple[DataFrame, list[tuple[int, ...]]]]) -> list[tuple[int, int]]:
    """For each set of columns of coded tables: its distinct values, and the rows without a null in it. One job."""
    parts, first = [], 0
    for table, sets in tables:
        for branch in _branches(sets):
            keyed = _keyed(table, [(first + j, xs) for j, xs in branch], False, [])
            parts.append(keyed.groupBy("s", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("whole")))
        first += len(sets)
    got = {r.s: (r.distinct, r.whole) for r in reduce(DataFrame.unionAll, parts).collect()} if parts else {}  # a row for each set
    return [got.get(j, (0, 0)) for j in range(first)]


class _Repeated:
    """The rows of a large table that agree with another one on a part of the columns.

    Rows that agree on X agree on each part of X, so X is unique where it is unique among the rows that repeat a part of it. For
    a part that is nearly unique these are few, and all sets that contain it are settled over them. A part costs one shuffle of a
    64-bit code for each row and one more scan; its files are deleted before the next. Equal codes are judged by 128 bits
    afterwards. Which parts are chosen changes the work alone: a set without a good part is its own part.
    """

    def __init__(self, df: DataFrame, columns: list[str], total: int, filled: list[int], seen: lattice.Sample, work: Work):
        self.df, self.columns, self.total, self.filled, self.seen, self.work = df, columns, total, filled, seen, work
        self.folder = shared_folder(df.sparkSession, "repeated")
        #: For each part that was counted: its coded rows and how many they are, or None where they are too many.
        self.parts: dict[tuple[int, ...], tuple[DataFrame | None, int] | None] = {}

    def close(self) -> None:
        delete(self.df.sparkSession, self.folder)

    def _count(self, xs: tuple[int, ...]) -> None:
        spark, path = self.df.sparkSession, f"{self.folder}/{'-'.join(map(str, xs))}"
        table = self.df.select(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(self.columns)])
        codes = [lattice.code(table, f"v{x}", 1) for x in xs]
        keyed = table.withColumn("_k", F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in codes]), F.xxhash64(*codes)))
        groups = keyed.select("_k").where("_k is not null").repartition("_k").groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        with tidy(spark):
            groups.write.parquet(f"{path}-groups")
            groups = spark.read.schema("_k long, n long").parquet(f"{path}-groups")
            told = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
            self.work.jobs += 2
            self.parts[xs] = (None, 0) if not told.rows else None
            if told.rows and told.groups <= lattice.TOLD and told.rows <= self.total / 8:
                rows = lattice.coded(keyed.join(F.broadcast(groups.select("_k")), "_k", "left_semi"), table.columns)
                rows.write.parquet(path)
                self.work.jobs += 1
                self.parts[xs] = spark.read.schema(rows.schema).parquet(path), told.rows
        delete(spark, f"{path}-groups")

    def _part(self, xs: tuple[int, ...]) -> tuple[int, ...] | None:
        """The counted part of X with the fewest rows."""
        return min((p for p, got in self.parts.items() if got and set(p) <= set(xs)), key=lambda p: self.parts[p][1], default=None)

    def _next(self, left: list[tuple[int, ...]]) -> tuple[int, ...]:
        """A part to count: of those that the sample lets expect few repeated rows, one that serves most sets, else a set itself."""
        size = max(1, len(self.seen.codes[0]))
        limit = self.total / 16 / (self.total / size) ** 2  # pairs of equal rows grow with the square
        serves: dict[tuple[int, ...], int] = {}
        for xs in left:
            for k in range(1, len(xs)):
                for p in combinations(xs, k):
                    serves[p] = serves.get(p, 0) + 1
        likely = {p: r for p in serves if p not in self.parts and (r := self.seen.repeats(p)) <= limit}
        return max(likely, key=lambda p: (serves[p], -likely[p]), default=left[0])

    def unique(self, wanted: list[tuple[int, ...]]) -> list[int]:
        """For each X: the rows without a null in it if X is unique among them, else 0."""
        crowded = lambda xs: xs in self.parts and self.parts[xs] is None
        while left := [xs for xs in wanted if not crowded(xs) and self._part(xs) is None]:
            self._count(self._next(left))
        by_part: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for xs in wanted:
            if not crowded(xs):
                by_part.setdefault(self._part(xs), []).append(xs)
        found = {xs for p, sets in by_part.items() if self.parts[p][0] is None for xs in sets}
        some = {p: sets for p, sets in by_part.items() if self.parts[p][0] is not None}
        if some:
            with tidy(self.df.sparkSession):
                counts = _distinct([(self.parts[p][0], sets) for p, sets in some.items()])
            self.work.jobs += 1
            found |= {xs for xs, (distinct, whole) in zip([xs for sets in some.values() for xs in sets], counts) if distinct == whole}
        holed = [xs for xs in wanted if xs in found and any(self.filled[x] < self.total for x in xs)]
        whole = dict.fromkeys(found, self.total)
        if holed:
            row = self.df.agg(*[F.count_if(reduce(lambda a, b: a & b, [F.col(f"`{self.columns[x]}`").isNotNull() for x in xs])).alias(f"w{i}") for i, xs in enumerate(holed)]).first()
            self.work.jobs += 1
            whole |= {xs: row[f"w{i}"] for i, xs in enumerate(holed)}
        return [whole.get(xs, 0) for xs in wanted]


def find_single_keys(df: DataFrame, columns: list[str] | None = None, min_uniqueness: float = 1.0, max_null_pct: float = 0.0) -> list[Key]:
    """Keys of one column."""
    return find_keys(df, columns, 1, min_uniqueness, max_null_pct)
