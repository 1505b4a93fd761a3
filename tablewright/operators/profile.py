"""Column and table profiles in a few scans per table.

All plain statistics of all columns come from one aggregation; exact distinct counts read one column each beside it, and exact
quantiles of up to TOGETHER columns a sample and two scans more, or further ones over narrower intervals on large tables. The
wide result is one row; it is turned into one row per column inside the plan. Only that row and ends and counts of intervals, a
few numbers for each column, come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import PROFILE

QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
BASIC = ("total", "non_null", "nulls", "null_pct", "distinct", "distinct_pct", "is_unique")
NUMERIC = ("min", "max", "mean", "stddev", *QUANTILES)
STRINGS = ("min_len", "max_len", "avg_len", "empties")


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def percent(part: Column, whole: Column) -> Column:
    """Percentage to two places, half up; 0 of 0 is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 10000.0 / whole + 0.5) / 100.0)


#: Relative rank error of the sketches that propose the ends of intervals.
SKETCH = 2_000


def _statistics(field: T.StructField, approximate: bool) -> dict[str, Column]:
    c = F.col(f"`{field.name}`")
    out = {"non_null": F.count(c)}
    if is_numeric(field.dataType):
        x = c.cast("double")
        out |= {"min": F.min(x), "max": F.max(x), "mean": F.avg(x), "stddev": F.stddev_samp(x)}
        if not approximate and _may_be_nan(field):
            out["numbers"] = F.count(_number(field))
        if approximate:
            out["quantiles"] = F.percentile_approx(x, list(QUANTILES.values()), 100_000)
    if isinstance(field.dataType, T.StringType):
        n = F.length(c)
        out |= {"min_len": F.min(n), "max_len": F.max(n), "avg_len": F.avg(n), "empties": F.count_if(c == "")}
    return out


def distinct_counts(df: DataFrame, fields: list[T.StructField], hashed: bool = False) -> DataFrame:
    """(position, distinct) by column; hashed counts from sketches instead (about 2 % off).

    Each exact count reads its own column alone and merges equal values before they are shuffled.
    """
    if hashed:
        wide = df.agg(*[F.approx_count_distinct(F.col(f"`{f.name}`"), 0.02).alias(f"d{i}") for i, f in enumerate(fields)])
        return wide.select(F.posexplode(F.array(*[F.col(f"d{i}") for i in range(len(fields))])).alias("position", "distinct"))
    each = [df.select(F.col(f"`{f.name}`").alias("v")).distinct().agg(F.count("v").alias("distinct")).select(F.lit(i).alias("position"), "distinct") for i, f in enumerate(fields)]
    return reduce(DataFrame.unionByName, each)


#: Values of a bracket that are sorted one by one, and values of a sample that draws brackets.
FEW = 100_000
SAMPLED = 100_000
#: Columns that one scan takes together, with all their intervals: the code for more would be too long for the JVM to compile.
TOGETHER = 4


@dataclass
class _Sought:
    """Two neighbouring order statistics of a column, as far as they are known, and the open interval that holds what is not."""

    name: str
    label: str
    ranks: tuple[int, int]
    part: float
    low: float = float("-inf")
    high: float = float("inf")
    inside: int = 0
    below: int = 0
    found: dict[int, float] = field(default_factory=dict)
    ends: tuple[float, float] | None = None

    @property
    def open(self) -> bool:
        return any(r not in self.found for r in self.ranks)

    def settle(self, below: int, at_low: int, inside: int, at_high: int) -> None:
        """Take the counts of what lies below, at and between the proposed ends: ranks in a tie at an end are known."""
        low, high = self.ends
        steps = (below, below + at_low, below + at_low + inside, below + at_low + inside + at_high)
        for r in self.ranks:
            if r in self.found:
                continue
            if steps[0] <= r < steps[1]:
                self.found[r] = low
            elif steps[2] <= r < steps[3]:
                self.found[r] = high
        left = [r for r in self.ranks if r not in self.found]
        if not left:
            return
        total = self.below + self.inside
        if left[0] < steps[0]:  # the sample was off: what is sought lies before the ends, or behind them
            self.high, self.inside = low, steps[0] - self.below
        elif left[0] >= steps[3]:
            self.low, self.below, self.inside = high, steps[3], total - steps[3]
        else:
            self.low, self.high, self.below, self.inside = low, high, steps[1], inside


def _may_be_nan(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DoubleType, T.FloatType))


def _number(field: T.StructField) -> Column:
    """The column as a double, null for NaN."""
    x = F.col(f"`{field.name}`").cast("double")
    return F.when(~F.isnan(x), x) if _may_be_nan(field) else x


def _step(x: Column, marks: list[float]) -> Column:
    """Twice the place of the first mark from x on, and one more where x is that mark; null beyond the last."""
    steps = F.when(x < marks[0], 0).when(x == marks[0], 1)
    for k, e in enumerate(marks[1:], 1):
        steps = steps.when(x < e, 2 * k).when(x == e, 2 * k + 1)
    return steps


def _together(names: list[str], items: list, name: Callable) -> list[list]:
    """The items (of columns that `name` tells) by runs of TOGETHER columns."""
    runs: dict[int, list] = {}
    run = {n: i // TOGETHER for i, n in enumerate(names)}
    for item in items:
        runs.setdefault(run[name(item)], []).append(item)
    return list(runs.values())


def _quantiles(df: DataFrame, names: list[str], shares: dict[str, float] = QUANTILES, accuracy: int = SKETCH, few: int | None = None, sampled: int | None = None, told: list[int] | None = None) -> DataFrame:
    """(name, k, value): exact interpolated quantiles of numeric columns by selection in narrowing passes; nulls and NaN take no part.

    A sketch of a sample proposes ends on both sides of each quantile, and a pass counts what lies below, at and between them.
    The interval that holds the rank, ties at its ends left out, is narrowed again in the same way until it has `few` values;
    then these alone are sorted. A pass samples, counts or sorts the intervals of up to TOGETHER columns in one scan; none
    shuffles rows but the last, and a proposal that missed only costs a pass. Memory is bounded whatever the table's size. `told`
    has the numbers of values, in the order of names, where they are known.
    """
    spark = df.sparkSession
    few, sampled = FEW if few is None else few, SAMPLED if sampled is None else sampled
    x = {n: _number(df.schema[n]) for n in names}
    column = {n: F.col(f"x{i}") for i, n in enumerate(names)}
    if told is None:
        told = list(df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(x.values())]).first())
    numbers = lambda some: df.select(*[x[n].alias(f"x{names.index(n)}") for n in dict.fromkeys(some)])
    sought = []
    for i, name in enumerate(names):
        for label, p in shares.items():
            if n := told[i]:
                place = p * (n - 1)
                sought.append(_Sought(name, label, (int(place), int(place) + (place > int(place))), place - int(place), inside=n))
    within = lambda b: (column[b.name] > b.low) & (column[b.name] < b.high) if b.low > float("-inf") or b.high < float("inf") else column[b.name].isNotNull()
    while wide := [b for b in sought if b.open and b.inside > few]:
        by_interval: dict[tuple, list[_Sought]] = {}
        for b in wide:
            by_interval.setdefault((b.name, b.low, b.high, b.inside), []).append(b)
        groups = list(by_interval.values())
        drawn = []
        for part in _together(names, groups, lambda g: g[0].name):
            share = [sampled / g[0].inside if g[0].inside > 2 * sampled else 1.0 for g in part]
            sketches = []
            for g, drawn_share in zip(part, share):
                slack = 2.5 / min(g[0].inside, sampled) ** 0.5 + 2 / accuracy
                aims = [min(1.0, max(0.0, (r - b.below) / b.inside + d)) for b in g for left in [[r for r in b.ranks if r not in b.found]] for r, d in ((left[0], -slack), (left[-1], slack))]
                sketches.append(F.percentile_approx(F.when(within(g[0]) & (F.col("_drawn") < drawn_share), column[g[0].name]), aims, accuracy))
            rows = numbers(g[0].name for g in part).withColumn("_drawn", F.rand(11)).where(F.col("_drawn") < max(share))
            drawn.append(rows.agg(F.array(*sketches).alias("ends")).select(F.lit(len(drawn)).alias("i"), "ends"))
        ends = [e for r in sorted(reduce(DataFrame.unionAll, drawn).collect()) for e in r.ends]  # two for each quantile
        for g, proposed in zip(groups, ends):
            for k, b in enumerate(g):  # a sample without rows proposes nothing new: the whole interval is sorted then
                b.ends = tuple(proposed[2 * k : 2 * k + 2]) if proposed else None
        marks = {n: sorted(m) for n in names if (m := {e for b in wide if b.name == n and b.ends for e in b.ends})}
        counts = []
        for part in _together(names, list(marks), lambda n: n):
            pairs = [c for n in part for c in (F.lit(names.index(n)), _step(column[n], marks[n]))]
            steps = numbers(part).select(F.stack(F.lit(len(part)), *pairs).alias("i", "step")).where("step is not null")
            counts.append(steps.groupBy("i", "step").agg(F.count(F.lit(1)).alias("n")))
        held = {(r.i, r.step): r.n for r in (reduce(DataFrame.unionAll, counts).collect() if counts else [])}  # two for each mark
        at = {}
        for n, m in marks.items():
            upto = list(accumulate(held.get((names.index(n), k), 0) for k in range(2 * len(m))))
            at |= {(n, e): (upto[2 * k], upto[2 * k + 1]) for k, e in enumerate(m)}
        for b in wide:
            if b.ends:
                (low, upto_low), (high, upto_high) = at[b.name, b.ends[0]], at[b.name, b.ends[1]]
                b.settle(low, upto_low - low, max(0, high - upto_low), upto_high - high if b.ends[1] > b.ends[0] else 0)
        if not counts:
            break
    done = [(b.name, b.label, b.found[b.ranks[0]] + (b.found[b.ranks[1]] - b.found[b.ranks[0]]) * b.part) for b in sought if not b.open]
    out = spark.createDataFrame(done, "name string, k string, value double")
    left = [b for b in sought if b.open]
    if not left:
        return out
    place = {}  # quantiles of one interval share its values
    for b in left:
        place.setdefault((b.name, b.low, b.high), (len(place), b))
    terms = spark.createDataFrame([(place[b.name, b.low, b.high][0], b.name, b.label, b.part, *[r - b.below if r not in b.found else None for r in b.ranks], *[b.found.get(r) for r in b.ranks]) for b in left], "j int, name string, k string, part double, lower long, upper long, first double, second double")
    lanes: list[list[tuple[int, _Sought]]] = []  # intervals of a column that share no value
    for j, b in sorted(place.values(), key=lambda p: p[1].low):
        lane = next((lane for lane in lanes if lane[0][1].name == b.name and lane[-1][1].high <= b.low), None)
        if lane is None:
            lanes.append(lane := [])
        lane.append((j, b))
    parts = []
    for part in _together(names, lanes, lambda lane: lane[0][1].name):
        pairs = [c for lane in part for c in (F.coalesce(*[F.when(within(b), j) for j, b in lane]), column[lane[0][1].name])]
        parts.append(numbers(lane[0][1].name for lane in part).select(F.stack(F.lit(len(part)), *pairs).alias("j", "x")).where("j is not null"))
    counts = reduce(DataFrame.unionAll, parts).groupBy("j", "x").agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("j").orderBy("x")))  # an interval of few values
    at = lambda rank, known: F.coalesce(F.max(known), F.min(F.when(F.col("upto") > F.col(rank), F.col("x"))))
    found = running.join(F.broadcast(terms), "j").groupBy("name", "k", "part").agg(at("lower", "first").alias("a"), at("upper", "second").alias("b"))
    return out.unionByName(found.select("name", "k", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value")))


def columns(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    """One row per column: counts, distinct share, numeric and string statistics, and a quality score.

    approximate takes sketches for quantiles and distinct counts, for tables where exact ones would cost too much. Quantiles
    leave out NaN. Columns that cannot be compared (maps) have no distinct count. An empty table gives zeros.
    """
    fields = [f for f in df.schema.fields]
    countable = [f for f in fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    numbers = [f.name for f in fields if is_numeric(f.dataType)]
    wide = df.agg(F.count(F.lit(1)).alias("total"), *[e.alias(f"c{i}_{k}") for i, f in enumerate(fields) for k, e in _statistics(f, approximate).items()])
    if numbers and not approximate:  # the quantiles start from its counts, so its one row is found once for both
        row = wide.first()
        wide = df.sparkSession.createDataFrame([row], wide.schema)
    rows = []
    for i, f in enumerate(fields):
        have = _statistics(f, approximate)
        get = lambda k, t, i=i, have=have: (F.col(f"c{i}_{k}") if k in have else F.lit(None)).cast(t).alias(k)
        quantile = [(F.get(F.col(f"c{i}_quantiles"), F.lit(j)) if "quantiles" in have else F.lit(None)).cast("double").alias(k) for j, k in enumerate(QUANTILES)]
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(i).alias("position"), get("non_null", "long"),
            *[get(k, "double") for k in ("min", "max", "mean", "stddev")], *quantile,
            get("min_len", "long"), get("max_len", "long"), get("avg_len", "double"), get("empties", "long"),
        ))
    out = wide.select("total", F.explode(F.array(*rows)).alias("r")).select(F.lit(name).alias("table"), "total", "r.*")
    order = ["table", "total", "column", "dtype", "position", "non_null", "distinct", *out.columns[6:]]
    # from here on every table has a row per column
    places = F.create_map(*[F.lit(x) for i, f in enumerate(countable) for x in (i, fields.index(f))]) if countable else None
    if countable:
        distinct = distinct_counts(df, countable, approximate).select(places[F.col("position")].alias("position"), F.col("distinct").cast("long").alias("distinct"))
        out = out.join(F.broadcast(distinct), "position", "left")
    else:
        out = out.withColumn("distinct", F.lit(None).cast("long"))
    if numbers and not approximate:
        told = [row[f"c{i}_{'numbers' if _may_be_nan(f) else 'non_null'}"] for i, f in enumerate(fields) if is_numeric(f.dataType)]
        exact = _quantiles(df, numbers, told=told).groupBy(F.col("name").alias("column")).pivot("k", list(QUANTILES)).agg(F.first("value"))
        out = out.drop(*QUANTILES).join(F.broadcast(exact), "column", "left")
    out = out.select(*order)
    out = out.withColumn("nulls", F.col("total") - F.col("non_null"))
    out = out.withColumn("null_pct", percent(F.col("nulls"), F.col("total"))).withColumn("distinct_pct", percent(F.col("distinct"), F.col("non_null")))
    out = out.withColumn("is_unique", (F.col("distinct") == F.col("non_null")) & (F.col("non_null") > 0))
    return out.withColumn("quality", quality())


def quality() -> Column:
    """0 to 100: nulls, constants, near-unique small columns and empty strings cost; a full key gains."""
    nulls = F.when(F.col("null_pct") > 50, 30).when(F.col("null_pct") > 20, 15).when(F.col("null_pct") > 5, 5).otherwise(0)
    constant = F.when((F.col("distinct") == 1) & (F.col("total") > 10), 20).otherwise(0)
    scattered = F.when((F.col("distinct_pct") > 99) & (F.col("total") < 100), 5).otherwise(0)
    empty = F.when(F.coalesce(F.col("empties"), F.lit(0)) > F.col("total") * 0.1, 10).otherwise(0)
    score = F.lit(100.0) - nulls - constant - scattered - empty
    score = F.when(F.col("is_unique") & (F.col("null_pct") == 0), F.least(F.lit(100.0), score + 5)).otherwise(score)
    return F.greatest(F.lit(0.0), score)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent non-null values with their share of all rows; ties go to the smaller value."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "value").limit(k)
    return best.join(total, F.lit(True)).select("value", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def histogram(df: DataFrame, column: str, buckets: int = 20) -> DataFrame:
    """Equal-width buckets over [min, max + 1): count, least and greatest value; empty buckets are left out.

    A column with one distinct value, or none, has no histogram.
    """
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("low"), F.max(x).alias("high")).where("low < high")
    rows = df.select(x.alias("x")).where("x is not null").join(F.broadcast(ends), F.lit(True))  # ends is one row
    width = (F.col("high") + 1 - F.col("low")) / F.lit(buckets)  # as written in SQL: width_bucket rounds otherwise where a value is on an edge
    bucket = F.when(width < float("inf"), F.floor((F.col("x") - F.col("low")) / width) + 1)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


#: Values below the bound of a bottom-k sample for each value that is wanted.
_SPARE = 8


def sample_values(df: DataFrame, column: str, k: int = 100) -> DataFrame:
    """k distinct non-null values in pseudo-random but repeatable order: those with the least MD5 of their text (ties: the lesser text).

    A bottom-k sketch: an approximate count of distinct values bounds the share of the hash range that holds the k least with
    room to spare, and only rows below the bound are made distinct and sorted. Each bound is checked by counting, and
    raised where it was too low, so the result is exact.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).withColumn("_md5", F.md5("value"))
    distinct = values.agg(F.approx_count_distinct("value")).first()[0]
    share = min(1.0, _SPARE * (k + 10) / max(1, distinct))
    while share < 1.0:
        bound = f"{int(share * 16**12):012x}"
        if values.where(F.col("_md5") < bound).select("value").distinct().limit(k).count() == k:
            values = values.where(F.col("_md5") < bound)
            break
        share *= 16
    return values.distinct().orderBy("_md5", "value").limit(k).select("value")


def patterns(df: DataFrame, column: str, table: dict[str, str] = PROFILE) -> DataFrame:
    """Share of non-null values that match each pattern, over all rows in one scan; patterns without a match are left out."""
    c = F.col(column).cast("string")
    wide = df.where(c.isNotNull()).agg(F.count(F.lit(1)).alias("values"), *[F.count_if(c.rlike(r)).alias(k) for k, r in table.items()])
    out = wide.select("values", F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(k).alias("n")) for k in table])).alias("p")).select("p.*", "values").where("n > 0")
    share = F.col("n") * 100.0 / F.col("values")
    level = F.when(share > 95, "HIGH").when(share > 80, "MEDIUM").otherwise("LOW")
    return out.select("pattern", "n", percent(F.col("n"), F.col("values")).alias("pct"), level.alias("confidence"))


def table_scores(profile: DataFrame, best_patterns: DataFrame | None = None) -> DataFrame:
    """completeness, uniqueness, consistency and overall score of each table from its column rows.

    best_patterns (table, column, pct) holds the best pattern share of columns that match any; others count as consistent.
    """
    p = profile if best_patterns is None else profile.join(best_patterns.select("table", "column", F.col("pct").alias("_best")), ["table", "column"], "left")
    best = F.lit(100.0) if best_patterns is None else F.coalesce("_best", F.lit(100.0))
    out = p.groupBy("table").agg(F.avg(100 - F.col("null_pct")).alias("completeness"), F.avg("distinct_pct").alias("uniqueness"), F.avg(best).alias("consistency"))
    return out.withColumn("overall", (F.col("completeness") + F.col("uniqueness") + F.col("consistency")) / 3)


def primary_key_guess(profile: DataFrame) -> DataFrame:
    """The first unique column without nulls of each table."""
    ok = profile.where("is_unique and null_pct = 0")
    return ok.groupBy("table").agg(F.min_by("column", "position").alias("primary_key"))


def best_patterns(df: DataFrame, name: str, table: dict[str, str] = PROFILE) -> DataFrame:
    """(table, column, pattern, pct): of each text column that matches any pattern, the one with the greatest share, in one scan."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], "table string, column string, pattern string, pct double")
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(texts)], *[F.count_if(F.col(f"`{c}`").rlike(r)).alias(f"n{i}_{k}") for i, c in enumerate(texts) for k, r in table.items()])
    each = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("pattern"), F.lit(-j).alias("order"), F.col(f"n{i}_{k}").alias("n"), F.col(f"v{i}").alias("values")) for i, c in enumerate(texts) for j, k in enumerate(table)]
    found = wide.select(F.explode(F.array(*each)).alias("p")).select("p.*").where("n > 0")
    best = found.groupBy("column").agg(F.max(F.struct("n", "order", "pattern", "values")).alias("b"))
    return best.select(F.lit(name).alias("table"), "column", "b.pattern", percent(F.col("b.n"), F.col("b.values")).alias("pct"))


def foreign_key_guesses(profile: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Columns named like a reference (`*_id`) that are not unique (medium), and columns of UUIDs that are not unique (low).

    patterns are best_patterns(); a column holds UUIDs where over 95 % of its values do.
    """
    name = F.lower("column")
    out = profile.where(name.endswith("_id") & ~F.col("is_unique") & (F.length(name) > 3)).select("table", "column", F.expr("left(lower(column), length(column) - 3)").alias("potential_reference"), F.lit("medium").alias("confidence"))
    if patterns is None:
        return out
    uuids = profile.where(~F.col("is_unique")).join(F.broadcast(patterns.where("pattern = 'uuid' and pct > 95").select("table", "column")), ["table", "column"])  # a row per column
    return out.unionByName(uuids.select("table", "column", F.lit("unknown").alias("potential_reference"), F.lit("low").alias("confidence")))


def light(df: DataFrame, name: str) -> DataFrame:
    """Counts, distinct values and null share, with min, max and mean as text where they apply."""
    return columns(df, name).select("table", "column", "dtype", "total", "non_null", "distinct", "null_pct", *[F.col(k).cast("string").alias(k) for k in ("min", "max", "mean")])


def summary(profile: DataFrame) -> DataFrame:
    """One row: tables, columns, mean quality and the numbers of columns of high, medium and low quality."""
    return profile.agg(
        F.count_distinct("table").alias("tables"), F.count(F.lit(1)).alias("columns"), F.avg("quality").alias("avg_quality"),
        F.count_if(F.col("quality") >= 80).alias("high"), F.count_if((F.col("quality") >= 50) & (F.col("quality") < 80)).alias("medium"), F.count_if(F.col("quality") < 50).alias("low"),
    )


def issues(profile: DataFrame, scores: DataFrame, threshold: float = 70) -> DataFrame:
    """Tables below the threshold, tables without a key, columns mostly null, columns below the threshold."""
    keyed = profile.where("is_unique and null_pct = 0").select("table").distinct()
    none = F.lit(None).cast("string")
    return (
        scores.where(F.col("overall") < threshold).select("table", none.alias("column"), F.lit("low_table_quality").alias("issue"))
        .unionByName(profile.select("table").distinct().join(keyed, "table", "left_anti").select("table", none.alias("column"), F.lit("no_primary_key").alias("issue")))
        .unionByName(profile.where("null_pct > 50").select("table", "column", F.lit("high_nulls").alias("issue")))
        .unionByName(profile.where(F.col("quality") < threshold).select("table", "column", F.lit("low_column_quality").alias("issue")))
    )


def strict_patterns(df: DataFrame, column: str, rules, least_pct: float = 50.0) -> DataFrame:
    """Ranked pattern shares over trimmed, non-blank values: HIGH from 95 %, MEDIUM from the pattern's own threshold, else LOW."""
    c = F.trim(F.col(column).cast("string"))
    wide = df.where(c.isNotNull() & (c != "")).agg(F.count(F.lit(1)).alias("values"), *[F.count_if(c.rlike(p.regex)).alias(p.name) for p in rules])
    row = [F.struct(F.lit(p.name).alias("pattern"), F.col(p.name).alias("n"), F.lit(p.threshold * 100).alias("threshold"), F.lit(p.priority).alias("priority")) for p in rules]
    out = wide.select("values", F.explode(F.array(*row)).alias("p")).select("p.*", "values").where("n > 0").withColumn("share", F.col("n") * 100.0 / F.col("values"))
    level = F.when(F.col("share") >= 95, "HIGH").when(F.col("share") >= F.col("threshold"), "MEDIUM").otherwise("LOW")
    ranked = out.where(F.col("share") >= least_pct).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("share"), "priority")))  # a row per pattern
    return ranked.select("pattern", "n", percent(F.col("n"), F.col("values")).alias("pct"), level.alias("confidence"), "rank")


def exact_quantiles(df: DataFrame, column: str, shares: list[float], accuracy: int = SKETCH, few: int | None = None, sampled: int | None = None) -> list[float | None]:
    """The exact interpolated quantiles of one numeric column, in bounded memory; None where it has no value."""
    found = {r.k: r.value for r in _quantiles(df, [column], {str(p): p for p in shares}, accuracy, few, sampled).collect()}  # a row per quantile
    return [found.get(str(p)) for p in shares]
