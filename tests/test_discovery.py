"""Dependency and key search against plain enumeration, whatever the sample refutes."""

import random
from itertools import combinations

import pytest

from tablewright.operators import dependencies, lattice


def brute_dependencies(rows, names, most=3, least=0.95):
    found = []
    for size in range(1, min(most, len(names) - 1) + 1):
        level = []
        for xs in combinations(range(len(names)), size):
            for y in range(len(names)):
                if y in xs or any(set(x) < set(xs) and d == y for x, d, _ in found):
                    continue
                groups = {}
                for r in rows:
                    if r[y] is not None:
                        groups.setdefault(tuple(r[x] for x in xs), set()).add(r[y])
                bad = sum(len(g) > 1 for g in groups.values())
                if groups and (c := int((1 - bad / len(groups)) * 10000 + 0.5) / 10000) >= least:
                    level.append((xs, y, c))
        found += level
    return {(tuple(names[x] for x in xs), names[y], c) for xs, y, c in found}


def brute_keys(rows, names, most=4):
    found = []
    for size in range(1, most + 1):
        for xs in combinations(range(len(names)), size):
            if not any(set(f) <= set(xs) for f in found):
                values = [tuple(r[x] for x in xs) for r in rows]
                if values and None not in {v for t in values for v in t} and len(set(values)) == len(values):
                    found.append(xs)
    return {tuple(names[x] for x in xs) for xs in found}


@pytest.mark.parametrize("sample", [0, 40, 10_000])
def test_random_tables(spark, sample):
    """No sample, a small one and the whole table give the same result, exact and approximate dependencies alike."""
    rng = random.Random(4)
    names = ["a", "b", "c", "d", "e"]
    for nulls, least in ((0.0, 0.95), (0.03, 0.8)):
        rows = []
        for i in range(300):
            a, b = rng.randrange(150), rng.randrange(6)
            row = [a, f"t{b}", (a * 7 + b) % 90 if rng.random() > 0.02 else -1, float(b % 3) or -0.0, rng.randrange(200)]
            rows.append(tuple(None if rng.random() < nulls else v for v in row))
        df = spark.createDataFrame(rows, "a long, b string, c int, d double, e long").repartition(3)
        work, keys = dependencies.Work(), dependencies.Work()
        got = {(d.determinant, d.dependent, d.confidence) for d in dependencies.discover(df, min_confidence=least, sample=sample, work=work)}
        assert got == brute_dependencies(rows, names, least=least)
        assert {k.columns for k in dependencies.find_keys(df, sample=sample, work=keys)} == brute_keys(rows, names)
        assert work.refuted + work.counted == work.candidates and work.jobs <= 6
        assert keys.refuted + keys.counted == keys.candidates and keys.jobs <= 7
        if sample == 10_000:
            assert keys.counted == len(brute_keys(rows, names))  # the whole table refutes all others
            assert work.refuted > 0


def test_keys_need_few_counts(spark):
    """Of 561 column sets of 11 columns, only what might be a key is counted."""
    df = spark.range(5000).selectExpr("id", *[f"id % {m} as c{m}" for m in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)])
    work = dependencies.Work()
    found = dependencies.find_keys(df, work=work)
    assert ("id",) == found[0].columns and ("c11", "c19", "c29") in {k.columns for k in found}
    assert work.counted == len(found) < work.candidates and work.jobs <= 6


def test_awkward_tables(spark):
    df = spark.createDataFrame([(1, None, [1]), (1, None, [1])], "a int, `b.c` string, d array<int>")
    assert dependencies.find_keys(df) == [] and [k.columns for k in dependencies.find_keys(df.limit(1))] == [("a",), ("d",)]
    assert {(d.determinant, d.dependent) for d in dependencies.discover(df)} == {(("a",), "d"), (("b.c",), "a"), (("b.c",), "d"), (("d",), "a")}
    assert dependencies.discover(df.where("false")) == [] and dependencies.find_keys(df.where("false")) == [] and dependencies.discover(df.select("a")) == []
    assert [k.columns for k in dependencies.find_single_keys(df.limit(1))] == [("a",), ("d",)]
    half = [(k.columns, k.uniqueness, k.null_pct) for k in dependencies.find_keys(df.union(df.limit(1).selectExpr("2", "'x'", "d")), max_size=2, min_uniqueness=0.6, max_null_pct=70.0)]
    assert half == [(("a",), 2 / 3, 0.0), (("b.c",), 1.0, 200 / 3)]
    assert dependencies.verify(df, ["a"], "d").count() == 1 and dependencies.verify(df, ["a"], "b.c").count() == 0
    assert lattice.SAMPLE >= 10_000
