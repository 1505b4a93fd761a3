"""Every query with oracle SQL gives the same rows, columns and values as DuckDB on the same files."""

import duckdb
import pytest

from tablewright import queries as registry

NAMES = list(registry.ORACLES)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in registry.TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if isinstance(v, float):
            return f"{v:.12g}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(text, v)) + "]"
        return str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)
