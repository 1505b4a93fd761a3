"""Periodic runs against all pairs of equal words, and the query against a plain reading of its contract."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import periodic, queries


def brute(x):
    """(start, length, period) by trying every period at every place."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_served_scales_hold_every_period():
    for q in range(1, 5000):
        b = periodic._scale(q)
        assert q in periodic._served(b) and 2 * b - 1 <= max(q, 12 - q)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 30), st.integers(2, 6), st.lists(st.integers(0, 3), max_size=20))
def test_runs(head, period, times, tail):
    cycle = (head * 30 or [0] * 30)[:period]
    x = head + cycle * times + tail
    assert periodic.runs(np.array(x, np.int64)) == brute(x)


def test_long_words_of_few_kinds():
    rng = np.random.default_rng(3)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    for x in (fib[-1], rng.integers(0, 2, 1200).tolist(), [0] * 700 + [1] + [0] * 700, rng.integers(0, 50, 400).tolist() * 4):
        assert periodic.runs(np.array(x, np.int64)) == brute(x)
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def contract(doc_id, text):
    """The row of op11 for one document."""
    w = [x for x in (text or "").encode().split()]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = brute(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), best[0], best[1], best[2], best[1] * 1000 // best[2] if found else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_query(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    want = {contract(r["doc_id"], r["text"]) for r in docs}
    got = queries.op11_periodic_runs(spark, sf)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(docs) and set(rows) == want


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a " * 12), (4, "a " * 12), (None, "b c " * 9), (None, None), (7, "x y " * 13), (8, "é😀\n" * 40 + "end"), (9, "a " * 5 + "b " * 11),
    *[(100 + i, f"w{i} x y " * 7) for i in range(40)],
]


def test_awkward_rows(spark):
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in AWKWARD], "doc_id long, text string, runs string, n int")
    got = sorted(map(tuple, periodic.digest(periodic.find(periodic.planted(df))).collect()), key=str)
    assert got == sorted((contract(i, t) for i, t in AWKWARD), key=str)
    whole = {r.doc_id: r for r in periodic.find(df).where("doc_id in (4, 8)").collect()}
    assert whole[4].collapsed == "a" and whole[8].collapsed == "é😀 end" and whole[8].n_words == 41
    assert periodic.digest(periodic.find(periodic.planted(df.where("false")))).count() == 0
