"""Line dedup against comparing every pair of lines, and the oracle SQL."""

import random

import duckdb
import pytest

from tablewright.llm import lines, queries


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def brute(docs):
    every = [(doc is None, doc, k, at, tuple(line.split())) for k, (doc, text) in enumerate(docs) for at, line in enumerate((text or "").split("\n"))]
    every.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    gone = set()
    for i, (_, _, k, at, words) in enumerate(every):
        for _, _, _, _, other in every[:i]:
            if words and (words == other or len(words) > 7 and len(other) > 7 and distance_at_most_one(words, other)):
                gone.add((k, at))
    return ["\n".join(line for at, line in enumerate(text.split("\n")) if (k, at) not in gone) if text is not None else None for k, (_, text) in enumerate(docs)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    base = [[r.choice(words) for _ in range(n)] for n in (3, 7, 8, 9, 20, 41, 70)]

    def line():
        w = list(r.choice(base))
        for _ in range(r.choice((0, 1, 1, 2))):
            at, op = r.randrange(len(w) + 1), r.randrange(3)
            w[at : at + (op > 0)] = [] if op == 2 else [r.choice(words)]
        return ("  " if r.random() < 0.2 else " ").join(w)

    docs = [(i, "\n".join(line() for _ in range(r.randint(1, 5)))) for i in range(24)] + [(None, line()), (50, None), (51, ""), (52, "\n \n")]
    df = spark.createDataFrame([(i, t, "clash", k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, near string, row int")
    got = {r.row: r.text for r in lines.dedup(df).collect()}
    want = brute(docs)
    assert [got[k] for k in range(len(docs))] == want


def test_copies_stay_once_and_columns_stay(spark):
    df = spark.createDataFrame([(2, "a b\nc", 7), (1, "a b", 8), (1, "a b", 8)], "doc_id long, text string, n_lines int")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup(df).collect())
    assert got == [(1, "a b", 1, 0), (1, "a b", 1, 0), (2, "c", 2, 1)]
    assert lines.dedup(df.where("false")).count() == 0


def test_oracle(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(c.sql(queries.LINE_DEDUP_SQL).select("doc_id, n_lines, n_removed, n_near, text").fetchall())
    assert sorted(map(tuple, queries.op1_line_dedup(spark, sf).select("doc_id", "n_lines", "n_removed", "n_near", "text").collect())) == want


def test_one_line_in_most_documents(spark, monkeypatch):
    """A line and a near copy of it in nearly all documents: only the earliest stays, and heavy keys are dealt out."""
    from tablewright.llm import common

    monkeypatch.setattr(common, "CROWDED", 5)
    common_line, near = " ".join(f"w{i}" for i in range(45)), " ".join("v" if i == 20 else f"w{i}" for i in range(45))
    docs = [(i, f"{common_line if i % 2 else near}\nown line number {i} of this text, which has some more words {i}") for i in range(60)] + [(None, common_line), (61, None), (62, ""), (61, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, s int")
    got = {r.s: r.text for r in lines.dedup(df, words_per_edit=20).collect()}
    assert got[0] == docs[0][1] and all(got[k].startswith("own line") or got[k] == "" for k in range(1, 60)) and got[60] == "" and got[61] is None and got[62] == ""
    assert lines.dedup(df.where("false"), words_per_edit=20).count() == 0
