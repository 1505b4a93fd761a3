"""Suffix-array dedup against marking every window by brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import queries, substrings


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, tail = text(25), text(30)
    docs = [text(40) + shared + text(10), shared[7:] + text(20), text(5) + shared[:-9], tail, tail, tail[3:], "ab" * 150, "a" * 90, "", None, "short", shared + shared]
    docs += [text(3) + shared[i : i + 60] + text(6) for i in range(0, 60, 3)]
    near = list(tail)
    near[len(near) // 2] = "Z"
    return docs + ["".join(near)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("crowd", [0, 2, 1000])
def test_equals_brute_force(spark, seed, crowd):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, rid string, spans string")
    got = sorted(map(tuple, substrings.dedup(df, length=40, gram=16, crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == [(i, *x) for i, x in enumerate(brute(texts, 40))]


def test_repeated_rows_and_missing_ids(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[5:]), (2, "x" * 10)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_removed) for r in substrings.dedup(df, length=40, gram=16).collect())
    assert got == [(0, 55), (1, 60), (1, 60), (2, 0)]
    assert substrings.dedup(df.where("false"), length=40, gram=16).count() == 0


def test_suffix_sort_orders_like_bytes():
    r = random.Random(2)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(400)), np.uint8)
    starts = np.array(sorted(r.sample(range(360), 80)))
    segment = np.repeat([1, 2, 3], [30, 1, 49])
    order = substrings.sort_suffixes(data, substrings.Hashes(data, substrings.BASE), starts, segment, 40)
    for k in (1, 2, 3):
        own = [bytes(data[s : s + 40]) for s in starts[order][segment == k]]
        assert own == sorted(own)


def test_production_lengths_and_passages(spark, sf):
    """The registered query against brute force over all 400-byte and 50-word windows of a small table."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r.text for r in rows]
    got = {r.doc_id: r for r in queries.op2_suffix_array_dedup(spark, sf).collect()}
    for row, want in zip(rows, brute(texts, 400)):
        r = got[row.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
    words = [t.encode().split() for t in texts]
    count = Counter(tuple(w[i : i + 50]) for w in words for i in range(len(w) - 49))
    for row, w in zip(rows, words):
        said = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if count[tuple(w[i : i + 50])] > 1:
                said[i : i + 50] = True
        r = got[row.doc_id]
        assert (r.n_passages, r.passage_words) == (int((np.diff(said.astype(int), prepend=0) == 1).sum()), int(said.sum()))


def test_anchors_do_not_depend_on_neighbours():
    r = random.Random(4)
    texts = [np.frombuffer(bytes(r.choice(b"abc") for _ in range(r.choice((0, 5, 39, 40, 41, 100, 300)))), np.uint8) for _ in range(40)]
    alone = [found for i, t in enumerate(texts) for found in [substrings.anchors([t], 40, 16)]]
    for i, found in enumerate(alone):
        found[:, 0] = i
    assert (np.concatenate(alone) == substrings.anchors(texts, 40, 16)).all()
