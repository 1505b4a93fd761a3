"""Near-duplicates against all pairs, on the driver's documents and on crowded groups."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tablewright.llm import graph, neardup, queries, shingles


def sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(ids, texts, k, percent):
    s, parent = sets(texts, k), {i: i for i in ids if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            n = len(s[a] & s[b])
            if n and ids[a] is not None and ids[b] is not None and 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
                lo, hi = sorted((root(ids[a]), root(ids[b])))
                parent[hi] = lo
    return [(i, len(x), None if i is None else root(i)) for i, x in zip(ids, s)]


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query_equals_all_pairs(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    want = brute(t["doc_id"].to_pylist(), t["text"].to_pylist(), 3, 85)
    got = queries.op8_minhash_near_duplicates(spark, sf)
    assert result(got) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


@pytest.mark.parametrize("crowd", [1, 32])
def test_chains_and_crowds(spark, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    ids, texts = [], []
    for i in range(60):  # each text is a little further from the first: links form chains
        w = list(base)
        for at in range(0, i):
            w[(at * 2) % 120] = f"x{at}"
        ids.append(i)
        texts.append(" ".join(w))
    ids += [100, 101, 102, 103, None, None, 104, 104]
    texts += ["", None, "one two", "ONE two", texts[0], "a b c d", "p q r s", "p q r s"]
    df = spark.createDataFrame(list(zip(ids, texts, ids)), "doc_id long, text string, component_id long")
    assert result(neardup.link(df)) == sorted(brute(ids, texts, 3, 85), key=str)


def test_representatives_keep_columns(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(3, text, "a"), (2, text + " x", "b"), (9, "other words here now then", "c"), (None, text, "d")], "doc_id long, text string, kept string")
    got = neardup.representatives(df, neardup.Scheme(5, 80))
    assert got.columns == df.columns and sorted(r.kept for r in got.collect()) == ["b", "c", "d"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 75), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(21)} | {50: 50, 75: 50, 100: 50}


def test_words_split_like_the_pattern():
    text = "Ab  ä\x0b\x1cx\tZ q\n"
    assert len(shingles.words(text)) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
    assert np.array_equal(shingles.words("ABC d"), shingles.words("abc D")) and not np.array_equal(shingles.words("Ä"), shingles.words("ä"))


def test_structured_words_are_told_apart(spark):
    """A Thue-Morse string and its complement, whose polynomial hashes modulo a power of two agree."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    df = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.link(df).collect()) == [(1, 1), (2, 2)]
    assert neardup.representatives(df).count() == 2


def test_one_id_on_several_texts(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (0, "k l m n o p q r s t"), (2, "a b c d e f g h i j"), (3, ""), (3, ""), (4, "x y z x y z"), (4, "x y z x y z"), (None, "x y z x y z")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, group int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1, r.kept) for r in neardup.link(df).collect())
    assert got == sorted([(1, 1, True), (1, 0, False), (0, 0, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 4, True), (4, 4, True), (-1, -1, True)])
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in neardup.representatives(df).collect())
    assert kept == sorted([(1, rows[0][1]), (0, rows[1][1]), (3, ""), (3, ""), (4, rows[6][1]), (-1, rows[6][1])])
    assert neardup.representatives(df).columns == df.columns


def test_measured_recall(spark, sf):
    """Links of all documents of a small table against all pairs."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: set(neardup.shingle_set(r.text, 3).tolist()) for r in rows}
    ids = sorted(i for i in sets if sets[i])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.link(df).collect()} == {i: find(i) for i in sets}
