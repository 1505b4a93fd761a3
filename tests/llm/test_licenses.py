"""License scans against a plain reading of the contract, and notices planted whole, changed and cut."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablewright.llm import licenses, queries

#: The phrases and the word pattern as the contract writes them (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    """(n_words, n_base, first_word, last_word, base_labels)"""
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def held(got, want):
    for r in got:
        text = want[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels) and r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    out = queries.op12_license_scan(spark, sf)
    assert [t for _, t in out.dtypes] == ["bigint"] * 5 + ["string", "string", "double"]
    rows = out.collect()
    assert len(rows) == len(docs)
    held(rows, docs)
    gpl = {i for i, t in docs.items() if "GNU General Public License, version 3" in (t or "")}
    assert gpl == {r.doc_id for r in rows if "gpl-3" in r.labels.split(",")} and all("lgpl" not in r.labels for r in rows)


AWKWARD = [
    "under the MIT license.Under the mit\x7flicense UNDER-the-mit-license", None, "", "...", "cc by nc cc by nc by nc", "under the mit license apache license version 2 0", "under the mitlicense", "cc by", "é under ÜNDER the mit license é😀 cc BY nc😀",
    "under the mit license " * 3000, "licensed " * 5000, "apache license version 20", "x" * 100_000 + " cc by nc",
]


def test_awkward_rows(spark):
    rows = list(enumerate(AWKWARD))
    df = spark.createDataFrame([(i, t, "c", 1, "w") for i, t in rows], "doc_id long, text string, label string, first int, words string")
    got = licenses.digest(licenses.find(df)).collect()
    assert len(got) == len(rows)
    held(got, dict(rows))
    masses = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "cc by nc").alias("text"))
    assert sorted((r.n_base, r["count"]) for r in licenses.digest(licenses.find(masses)).groupBy("n_base").count().collect()) == [(0, 20_000), (1, 10_000)]
    assert licenses.find(df.where("false")).count() == 0
    with pytest.raises(Exception, match="too few words"):
        licenses.find(df, [("cc by", "x")]).count()


def test_phrases_that_overlap(spark):
    df = spark.createDataFrame([(1, "a b a b a b a")], "doc_id long, text string")
    (row,) = licenses.find(df, [], [("a b a", "aba")]).collect()
    assert [(p.first, p.last) for p in row.found] == [(0, 2), (2, 4), (4, 6)]


def test_planted_notices(spark):
    """Each notice whole, with 6 % of its words changed, with words put in, and cut in half; among words of none."""
    rng = random.Random(11)
    noise = lambda n: [f"z{rng.randrange(10**6)}" for _ in range(n)]
    rows, want, texts = [], {}, {}
    for notice, label in licenses.NOTICES:
        w = WORD.findall(notice.lower())
        ways = {"whole": w}
        if len(w) > 20:
            numbers = [i for i, x in enumerate(w) if x.isdigit()]
            spare = [i for i in range(2, len(w) - 2) if all(abs(i - k) > 2 for k in numbers)]
            changed = set(rng.sample(spare, max(1, len(w) * 4 // 100)))
            ways["changed"] = ["zz" if i in changed else x for i, x in enumerate(w)]
            put = set(rng.sample(spare, 2))
            ways["put in"] = [y for i, x in enumerate(w) for y in ([x, "zz"] if i in put else [x])]
            ways["half"] = w[: len(w) // 2]
        for way, words in ways.items():
            rows.append((len(rows), " ".join(noise(50) + words + noise(50))))
            texts[rows[-1][0]] = " ".join(words)
            want[rows[-1][0]] = (way, label, 50, 50 + len(words) - 1)
    found = {r.doc_id: r for r in licenses.find(spark.createDataFrame(rows, "doc_id long, text string"), phrases=[]).collect()}
    for i, (way, label, first, last) in want.items():
        got = {p.label for p in found[i].found}
        if way == "half":  # only what it holds whole
            cut = f" {texts[i]} "
            assert got == {x for n, x in licenses.NOTICES if f" {' '.join(WORD.findall(n.lower()))} " in cut}
        else:
            assert got == {label}, (way, label, got)
        if way == "whole":
            (place,) = found[i].found
            assert (place.first, place.last, place.share) == (first, last, 1.0)


def test_versions_are_told_apart(spark):
    texts = ["licensed under the GNU General Public License version 2", "licensed under the GNU General Public License version 4", "licensed under the GNU Lesser General Public License, version 3", "licensed under the ISC license", "the rights to use and of the software"]
    got = {r.doc_id: r.labels for r in licenses.digest(licenses.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert got == {0: "gpl-2", 1: "gpl", 2: "lgpl-3", 3: "", 4: ""}
