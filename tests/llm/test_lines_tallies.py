"""Line dedup: lines whose words alone tell them apart are never compared, and odd white space."""

import random

from pyspark.sql import functions as F

from tablewright.llm import lines


def test_unlike_lines_of_common_chunks_are_not_compared(spark, monkeypatch):
    """Lines of few words repeated, which share their long chunks: no text is moved for a pair that counts of words rule out."""
    r = random.Random(5)
    head = "xxxxxxxxxxxxxxxxn yyyyyyyyyyyyyyyyyn zzzzzzzzzzzzzzzzzzn"
    docs = [(i, head + " " + " ".join(r.choice((f"a{i}", f"b{i}", f"c{i}")) for _ in range(60))) for i in range(6)]
    compared, settled = [], lines._settled

    def counted(pairs, found, per, name):
        compared.append(pairs.count())
        return settled(pairs, found, per, name)

    monkeypatch.setattr(lines, "_settled", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, lines.dedup(df, words_per_edit=20).select("doc_id", "text").collect())) == docs
    assert compared and sum(compared) == 0


def test_tallies_bound_the_distance(spark):
    """One count above the other's is the excess, over all groups; lines of too many words stay open."""
    r = random.Random(6)
    rows = [tuple(" ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 400))) for _ in range(2)) for _ in range(40)]
    df = spark.createDataFrame(rows, "x string, y string").select(*[lines._tallies(F.col(c), F.size(F.split(c, " "))).alias(c) for c in "xy"])
    counts = lambda pair: [v >> k & 0xFFFFF for v in pair for k in (0, 20, 40)]
    got = df.select("x", "y", lines._excess([F.get("x", F.lit(k)) for k in (0, 1)], [F.get("y", F.lit(k)) for k in (0, 1)]).alias("e")).collect()
    assert [x.e for x in got] == [sum(max(a - b, 0) for a, b in zip(counts(x.x), counts(x.y))) for x in got]
    assert [sum(counts(x.x)) for x in got] == [len(a.split()) for a, _ in rows]
    assert spark.range(1).select(lines._tallies(F.lit("a"), F.lit(1 << 15)).alias("t")).first().t is None


def test_odd_white_space(spark):
    text = "a\tb\n\t\u000b\n \f\r\na b\n  a   b \na\rb\n\n"
    df = spark.createDataFrame([(1, text), (2, "a b\nc\td"), (3, "c d\n\t")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup(df, words_per_edit=20).collect())
    assert got == [(1, "a\tb\n\t\u000b\n \f\r\n\n", 8, 3), (2, "c\td", 2, 1), (3, "\t", 2, 1)]
