"""Line dedup on a large template whose lines are just further apart than the bound."""

import random

from tablewright.llm import lines

from .test_lines_bound import brute


def test_lines_just_above_the_bound_are_not_all_compared(spark, monkeypatch):
    """Each line has three words of its own in one template, so two are six words apart; the bound is three. One more line is within."""
    r = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    docs = []
    for i in range(100):
        w = list(base)
        for at in r.sample(range(60), 3):
            w[at] = f"x{i}y{at}"
        docs.append((i, " ".join(w)))
    docs.append((100, docs[70][1].replace("t1 ", "z ")))
    compared, settled = [], lines._settled

    def counting(pairs, *more):
        compared.append(pairs.count())
        return settled(pairs, *more)

    monkeypatch.setattr(lines, "_settled", counting)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dict(map(tuple, lines.dedup(df, words_per_edit=20).select("doc_id", "text").collect()))
    assert got == brute(docs, 20) and got[100] == "" and all(got[i] for i in range(100))
    assert sum(compared) < 8 * len(docs)
