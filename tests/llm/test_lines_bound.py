"""Line dedup with a bound that grows with the line, against comparing every pair of lines."""

import random

import pytest

from tablewright.llm import lines, stages


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, per):
    every = [(doc, at, tuple(line.split())) for doc, text in docs for at, line in enumerate(text.split("\n"))]
    gone = set()
    for i, (doc, at, x) in enumerate(every):
        for _, _, y in every[:i]:
            least = min(len(x), len(y))
            bound = max(1, least // per) if least > 7 else 0
            if x == y or abs(len(x) - len(y)) <= bound and distance(x, y) <= bound:
                gone.add((doc, at))
                break
    return {doc: "\n".join(line for at, line in enumerate(text.split("\n")) if (doc, at) not in gone) for doc, text in docs}


def edited(r, words, vocabulary, edits):
    w = list(words)
    for _ in range(edits):
        at, op = r.randrange(len(w)), r.randrange(3)
        w[at : at + (op > 0)] = [] if op == 2 else [r.choice(vocabulary)]
    return w


@pytest.mark.parametrize("seed, size, per", [(0, 400, 20), (1, 6, 20), (2, 30, 10)])
def test_equals_all_pairs(spark, seed, size, per):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(size)]
    base = [[r.choice(vocabulary) for _ in range(n)] for n in (20, 39, 40, 41, 59, 60, 79, 111, 160)]
    line = lambda: " ".join(edited(r, r.choice(base), vocabulary, r.choice((0, 1, 2, 3, 4, 5, 6, 8, 9))))
    docs = [(i, "\n".join(line() for _ in range(3))) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert dict(map(tuple, lines.dedup(df, words_per_edit=per).select("doc_id", "text").collect())) == brute(docs, per)


@pytest.mark.parametrize("size, refined, places, seed", [(60, 2, 6, 0), (60, 4, 20, 1), (3, 2, 12, 2), (45, 16, 60, 3)])
def test_one_template_in_common_keys(spark, monkeypatch, size, refined, places, seed):
    """Many copies of one template with two spellings at some places, so that nearly every key is common; also few words in all."""
    monkeypatch.setattr(lines, "REFINED", refined)
    r = random.Random(seed)
    base = [f"w{r.randrange(size)}" for _ in range(60)]
    docs = []
    for i in range(70):
        w = list(base)
        for at in r.sample(range(min(places, 60)), 5):
            w[at] = r.choice((f"a{at}", f"b{at}"))
        docs.append((i, " ".join(edited(r, w, base, r.choice((0, 0, 1))))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert dict(map(tuple, lines.dedup(df, words_per_edit=20).select("doc_id", "text").collect())) == brute(docs, 20)


def test_pipeline_stage_takes_long_near_copies(spark, sf):
    """Two lines of 111 words that differ in 3; and 3 of 30, which stay."""
    words = [f"w{i}" for i in range(111)]
    other = [w if i not in (5, 50, 100) else "x" for i, w in enumerate(words)]
    short = ["y" if i in (5, 15, 25) else w for i, w in enumerate(words[:30])]
    docs = [(1, " ".join(words), 0), (2, " ".join(other), 0), (3, " ".join(words[:30]), 0), (4, " ".join(short), 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    got = {r.doc_id: bool(r.text) for r in stages.dedup_lines(spark, df, sf).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}
