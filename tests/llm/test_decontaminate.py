"""Greedy string tiling: reordered passages, limits, and both ways of finding candidates."""

import random

import pytest

from tablewright.llm import decontaminate
from tablewright.llm.shingles import tokens


def words(r, n):
    return [f"t{r.randrange(10**6)}" for _ in range(n)]


def case(seed=1):
    r = random.Random(seed)
    items = [words(r, 40) for _ in range(5)]
    noise = lambda n=30: words(r, n)
    docs = {
        1: noise() + items[0] + noise(), 2: noise() + items[1][20:] + noise() + items[1][:20], 3: noise() + items[2][:31] + noise(), 4: noise() + items[2][:32] + noise(),
        5: noise(100), 6: items[3][:4] + ["x"] + items[3][5:9], 7: [w.upper() + "!!" for w in items[4]], 8: [],
    }
    docs[9] = noise() + items[0] + noise() + items[4]
    return [(i, " ".join(w)) for i, w in enumerate(items)] + [(9, "too short"), (10, None)], [(k, " ".join(w)) for k, w in docs.items()] + [(11, None)]


@pytest.mark.parametrize("held", [10**6, 0])
def test_finds_contained_items(spark, held):
    items, docs = case()
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.covered, r.tiles) for r in decontaminate.find(d, b, held_tokens=held).collect())
    assert got == [(1, 0, 40, 1), (2, 1, 40, 2), (4, 2, 32, 1), (7, 4, 40, 1), (9, 0, 40, 1), (9, 4, 40, 1)]
    kept = decontaminate.clean(d, b, held_tokens=held)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 8, 11]
    assert decontaminate.find(d.where("false"), b, held_tokens=held).count() == 0
    assert decontaminate.find(d, b.where("false"), held_tokens=held).count() == 0


def greedy(item, doc, least):
    """The definition: the longest match of free tokens (first in item, then doc) again and again."""
    a, b, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return tiles
        n, i, j = best
        a[i : i + n] = b[j : j + n] = [True] * n
        tiles.append(best)


@pytest.mark.parametrize("seed", range(20))
def test_tiles_follow_the_definition(seed):
    r = random.Random(seed)
    item = [r.choice("abc") for _ in range(24)]
    doc = [r.choice("abc") for _ in range(60)]
    got = decontaminate.tile(tokens(" ".join(item)), tokens(" ".join(doc)), 3)
    assert sorted(t[0] for t in got) == sorted(t[0] for t in greedy(item, doc, 3))
    assert all(item[i : i + n] == doc[j : j + n] for n, i, j in got)


@pytest.mark.parametrize("held", [10**6, 0])
def test_long_repeats_and_clashing_columns(spark, held):
    """An item of one word over and over against a document of it, and columns named like the operator's own."""
    item = "x " + "a " * 2000 + "y"
    docs = [(1, "a " * 20_000, True, 1, 1), (2, "b " * 20_000, False, 2, 2), (2, "b " * 20_000, False, 2, 2), (None, "a " * 2001, True, 3, 3), (4, None, None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, _dirty boolean, _t1 long, key long")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.covered, r.tiles) for r in decontaminate.find(d, b, held_tokens=held).collect()) == [(0, 7, 2000, 1), (1, 7, 2000, 1)]
    kept = decontaminate.clean(d, b, held_tokens=held)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 4]
