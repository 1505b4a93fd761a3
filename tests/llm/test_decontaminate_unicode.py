"""Tokens of any script, and items shorter than a seed."""

import unicodedata

import pytest

from tablewright.llm import decontaminate
from tablewright.llm.shingles import tokens

ITEM = "él niño señaló qué árbol más próximo crecía allí también según José Núñez"
HAN = "春天的花園裡有很多美麗的蝴蝶"


def test_tokens_ignore_case_punctuation_and_composition():
    same = lambda a, b: tokens(a).tolist() == tokens(b).tolist()
    assert same(ITEM, ITEM.upper()) and same("straße", "STRASSE") and same("Ωμέγας", "ΩΜΈΓΑΣ")
    assert same("“qué”—dijo… ¿no?", "qué dijo no")
    assert same(unicodedata.normalize("NFD", ITEM), ITEM) and same("हिन्दी भाषा", "हिन्दी, भाषा।")
    assert len(tokens("हिन्दी भाषा")) == 2 and len(tokens(HAN)) == len(HAN) and len(tokens("ab春c")) == 3
    assert len(tokens("")) == len(tokens("—…")) == 0


@pytest.mark.parametrize("held", [10**6, 0])
def test_finds_other_scripts_and_short_items(spark, held):
    items = [(1, ITEM), (2, HAN), (3, "rare pair"), (4, "…")]
    docs = [(1, "antes. " + ITEM.upper() + " después"), (2, "他說" + HAN + "。再見"), (3, "a “RARE” pair"), (4, "rare a pair"), (5, "—"), (6, "pair"), (7, None), (8, "«" + ITEM.replace(" ", "»—«") + "»")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find(d, b, held_tokens=held).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (8, 1)]
    assert sorted(r.doc_id for r in decontaminate.clean(d, b, held_tokens=held).collect()) == [4, 5, 6, 7]
