"""Texts move once to their anchors and once to their spans, whatever is sought in them."""

from pyspark.sql import functions as F

from tablewright.llm import substrings


def _texts():
    words = [" ".join(f"w{(i * 7919 + k * 104729) % 5003}" for k in range(90)) for i in range(6)]
    both = f"{words[0]} {words[1]}"
    return [(1, both), (2, f"x {words[1]} {words[2]}"), (2, both), (None, words[3]), (None, words[3]), (4, words[4]), (5, None), (6, ""), (7, "short"), (8, f"{words[5]}\n{words[0]}")]


def test_texts_move_twice(spark, monkeypatch):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string").repartition(3)
    moved, plain = [], substrings.stored

    def stored(df, name):
        moved.append((name, _moves_text(df)))
        return plain(df, name)

    monkeypatch.setattr(substrings, "stored", stored)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = substrings.dedup(docs, length=40, gram=20, passage=12, passage_gram=6)
        assert sum(n for _, n in moved) == 1, moved
        assert _moves_text(result) == 1 and _exchanges(result) == 3  # texts, spans, and the repartition above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def _exchanges(df):
    return sum("Exchange hashpartitioning(" in n or "Exchange RoundRobin" in n for n in _nodes(df))


def _moves_text(df):
    """Joins by row keys that bring rows of a text to another place."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.initialPlan())
            continue
        out = [p.output().apply(i).name() for i in range(p.output().size())] if name == "ShuffleExchangeExec" else []
        found += "text" in out and "hashpartitioning(k1" in p.outputPartitioning().toString()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_both_searches_find_what_each_finds_alone(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string").repartition(3)
    got = substrings.dedup(docs, length=40, gram=20, passage=12, passage_gram=6)
    alone = substrings.dedup(docs, length=40, gram=20)
    words = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"), "text")
    passages = substrings.repeated_spans(words, 12, 6, units=substrings.WORDS).collect()
    key = lambda r: tuple(str(v) for v in r)
    plain = [c for c in alone.columns if c not in ("n_passages", "passage_words")]
    assert sorted(map(key, got.select(plain).collect())) == sorted(map(key, alone.select(plain).collect()))
    assert {r.n_passages for r in alone.select("n_passages").collect()} == {None}
    told = sorted(r.passage_words for r in got.collect() if r.passage_words)
    held = {(r.k1, r.k2): sum(b - a for a, b in substrings._merged(r.spans)) for r in passages}
    assert told == sorted(held[r.k1, r.k2] for r in words.collect() if (r.k1, r.k2) in held) and len(told) == 6
    assert got.count() == len(_texts()) and [r.n_passages for r in got.where("doc_id in (5, 6, 7)").collect()] == [0, 0, 0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(docs, passage=50).count() == 0
