"""Encoder, packing and token rollups."""

import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tablewright.llm import packing, queries, rollup
from tablewright.llm.tokens import Encoder


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_library(library):
    fast, r = Encoder(queries.vocabulary()), random.Random(3)
    assert fast._fast is not None
    letters = "ab'sreé ñ\n\t .,!?;-_09àß«»—…ªº²½中ا  \x0b😀"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30))) + r.choice(("", "", "<|endoftext|> x"))
        assert fast.ids(text) == ids(library, text)


def test_packing_query(spark, sf, library):
    t = pq.read_table(f"{sf}/documents.parquet")
    rows = queries.op4_best_fit_packing(spark, sf).toPandas()
    total = 0
    for doc, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()):
        data = ids(library, text or "") + b"\0\0\0\0"
        own, at = rows[rows.doc_id == doc].sort_values("piece"), 0
        assert list(own.piece) == list(range(len(own)))
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(data[4 * at : 4 * (at + r.length)]) and (r.piece == 0 or r.length == 2048)
            at += r.length
        assert 4 * at == len(data)
        total += at
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= math.ceil(total / 2048) + 8


def test_packing_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 9000, 3)], "doc_id long, text string, piece int")
    got = packing.best_fit(df, queries.vocabulary(), group=3).toPandas()
    assert len(got[got.doc_id.isna()]) == 1 and len(got[got.doc_id == 1]) == 2 and got[got.doc_id == 2].length.sum() >= 9001
    assert packing.best_fit(df.where("false"), queries.vocabulary()).count() == 0


def test_sum_of_squares_rule():
    r, capacity = random.Random(0), 20
    fast, gaps = packing.SumOfSquares(capacity), []
    for _ in range(300):
        n = r.randint(1, capacity)
        before = sorted(gaps)
        counts = lambda g: sum(g.count(x) ** 2 for x in set(g) if x)
        options = []
        for g in {x for x in before if x >= n and x}:
            rest = list(before)
            rest.remove(g)
            options.append(counts([*rest, g - n]))
        bins = fast.bins
        _, offset = fast.add(n)
        if fast.bins == bins:
            gaps.remove(capacity - offset)
        gaps.append(capacity - offset - n)
        assert counts(gaps) == min(options) if options else fast.bins == bins + 1


def test_rollup_is_idempotent_and_signed(spark, tmp_path):
    totals = rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert totals.totals().count() == 0
    docs = spark.createDataFrame([(1, "s", "en", "a b c"), (1, "s", "en", "d"), (1, None, "de", None)], "sign int, source string, lang string, text string")
    assert totals.commit("b1", rollup.counted(docs, {})) and not totals.commit("b1", rollup.counted(docs, {}))
    log = spark.createDataFrame([("revise", "s", "en", "x y", "s", "en", "d"), ("delete", None, None, None, None, "de", None), ("noop", "s", "en", "z", None, None, None)], "op string, source string, lang string, text string, old_source string, old_lang string, old_text string")
    assert totals.commit("b2/odd name", rollup.counted(rollup.signed(log), {}))
    want = [("s", "en", "words_v1", 2, 5)]
    assert list(map(tuple, totals.totals().collect())) == want
    totals.compact()
    assert list(map(tuple, totals.totals().collect())) == want and not totals.commit("b1", rollup.counted(docs, {}))


def test_commits_are_whole_and_compaction_counts_once(spark, tmp_path):
    path = str(tmp_path / "r")
    totals = rollup.TokenRollup(spark, path)
    docs = spark.createDataFrame([(1, "s", "en", "a b c")], "sign int, source string, lang string, text string")
    long_name = "batch " + "x" * 300
    assert totals.commit(long_name, rollup.counted(docs, {})) and totals.committed(long_name)
    # a writer that stopped before its rename leaves nothing that counts
    rollup.counted(docs, {}).write.parquet(f"{path}/written/half")
    want = [("s", "en", "words_v1", 1, 3)]
    assert list(map(tuple, totals.totals().collect())) == want
    # a second writer of the batch, and a second compaction of the same state, come too late
    docs.write.parquet(f"{path}/written/late")
    assert not totals._publish(f"{path}/written/late", f"batches/{rollup._key(long_name)}")
    assert totals.compact() and not totals.compact()
    docs.write.parquet(f"{path}/written/late")
    assert not totals._publish(f"{path}/written/late", "generations/1")
    assert list(map(tuple, totals.totals().collect())) == want and totals._names("batches") == []
    # a replay after compaction, even one that gets as far as its rename, changes nothing
    assert not totals.commit(long_name, rollup.counted(docs, {}))
    rollup.counted(docs, {}).groupBy(*rollup.KEYS).agg({"sign": "sum"}).selectExpr("source", "lang", "tokenizer_version", "1L as docs", "3L as tokens", f"'{rollup._key(long_name)}' as batch").write.parquet(f"{path}/batches/{rollup._key(long_name)}")
    assert list(map(tuple, totals.totals().collect())) == want
    assert totals.commit("b2", rollup.counted(docs, {})) and totals.compact()
    assert list(map(tuple, totals.totals().collect())) == [("s", "en", "words_v1", 2, 6)] and totals.committed(long_name) and totals._names("generations") == ["2"]


def test_token_counts_query(spark, sf, library):
    t = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    want = {}
    for d in t:
        if len(d["text"]) < 200:
            continue
        text = d["text"].partition("\n")[2] if len(d["text"]) > 5000 else d["text"]
        for version, n in (("byte_bpe_50k", len(ids(library, text)) // 4), ("words_v1", len(text.split()))):
            k = (d["source"], d["lang"], version)
            want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + n)
    assert {(r.source, r.lang, r.tokenizer_version): (r.docs, r.tokens) for r in queries.op5_token_counts(spark, sf).collect()} == want


def test_words_rollup_oracle(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = "source, lang, tokenizer_version, docs, tokens"
    want = sorted(c.sql(queries.ROLLUP_SQL).select(columns).fetchall())
    assert sorted(map(tuple, queries.token_rollup_words(spark, sf).select(*columns.split(", ")).collect())) == want


def test_rows_without_id_meet_in_no_one_group(spark):
    """A mass of id-less rows, some of them equal, is dealt over all groups and every piece is placed once."""
    cut = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "0 as piece", "cast(0 as bigint) as start", "cast(100 as bigint) as length", "cast(if(id < 2000, 7, id) as bigint) as ids_crc32")
    got = packing.pack(cut, 3000, group=500).toPandas()
    assert len(got) == 3000 and (got["sequence_id"] // 2**40).value_counts().max() < 1500
    for _, rows in got.groupby("sequence_id"):
        assert sorted(rows["offset"]) == [100 * i for i in range(len(rows))]
