"""Each stage on its own input against plain Python, and the stages on awkward rows."""

from collections import Counter

import pytest

import corpus_pipeline
from tablewright.llm import neardup
from tests.llm.test_lines_bound import distance
from tests.llm.test_neardup import brute as brute_groups


@pytest.fixture(scope="module")
def results(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()))


def test_names_and_columns(results):
    assert [n for n, _, _ in results] == ["quality classifier", "line dedup", "minhash near-dedup", "benchmark decontamination", "best-fit packing"]
    assert all(after.columns == before.columns for _, before, after in results[:4])


def test_quality_keeps_rows_as_they_are(results, spark, sf):
    _, before, after = results[0]
    assert set(rows(after)) < set(rows(before))
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    kept = after.join(good, "doc_id", "left_semi").count()
    assert kept >= 0.95 * before.join(good, "doc_id", "left_semi").count()


def brute_lines(docs, per=20):
    """All pairs of lines under the stage's bound; pairs whose words differ too much are not measured."""
    every = [(doc, at, tuple(line.split())) for doc, text in docs for at, line in enumerate(text.split("\n"))]
    counts = [Counter(words) for _, _, words in every]
    gone, seen = set(), set()
    for i, (doc, at, x) in enumerate(every):
        if x in seen:
            gone.add((doc, at))
            continue
        seen.update([x] if x else [])
        for j in range(i):
            y = every[j][2]
            least = min(len(x), len(y))
            bound = max(1, least // per) if least > 7 else 0
            if bound and abs(len(x) - len(y)) <= bound and (counts[i] - counts[j]).total() <= bound and distance(x, y) <= bound:
                gone.add((doc, at))
                break
    return ["\n".join(line for at, line in enumerate(text.split("\n")) if (doc, at) not in gone) for doc, text in docs]


def test_lines_equal_all_pairs(results):
    _, before, after = results[1]
    docs = rows(before)
    assert [t for _, t in rows(after)] == brute_lines(docs)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_groups_equal_all_pairs(results):
    _, before, after = results[2]
    docs = rows(before)
    want = {c if c is not None else i for i, _, c in brute_groups([i for i, _ in docs], [t for _, t in docs], 5, 80)}
    assert {i for i, _ in rows(after)} == want and neardup.Scheme(5, 80).half >= 8


def test_benchmark_goes(results, spark, sf):
    _, before, after = results[3]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = lambda t: any(i in " ".join(t.lower().split()) for i in items)
    gone = set(rows(before)) - set(rows(after))
    assert {r for r in rows(before) if holds(r[1])} <= gone and set(rows(after)) < set(rows(before))


def test_everything_is_packed(results):
    _, before, after = results[4]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_awkward_rows(spark, sf):
    data = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "y"), (1, "a b c\n\n" * 3, "en", None, 3, "z"), (1, "a b c\n\n" * 3, "en", None, 3, "z"), (2, "word " * 50_000, None, "s", None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _k string"
    for docs in (spark.createDataFrame(data, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= max(docs.count() + 30, 0) and (set(out.columns) == set(docs.columns) or "sequence_id" in out.columns)
