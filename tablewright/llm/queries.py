"""Queries of the operators, with production parameters over whole tables, and their oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, lines, neardup, packing, periodic, pii, prefixtree, quality, rollup, sharding, substrings, topk
from .common import read, scratch


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), words_per_edit=lines.WORDS_PER_EDIT)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents"), passage=substrings.PASSAGE).drop("kept")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read(spark, sf_dir, "documents"), vocabulary())


def _changed(spark: SparkSession, sf_dir: str, vocabularies: dict[str, str]) -> DataFrame:
    """Totals after every document came, documents of over 5,000 characters lost their first line and those of under 200 went.

    The first batch is compacted, and each batch runs twice.
    """
    docs = read(spark, sf_dir, "documents").select("source", "lang", "text")
    old = [F.col(c).alias(f"old_{c}") for c in docs.columns]
    revised = docs.where(F.length("text") > 5000).select(F.lit("revise").alias("op"), "source", "lang", F.regexp_replace("text", r"\A[^\n]*\n?", "").alias("text"), *old)
    deleted = docs.where(F.length("text") < 200).select(F.lit("delete").alias("op"), *[F.lit(None).cast("string").alias(c) for c in docs.columns], *old)
    batches = {
        "insert": docs.select(F.lit(1).alias("sign"), "*"),
        "revise and delete": rollup.signed(revised.unionByName(deleted)),
    }
    totals = rollup.TokenRollup(spark, scratch(spark, "rollup"))
    for name, rows in batches.items():
        for _ in range(2):
            totals.commit(name, rollup.counted(rows, vocabularies))
        totals.compact()
    return totals.totals()


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, {"byte_bpe_50k": vocabulary()})


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op5_token_counts, without the tokenizer that SQL cannot express."""
    return _changed(spark, sf_dir, {})


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents"), pii.train(spark)))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(read(spark, sf_dir, "documents"), neardup.Scheme(shingle=3, percent=85))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), F.col("_accepted").cast("int").alias("predicted"))


def op10_proportional_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.interleave(read(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(periodic.planted(read(spark, sf_dir, "documents"))))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find(read(spark, sf_dir, "documents")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtree.digest(*prefixtree.tree(prefixtree.rebuilt(read(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"token_rollup_words": token_rollup_words}


#: Words of a line; for lines that may differ in one word, each variant with its gap written out and the earliest line that has
#: it; for longer ones, pairs that share one of their bound + 1 rarest words and the edit distance row by row.
LINE_DEDUP_SQL = """
with recursive l as (
    select doc_id, pos, line, list_filter(string_split(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda w: w <> '') as w
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as pos from documents)
), u as (
    select w, min(struct_pack(d := doc_id, a := pos)) as earliest from l where len(w) > 0 group by w
), v as (
    select w, earliest, unnest(range(0, len(w) + 1)) as i from u where len(w) >= 8
), k as (
    select w, earliest, i || '#' || array_to_string(w[1:i], ' ') || '#' || array_to_string(w[i+1:], ' ') as key from v
    union all
    select w, earliest, i || '#' || array_to_string(w[1:i], ' ') || '#' || array_to_string(w[i+2:], ' ') from v where i < len(w)
), g as (
    select w, earliest, len(w) as n, row_number() over (order by earliest) as id from u where len(w) >= 40
), t as (
    select id, n, word, unnest(range(0, c)) as occ from (select id, n, word, count(*) as c from (select id, n, unnest(w) as word from g) group by all)
), r as (
    select id, n, word, occ from t join (select word, occ, count(*) as c from t group by all) using (word, occ)
    qualify row_number() over (partition by id order by c, word, occ) <= n // 20 + 1
), p as (
    select distinct a.id as x, b.id as y, a.n as n, b.n as m, least(a.n, b.n) // 20 as bound
    from r a join r b using (word, occ) where a.id < b.id and abs(a.n - b.n) <= least(a.n, b.n) // 20
), q as (
    select p.x, p.y, p.n, p.m, bound from p join t a on a.id = p.x join t b on b.id = p.y and a.word = b.word and a.occ = b.occ
    group by p.x, p.y, p.n, p.m, bound having count(*) >= greatest(p.n, p.m) - bound
), dp as (
    select x, y, n, m, bound, 0 as i, range(0, m + 1) as row from q
    union all
    select x, y, dp.n, m, bound, i + 1, list_transform(range(0, m + 1), lambda j: j + list_min(list_transform(range(0, j + 1),
        lambda h: least(row[h + 1] + 1, case when h = 0 then 1000000 else row[h] + cast(b.w[h] <> a.w[i + 1] as bigint) end) - h)))
    from dp join g a on a.id = x join g b on b.id = y where i < dp.n
), near as (
    select w from k join (select key, min(earliest) as f from k group by key) using (key) where f < earliest
    union
    select w from dp join g on g.id = y where i = dp.n and row[m + 1] <= bound
), marked as (
    select l.doc_id, l.pos, l.line, coalesce(near.w is not null, false) as near, coalesce(near.w is not null or struct_pack(d := l.doc_id, a := l.pos) > u.earliest, false) as gone
    from l left join u on l.w = u.w left join near on l.w = near.w
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, count(*) filter (where near) as n_near,
    coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text
from marked group by doc_id
"""

#: Integer scores of every query against every other row; the five highest.
TOP_K_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""


#: Words of what is left of each document.
ROLLUP_SQL = """
with kept as (
    select source, lang, case when length(text) > 5000 then regexp_replace(text, '^[^\\n]*\\n?', '') else coalesce(text, '') end as text
    from documents where text is null or length(text) >= 200
)
select source, lang, 'words_v1' as tokenizer_version, count(*) as docs,
    cast(sum(len(list_filter(string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> ''))) as bigint) as tokens
from kept group by source, lang
"""


def oracle_sql() -> dict[str, str]:
    return {"token_rollup_words": ROLLUP_SQL, "op1_line_dedup": LINE_DEDUP_SQL, "op7_exact_top_k": TOP_K_SQL}
