"""Exact top-k search by inner product with a pivot table.

Vectors become integers floor(256 x). The table holds for every vector its distances to many pivots, once, in the form in which
they bound most: as the apex over the simplex of the pivots, that is its coordinates in an orthonormal basis of the pivots (they
follow from the distances, and the distances from them) and the length of what is left. Two vectors are at least as far from
each other as their apexes, which is the largest lower bound that all pivot distances together allow; so the inner product is at
most that of the coordinates plus the product of the two rests.

A query first meets a bounded sample of the rows. Its k-th best score there is carried to every block of candidates: those whose
bound does not reach it are out, the others are evaluated in the order of their bounds until no bound reaches the k-th best score
so far. Ties of the bound are evaluated too, so the result is exact.

The query set goes against all rows in blocks: query blocks are copied to every group of candidate blocks (an equi-join on the
group), so neither side has to fit anywhere as a whole, and no candidate is copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

SCALE = 256
PIVOTS = 48
SAMPLE = 2048
BLOCK = 8192
QUERY_BLOCK = 512
GROUP_ROWS = 65536
BLOCK_SCHEMA = "dim int, part int, ids binary, data binary, apex binary"


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, every component present and finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _integers(vectors: pd.Series) -> np.ndarray:
    return np.floor(SCALE * np.stack([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1))


def _blocks(groups: int, rows: int, bases: dict[int, np.ndarray]):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        number = 0

        def block(dim: int) -> pd.DataFrame:
            ids = np.concatenate([i for i, _ in waiting[dim]])
            data = np.concatenate([d for _, d in waiting[dim]])
            waiting[dim] = []
            # the group follows from the content, so that a repeated task deals its blocks alike
            part = int((ids[0] * 2654435761 + number) % groups)
            return pd.DataFrame({"dim": [dim], "part": [part], "ids": [ids.tobytes()], "data": [data.tobytes()], "apex": [apexes(data, bases.get(dim)).tobytes()]})

        for batch in batches:
            for dim, own in batch.groupby(batch["v"].map(len), sort=True):
                for at in range(0, len(own), rows):
                    piece = own.iloc[at : at + rows]
                    waiting.setdefault(dim, []).append((piece["vec_id"].to_numpy(np.int64), _integers(piece["v"])))
                    if sum(len(i) for i, _ in waiting[dim]) >= rows:
                        yield block(dim)
                        number += 1
        for dim, left in waiting.items():
            if left:
                yield block(dim)
                number += 1

    return pack


def _farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def basis(sample: np.ndarray, pivots: int) -> np.ndarray:
    """An orthonormal basis (dim x at most pivots) of pivots that are far from each other."""
    chosen = _farthest_first(sample, min(pivots, sample.shape[1]))
    q, r = np.linalg.qr(chosen.T)
    return q[:, np.abs(np.diag(r)) > 1e-9 * (1 + np.abs(r).max(initial=0))]


def apexes(x: np.ndarray, base: np.ndarray | None) -> np.ndarray:
    """For each row its coordinates over the pivots and the length of the rest."""
    if base is None:
        base = np.empty((x.shape[1], 0))
    own = x @ base
    rest = np.sqrt(np.maximum((x * x).sum(1) - (own * own).sum(1), 0))
    return np.column_stack([own, rest])


def _exact(c: np.ndarray, q: np.ndarray, limit: float) -> np.ndarray:
    """Integer inner products; limit bounds their size."""
    if limit < 2**24:
        return (c.astype(np.float32, copy=False) @ q.astype(np.float32)).astype(np.int64)
    if limit < 2**53:
        return (c.astype(np.float64) @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in c.astype(np.float64)]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in whole], np.int64)


def search_block(q_ids, q, q_apex, least, c_ids, c, c_apex, k: int) -> tuple[list[np.ndarray], int]:
    """For each query its k best (query_id, vec_id, score) in the block, of scores at least `least`; and how many were evaluated."""
    size = 1 + float(np.sqrt((q * q).sum(1).max(initial=0) * (c * c).sum(1).max(initial=0)))
    limit = float(np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * c.shape[1] + 1
    values = c.astype(np.float32) if limit < 2**24 else c
    bounds = q_apex @ c_apex.T + 1e-6 * size
    out, evaluated = [], 0
    for i in range(len(q)):
        high = bounds[i]
        left = np.flatnonzero((high >= least[i]) & (c_ids != q_ids[i]))
        left = left[np.argsort(-high[left], kind="stable")]
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        take = 16
        while len(left):
            now, left = left[:take], left[take:]
            evaluated += len(now)
            ids, score = np.concatenate([best_ids, c_ids[now]]), np.concatenate([best, _exact(values[now], q[i], limit)])
            order = np.lexsort((ids, -score))[:k]
            best_ids, best = ids[order], score[order]
            if len(best) == k:
                left = left[: np.searchsorted(-high[left], -best[-1], "right")]
            take *= 4
        good = best >= least[i]
        out.append(np.column_stack([np.full(good.sum(), q_ids[i]), best_ids[good], best[good]]))
    return out, evaluated


def _rows(data: bytes, ids: np.ndarray) -> np.ndarray:
    x = np.frombuffer(data, np.float64)
    return x.reshape(len(ids), len(x) // len(ids))


def _seen(q_ids: np.ndarray, q: np.ndarray, s_ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k-th best reaches: that among the sample's rows."""
    if len(s) <= k:
        return np.full(len(q), -np.inf)
    score = q @ s.T
    score[q_ids[:, None] == s_ids[None, :]] = -np.inf
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    return np.clip(least - 1e-6 * np.abs(least), -(2.0**63), 2.0**63)  # sums beyond 2**53 are rounded


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each query row, ties to the smaller id.

    Null ids, null vectors and vectors with null, NaN or infinite components take no part. Rows compare with rows of the same
    length; a row with the query's own id is no candidate. Repeated rows of another id each count. Fewer than k candidates
    give fewer rows; an empty table gives none. Only the two named columns are read; texts take no part. Scores beyond 64 bits saturate. Pivots,
    and the rows that a query meets first, come from the `sample` rows of least hash.
    """
    rows = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), "_query")
    rows = rows.where(F.col("vec_id").isNotNull() & usable("v"))
    spark = vectors.sparkSession
    size = rows.select("vec_id").count()
    cores = spark.sparkContext.defaultParallelism
    groups = max(1, -(-size // GROUP_ROWS), min(2 * cores, -(-size // 1024)))
    drawn = [(r.vec_id, np.floor(SCALE * np.asarray(r.v, float))) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    known = {d: (np.array([i for i, v in drawn if len(v) == d], np.int64), np.stack([v for _, v in drawn if len(v) == d])) for d in {len(v) for _, v in drawn}}
    bases = {d: basis(x, pivots) for d, (_, x) in known.items()}

    block = max(1, min(BLOCK, -(-size // groups)))
    candidates = stored(rows.select("vec_id", "v").mapInPandas(_blocks(groups, block, bases), BLOCK_SCHEMA), "candidates")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = []
            for dim, ids, data in zip(batch["dim"], batch["ids"], batch["data"]):
                ids = np.frombuffer(ids, np.int64)
                s_ids, s = known.get(dim, (np.empty(0, np.int64), np.empty((0, dim))))
                seen.append(_seen(ids, np.frombuffer(data, np.float64).reshape(len(ids), dim), s_ids, s, k).tobytes())
            yield batch.assign(least=seen)

    queries = rows.where("_query").select("vec_id", "v").mapInPandas(_blocks(1, QUERY_BLOCK, bases), BLOCK_SCHEMA).mapInPandas(meet, BLOCK_SCHEMA + ", least binary")
    queries = stored(queries, "queries")
    copies = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "data", "apex", "least")])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, q_apex, c, c_apex = (_rows(r[n], ids) for n, ids in (("q_data", q_ids), ("q_apex", q_ids), ("data", c_ids), ("apex", c_ids)))
                found, _ = search_block(q_ids, q, q_apex, np.frombuffer(r["q_least"], np.float64), c_ids, c, c_apex, k)
                yield pd.DataFrame(np.concatenate(found), columns=["query_id", "vec_id", "score"])

    key = ["dim", "part"]
    pairs = copies.repartition(groups, *key).join(candidates.repartition(groups, *key), key)
    near = pairs.mapInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = stored(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-k")
    dropped(candidates, queries)
    return out
