"""Benchmark decontamination by greedy string tiling.

Tokens are runs of Unicode letters and digits in folded case, single characters in scripts without spaces, so punctuation,
layout and case do not matter. Documents and benchmark items that share a seed of `SEED` tokens in a row are candidates. A candidate pair is tiled:
the longest match of tokens that are not yet covered is marked, again and again, down to the seed's length. The length comes
from running Karp-Rabin hashes by bisection, and matches are verified token by token; repeats cost no more than their number. Tiles may lie in any order, so reordered passages
count. A pair whose tiles cover `COVERAGE` percent of the item's tokens is contaminated. An item of fewer than `SEED` tokens
is its own seed: it counts where all its tokens stand in a row.

A benchmark of up to `HELD_TOKENS` tokens goes to every task, and documents are tiled where they are read. A larger one is
joined on its seeds; only candidates' texts move then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, whole
from .shingles import runs, tokens

SEED = 5
COVERAGE = 80
HELD_TOKENS = 1_000_000

#: Two primes below 2**31 and a base for each.
_FIELDS = ((2147483647, 1103515245), (2147483629, 362437069))


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


class _Rolling:
    """Karp-Rabin hashes of any run of tokens in constant time, modulo two primes."""

    def __init__(self, token: np.ndarray):
        self.fields = []
        for prime, base in _FIELDS:
            p = np.uint64(prime)
            terms = (token % p) * _powers(prime, base, len(token)) % p
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]) % p
            self.fields.append((p, sums, _powers(prime, pow(base, -1, prime), len(token) + 1)))

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        one, two = ((sums[start + length] + p - sums[start]) % p * down[start] % p for p, sums, down in self.fields)
        return one << np.uint64(31) | two


def _free(covered: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows without a covered token."""
    total = np.concatenate([[0], np.cumsum(covered)])
    return np.flatnonzero(total[length:] == total[: len(total) - length])


def _marked(item, doc, p, t, hp, ht, length: int, in_item, in_doc) -> list[tuple[int, int, int]]:
    """Tiles of the length, first in item and then in doc; their tokens are marked. p and t are free starts with hashes hp, ht.

    Each item window takes the first window of doc of its hash that is free. Windows that are not stay so, so each list of
    places is gone through once, whatever the number of pairs.
    """
    shared = np.intersect1d(hp, ht)
    at_item, at_doc = np.isin(hp, shared), np.isin(ht, shared)
    p, hp, t, ht = p[at_item], hp[at_item], t[at_doc], ht[at_doc]
    by = np.argsort(ht, kind="stable")
    t, low = t[by], np.searchsorted(ht[by], shared)
    high = np.append(low[1:], len(t))
    next_one, tiles = low.copy(), []
    for i, kind in zip(p.tolist(), np.searchsorted(shared, hp).tolist()):
        if in_item[i : i + length].any():
            continue
        at = next_one[kind]
        while at < high[kind] and in_doc[t[at] : t[at] + length].any():
            at += 1
        next_one[kind] = at
        while at < high[kind]:
            d = int(t[at])
            if not in_doc[d : d + length].any() and np.array_equal(item[i : i + length], doc[d : d + length]):  # verification
                in_item[i : i + length] = in_doc[d : d + length] = True
                tiles.append((length, i, d))
                break
            at += 1
    return tiles


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (length, place in item, place in doc), longest first; each token of either side is in one tile at most.

    The longest match of free tokens is marked, the first in item and then in doc, again and again. Its length is found by
    bisection: where a run is shared, so are its shorter parts.
    """
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    one, two = _Rolling(item), _Rolling(doc)
    most, tiles = min(len(item), len(doc)), []

    def windows(length: int):
        p, t = _free(in_item, length), _free(in_doc, length)
        return p, t, one.of(p, length), two.of(t, length)

    while most >= least:
        low, high = least - 1, most
        while low < high:
            mid = (low + high + 1) // 2
            _, _, hp, ht = windows(mid)
            low, high = (mid, high) if np.isin(hp, ht).any() else (low, mid - 1)
        if low < least:
            break
        p, t, hp, ht = windows(low)
        tiles += _marked(item, doc, p, t, hp, ht, low, in_item, in_doc)
        most = low - 1
    return tiles


@dataclass(frozen=True)
class Benchmark:
    """Item tokens and, sorted by hash, their seeds; for items of fewer than k tokens, by length, the hash of the whole."""

    ids: tuple[int, ...]
    items: tuple[np.ndarray, ...]
    seed: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    k: int
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int, str]], k: int = SEED) -> Benchmark:
        kept = [(i, w) for i, t in sorted(set(rows)) if len(w := tokens(t))]
        items = tuple(w for _, w in kept)
        seeds = [runs(w, k) if len(w) >= k else np.empty(0, np.uint64) for w in items]
        all_seeds = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else owner
        by = np.argsort(all_seeds, kind="stable")
        short = {}
        for n in sorted({len(w) for w in items if len(w) < k}):
            own = np.array([j for j, w in enumerate(items) if len(w) == n])
            run = np.concatenate([runs(items[j], n) for j in own])
            order = np.argsort(run, kind="stable")
            short[n] = run[order], own[order]
        return Benchmark(tuple(i for i, _ in kept), items, all_seeds[by], owner[by], place[by], k, short)

    def _short_hits(self, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        out = []
        for n, (run, own) in self.short.items():
            if len(doc) < n:
                continue
            mine = np.unique(runs(doc, n))
            low, high = np.searchsorted(run, mine, "left"), np.searchsorted(run, mine, "right")
            for j in np.concatenate([own[a:b] for a, b in zip(low, high) if b > a] or [own[:0]]):
                if tile(self.items[j], doc, n):  # verification
                    out.append((self.ids[j], n, n, 1, n))
        return out

    def search(self, text: str, coverage: int) -> list[tuple[int, int, int, int, int]]:
        """(item id, covered tokens, item tokens, tiles, longest tile) of the items that text contains."""
        doc = tokens(text)
        out = self._short_hits(doc)
        if len(doc) < self.k or not len(self.seed):
            return out
        mine = np.unique(runs(doc, self.k))
        low, high = np.searchsorted(self.seed, mine, "left"), np.searchsorted(self.seed, mine, "right")
        n = high - low
        if not n.any():
            return out
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for item in np.unique(self.owner[at]):
            places = self.place[at[self.owner[at] == item]]
            size = len(self.items[item])
            touched = np.zeros(size + 1, np.int64)  # tokens under a shared seed: tiles cannot cover more
            np.add.at(touched, places, 1)
            np.add.at(touched, places + self.k, -1)
            if 100 * np.count_nonzero(np.cumsum(touched)) < coverage * size:
                continue
            tiles = tile(self.items[item], doc, self.k)
            covered = sum(t[0] for t in tiles)
            if 100 * covered >= coverage * size:
                out.append((self.ids[item], covered, size, len(tiles), max(t[0] for t in tiles)))
        return out


HIT = "item_id bigint, covered bigint, item_tokens bigint, tiles bigint, longest bigint"


def _held(docs: DataFrame, bench: Benchmark, coverage: int) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch["doc_id"], batch["text"]) for hit in bench.search(t, coverage)]
            yield pd.DataFrame(rows, columns=["doc_id", *[c.split()[0] for c in HIT.split(", ")]]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(scan, f"doc_id bigint, {HIT}")


def _joined(docs: DataFrame, items: DataFrame, coverage: int, k: int) -> DataFrame:
    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": np.unique([len(tokens(t)) for t in batch["item"]]).astype(np.int64)})

    short = [r.n for r in items.mapInPandas(sizes, "n bigint").where(F.col("n").between(1, k - 1)).distinct().collect()]  # at most k - 1 rows

    def seeds_of(lengths):
        def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, text in zip(batch["key"], batch["text"]):
                    word = tokens(text)
                    for n in lengths(len(word)):
                        yield pd.DataFrame({"n": n, "seed": np.unique(runs(word, n)).view(np.int64), "key": key})

        return seeds

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, item, text, own in zip(batch["key"], batch["item_id"], batch["text"], batch["item"]):
                rows += [(key, *hit) for hit in Benchmark.of([(item, own)], k).search(text, coverage)]
            yield pd.DataFrame(rows, columns=["key", *[c.split()[0] for c in HIT.split(", ")]])

    keyed = docs.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    texts = keyed.select("key", "text").dropDuplicates(["key"])
    own = items.withColumn("key", F.col("item_id").cast("string"))
    left = texts.mapInPandas(seeds_of(lambda size: [n for n in [*short, k] if n <= size]), "n int, seed bigint, key string")
    right = own.select("key", F.col("item").alias("text")).mapInPandas(seeds_of(lambda size: [min(size, k)] if size else []), "n int, seed bigint, key string").withColumnRenamed("key", "item_key")
    pairs = left.join(right, ["n", "seed"]).select("key", F.col("item_key").cast("long").alias("item_id")).distinct()
    hits = pairs.join(items, "item_id").join(texts, "key").mapInPandas(search, f"key string, {HIT}")
    return keyed.select("doc_id", "key").join(hits, "key").drop("key")


def find(docs: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE, seed: int = SEED, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """doc_id, item_id, covered, item_tokens, tiles, longest of every contaminated pair.

    Null texts count as empty. Items of fewer than `seed` tokens are sought as one whole run; items without a token or without
    id take no part; equal items with different ids each report. Repeated rows of docs each report. Empty tables give an empty result. Texts of any length are read whole. Only
    doc_id, item_id and text are read.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), whole().alias("item")).distinct()
    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0]
    if size <= 2 * held_tokens:  # a token with its separator has two bytes at least
        return _held(rows, Benchmark.of([(r.item_id, r.item) for r in items.collect()], seed), coverage)
    return _joined(rows, items, coverage, seed)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE, seed: int = SEED, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """docs without contaminated rows; all columns stay. Rows without doc_id are kept or dropped by their own text."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), whole().alias("item")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0]
    if size <= 2 * held_tokens:
        bench = Benchmark.of([(r.item_id, r.item) for r in items.collect()], seed)

        @F.pandas_udf("boolean")
        def dirty(text: pd.Series) -> pd.Series:
            return pd.Series([bool(bench.search(t, coverage)) for t in text], dtype=bool)

        return docs.where(~dirty(whole()))
    texts = docs.select(whole().alias("text")).distinct().select(F.monotonically_increasing_id().alias("doc_id"), "text")
    texts = stored(texts, "texts")
    dirty = _joined(texts, items, coverage, seed).select("doc_id").distinct().join(texts, "doc_id")
    one, two = free_name(docs, "_t1"), free_name(docs, "_t2")
    keys = {one: F.xxhash64(whole()), two: F.xxhash64(F.lit(1), whole())}
    dirty = dirty.select(*[c.alias(n) for n, c in keys.items()])
    return docs.withColumns(keys).join(dirty, [one, two], "left_anti").drop(one, two)
