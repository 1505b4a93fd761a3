"""MinHash near-duplicate detection with tensored banding.

Two small collections of `half` half keys (each of two minima) are combined pairwise into half * half table keys of four
minima, so the number of minima grows with the square root of the number of tables. Texts that share a table key are
candidates; every link is confirmed on the full shingle sets. Steps:

1. Texts with equal shingle sets form a class with a number of its own (pre-aggregated, so a class of any size costs one row
   per task).
2. Round 1: within each table key, each class is compared with one class, chosen by a hash that differs from key to key, so a
   class meets many others. Confirmed links give components.
3. Round 2: classes of one table key that are still in different components are compared with each other, so no link between
   different components is lost; pairs inside a component need no comparison. Keys of more than `CROWD` classes are compared
   in blocks: a task intersects the sets of two blocks at once and returns links only.

The chance that a pair at exactly the threshold shares no table key is below `MISS`; above the threshold it falls steeply.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import dropped, free_name, heavy_join, stored, whole
from .shingles import mix, shingle_set

MISS = 1e-4
CROWD = 8
BLOCK = 512
BLOCK_SHINGLES = 500_000


@dataclass(frozen=True)
class Scheme:
    """Shingle size and the threshold as percent: 100 * intersection >= percent * union."""

    shingle: int = 3
    percent: int = 85

    @property
    def half(self) -> int:
        """Half keys in each collection, so that both collections agree somewhere with the wanted probability."""
        return max(1, math.ceil(math.log(MISS / 2) / math.log(1 - (self.percent / 100) ** 2)))


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def table_keys(shingles: np.ndarray, half: int) -> np.ndarray:
    """half * half keys: every half key of the first collection with every one of the second."""
    a = _multipliers(4 * half)
    least = np.full(4 * half, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        least = np.minimum(least, (part[None, :] * a[:, None]).min(axis=1))
    halves = mix(least[0::2] * np.uint64(0xD6E8FEB86659FD93) + least[1::2])
    pair = np.arange(half * half, dtype=np.uint64)
    return mix(np.repeat(halves[:half], half) * np.uint64(0x9FB21C651E98DF25) + np.tile(halves[half:], half) + pair)


SIGNATURE = "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, set_a bigint, set_b bigint, keys array<bigint>"
#: Columns that a class of equal sets has in common.
SET = ["n_shingles", "set_a", "set_b"]


def _row_keys() -> list[Column]:
    """A 128-bit key of doc_id and text: a doc_id may stand for several texts."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")]


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """For every row: its key, set size, a 128-bit hash of the set and the table keys (null where there are no shingles)."""
    k, half = scheme.shingle, scheme.half

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text, k)
                n.append(len(s))
                a.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(7)), initial=np.uint64(0)).view(np.int64)))
                b.append(int(mix(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64).view(np.int64)))
                keys.append(table_keys(s, half).view(np.int64) if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "k1": batch["k1"], "k2": batch["k2"], "n_shingles": n, "set_a": a, "set_b": b, "keys": keys})

    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    return rows.select("doc_id", *_row_keys(), "text").mapInPandas(sign, SIGNATURE)


def _sets(docs: DataFrame, wanted: DataFrame, scheme: Scheme) -> DataFrame:
    """(id, n, s): the sorted shingle set, as bytes, of each wanted class (id, k1, k2)."""
    k = scheme.shingle

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(t, k) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n": [len(s) for s in found], "s": [s.tobytes() for s in found]})

    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text")).select(*_row_keys(), "text")
    return rows.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("id", "text").mapInPandas(sets, "id bigint, n bigint, s binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["s"], batch["t"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["u", "v"]]

    left = pairs.join(sets.select(F.col("id").alias("u"), "n", "s"), "u")
    right = sets.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("s").alias("t"))
    fits = (F.col("m") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("m") * percent)
    return left.join(right, "v").where(fits).select("u", "v", "s", "t").mapInPandas(confirm, "u bigint, v bigint")


def links_within(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, as many as it takes to join what can be joined."""
    size = np.array([len(x) for x in sets])
    token, place = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(place, minlength=len(token)) > 1  # only these can lie in an intersection
    column = (np.cumsum(common) - 1)[place]
    member = np.repeat(np.arange(len(sets)), size)
    inside = np.flatnonzero(common[place])
    inside = inside[np.argsort(column[inside], kind="stable")]
    member, column = member[inside], column[inside]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(common.sum()), 4096):  # bounded memory, however many shingles there are
        a, b = np.searchsorted(column, [at, at + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[member[a:b], column[a:b] - at] = 1
        both += has @ has.T
    parent = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    both = np.rint(both).astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    for x, y in zip(*np.nonzero(np.triu(linked & (component[:, None] != component[None, :])))):
        a, b = root(int(component[x])), root(int(component[y]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[x]), int(ids[y])))
    return out


def _crowd_links(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different components of crowded keys, found in blocks.

    Crowded keys that share members form a cluster. Its members are dealt into blocks of about BLOCK members and BLOCK_SHINGLES shingles, and each pair of blocks is
    compared in one task: intersections of all members at once, with no row for a pair that is not a link.
    """
    hubs = crowds.groupBy("key").agg(F.min("id").alias("hub"))
    clusters = graph.components(crowds.join(hubs, "key").select(F.col("hub").alias("u"), F.col("id").alias("v")))
    placed = crowds.select("id", "component").distinct().join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    placed = placed.join(sets.select("id", "n"), "id")
    blocks = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = placed.drop("n").join(blocks, "cluster").withColumn("own", own).join(sets.select("id", "s"), "id")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component", "s")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(held: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(held)
            found = links_within(rows["id"].to_numpy(), rows["component"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["s"]], percent)
            return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

        held: list[pd.DataFrame] = []
        now = None
        for batch in batches:
            for name, part in batch.groupby(["cluster", "i", "j"], sort=False):
                if held and name != now:
                    yield done(held)
                    held = []
                now = name
                held.append(part)
        if held:
            yield done(held)

    parts = int(crowds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
    out = stored(dealt.mapInPandas(compare, "u bigint, v bigint"), "links")
    dropped(clusters)
    return out


def _grouped(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Stored: doc_id, k1, k2, n_shingles and group (a number for each component; null without doc_id or shingles)."""
    signed = stored(signatures(docs, scheme), "signatures")
    known = signed.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy(*SET).agg(F.min(F.struct("doc_id", "k1", "k2")).alias("one"), F.first("keys").alias("keys"))  # equal sets have equal keys
    classes = stored(classes.select(*SET, "one.k1", "one.k2", "keys", F.monotonically_increasing_id().alias("id")), "classes")  # written once, so numbers stay
    keyed = classes.select(F.explode("keys").alias("key"), "id")
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id")).alias("center")).where("size > 1")
    shared = stored(several.select("key", "size", F.col("center.id").alias("center")), "keys")
    members = stored(heavy_join(keyed, shared, ["key"], "size").select("key", "id", "center"), "members")
    sets = stored(_sets(docs, classes.select("id", "k1", "k2").join(members.select("id").distinct(), "id", "left_semi"), scheme), "sets")

    stars = members.where("id <> center").select(F.least("center", "id").alias("u"), F.greatest("center", "id").alias("v")).distinct()
    links = stored(_confirmed(stars, sets, scheme.percent), "links")
    parts = graph.components(links)
    spent = [parts]

    placed = stored(members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    open_keys = stored(open_keys.select("key", "size"), "open-keys")
    rest = stored(heavy_join(placed, open_keys, ["key"], "size"), "rest")
    x, y = rest.where(F.col("size") <= CROWD).alias("x"), rest.where(F.col("size") <= CROWD).alias("y")
    pairs = x.join(y, "key").where("x.id < y.id and x.component <> y.component").select(F.col("x.id").alias("u"), F.col("y.id").alias("v")).distinct()
    more = stored(_confirmed(pairs, sets, scheme.percent), "links")
    spent.append(more)
    crowds = rest.where(F.col("size") > CROWD)
    if not crowds.isEmpty():
        spent.append(_crowd_links(crowds, sets, scheme.percent))
        more = more.union(spent[-1])
    if not more.isEmpty():
        parts = graph.components(more.union(parts.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        spent.append(parts)

    named = classes.join(parts.withColumnRenamed("node", "id"), "id", "left").select(*SET, F.coalesce("component", "id").alias("part"))
    part = F.when(F.col("doc_id").isNotNull(), F.col("part"))
    out = stored(signed.drop("keys").join(named, SET, "left").select("doc_id", "k1", "k2", "n_shingles", part.alias("group")), "groups")
    dropped(signed, classes, shared, members, sets, links, placed, open_keys, rest, *spent)
    return out


def link(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; only doc_id and text are read.

    Null text and text without words have no shingles and link with nothing. Texts with equal sets are one class. A null
    doc_id is never linked: its component is null and it is kept. Rows link by their texts, also where a doc_id has several;
    rows that repeat are each returned. Texts of any length are read whole. An empty table gives an empty result.
    """
    grouped = _grouped(docs, scheme)
    least = stored(grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")), "components")
    linked = heavy_join(grouped.where("group is not null"), least, ["group"], "rows").select("doc_id", "n_shingles", "component_id")
    out = linked.unionByName(grouped.where("group is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    out = stored(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")
    dropped(grouped, least)
    return out


def representatives(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """docs with one row of each group: one of the smallest doc_id, ties by a hash of the text; all columns stay.

    Rows without doc_id and rows without words stay. Of rows that repeat doc_id and text one stays.
    """
    one, two = free_name(docs, "_k1"), free_name(docs, "_k2")
    grouped = _grouped(docs, scheme)
    best = grouped.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("one")).select("one.k1", "one.k2")
    rows = grouped.where("group is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    best = best.join(rows, ["k1", "k2"])
    free = grouped.where("group is null").select("k1", "k2").distinct()
    single = stored(best.where("copies = 1").select("k1", "k2").union(free).select(F.col("k1").alias(one), F.col("k2").alias(two)), "kept-rows")
    again = best.where("copies > 1").select(F.col("k1").alias(one), F.col("k2").alias(two))
    text = whole()
    rows = docs.withColumns({one: F.xxhash64(F.col("doc_id").cast("long"), text), two: F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), text)})
    kept = rows.join(single, [one, two], "left_semi").unionByName(rows.join(again, [one, two], "left_semi").dropDuplicates([one, two]))
    return kept.drop(one, two)
