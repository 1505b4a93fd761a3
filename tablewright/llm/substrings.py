"""Suffix-array dedup: what long strings cover that also start elsewhere is removed (bytes) or told (passages of words).

Sorting every suffix of a corpus would move each unit many times, so the suffixes are first thinned without loss. Every string
of LENGTH units contains an anchor: the smallest of its GRAM-unit hashes (a minimizer). Equal strings have the same anchor at the
same place, so a string can only repeat where its anchor's gram repeats.

1. One scan finds the anchors with the range of window starts that each serves, the gram's hash and a digest of the range.
2. Anchors whose gram occurs once are done: nothing there repeats. Anchors whose whole served range is equal to another's are
   done as well: all of it repeats. Equal means an equal 128-bit BLAKE2 digest of the units. Both follow from pre-aggregated
   counts, whatever the size of a group of copies.
3. For the rest, the suffixes at the served window starts are sorted, per gram and place, by a merge sort whose comparisons
   find the common extension by binary search over prefix polynomial hashes. Neighbours with a common extension of LENGTH are
   verified unit by unit. Grams with more than CROWD different contexts are not brought together: blocks of BLOCK windows, and
   then the windows that blocks leave open, are counted by their digests instead, pre-aggregated before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import dropped, freed, heavy_anti, heavy_join, stored, whole
from .shingles import mix

LENGTH = 400
GRAM = 208
CROWD = 256
BLOCK = 12
#: Words of a passage, and of its anchors.
PASSAGE = 50
PASSAGE_GRAM = 26
CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Units:
    """What a string is made of: an array of numbers for a text."""

    of: Callable[[str], np.ndarray]
    dtype: type


BYTES = Units(lambda text: np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), np.uint8)


def _words(text: str) -> np.ndarray:
    found = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


#: Words between white space, each as a 64-bit hash.
WORDS = Units(_words, np.uint64)


@dataclass(frozen=True)
class Search:
    """Strings of `length` units that repeat, found by anchors of `gram`; texts of fewer than `least` bytes hold none."""

    units: Units
    length: int
    gram: int
    least: int = 0


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests (n x 2 long) of data[start:end]."""
    raw, size = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    joined = b"".join(hashlib.blake2b(raw[a * size : b * size], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist()))
    return np.frombuffer(joined, np.int64).reshape(len(start), 2)


class Hashes:
    """Prefix polynomial hashes modulo 2**64 of an array; any part's hash in constant time."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        ups, downs = self._powers(base, len(data) + 1)
        self.downs = downs
        terms = (data.astype(np.uint64) + np.uint64(1)) * ups[: len(data)]
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._tables.get(base)
        if have is None or len(have[0]) < n:
            size = max(1024, 1 << (n - 1).bit_length())
            have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            if size <= 1 << 22:  # a single huge text should not pin memory
                cls._tables[base] = have
        return have

    def order(self, start: int, end: int, size: int) -> np.ndarray:
        """For each place from start to end a number that depends on the next `size` units, to choose the least from."""
        x = (self.prefix[start + size : end + size] - self.prefix[start:end]) * self.downs[start:end]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x

    def of(self, start, end) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.downs[start] + np.uint64(0x51ED2701) * (np.asarray(end) - start).astype(np.uint64))


def _leftmost_minima(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of its minimum by the high bits, the leftmost of equals; x has CHUNK + w values at most.

    The low bits give way to the place, so one minimum tells both; windows grow by doubling.
    """
    bits = np.uint64(max(1, len(x).bit_length()))
    least = (x >> bits << bits) | np.arange(len(x), dtype=np.uint64)
    width = 1
    while width < w:
        step = min(width, w - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def anchors(texts: list[np.ndarray], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Rows of text number, place, first and last window start served, gram hash and digest (two numbers) of the served range.

    The texts are looked at as one array, as most are short; windows that reach into a next text are left out.
    """
    sizes = np.array([len(t) for t in texts])
    base = np.cumsum(sizes) - sizes
    data = np.concatenate(texts) if texts else np.empty(0, np.uint8)
    starts = [b + np.arange(n - length + 1) for b, n in zip(base.tolist(), sizes.tolist()) if n >= length]
    if not starts:
        return np.empty((0, 7), np.int64)
    starts, w = np.concatenate(starts), length - gram + 1
    hashes = Hashes(data, BASE)
    chosen = []
    for lo in range(0, len(data) - length + 1, CHUNK):
        hi = min(len(data) - length + 1, lo + CHUNK)
        chosen.append(_leftmost_minima(hashes.order(lo, hi + w - 1, gram), w) + lo)
    place = np.concatenate(chosen)[starts]
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    first, last, at = starts[new], starts[np.append(new[1:], len(starts)) - 1], place[new]
    owner = np.searchsorted(base, first, "right") - 1
    own = base[owner]
    return np.column_stack([owner, at - own, first - own, last - own, hashes.of(at, at + gram).view(np.int64), _digests(data, first, last + length)])


ROW = ["k1", "k2"]
RANGE = ["gram", "range_a", "range_b"]
ENTRY = "k1 bigint, k2 bigint, at bigint, first bigint, last bigint, gram bigint, range_a bigint, range_b bigint"


def _frame(rows: list[np.ndarray], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(np.concatenate(rows) if rows else np.empty((0, len(columns)), np.int64), columns=columns)


def _entries(docs: DataFrame, units: Units, length: int, gram: int) -> DataFrame:
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch[ROW].to_numpy(np.int64)
            held, at, size = [], 0, 0
            for n, text in enumerate(batch["text"]):
                held.append(units.of(text))
                size += len(held[-1])
                if size >= CHUNK or n == len(batch) - 1:
                    found = anchors(held, length, gram)
                    yield _frame([np.column_stack([keys[at + found[:, 0]], found[:, 1:]])], names)
                    held, at, size = [], n + 1, 0

    return docs.mapInPandas(scan, ENTRY)


def common_extension(one: Hashes, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Length, up to most, of the longest common extension of the suffixes at x and y, by binary search over hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = one.of(x, x + mid) == one.of(y, y + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sort_suffixes(data: np.ndarray, one: Hashes, starts: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """The order that sorts suffixes (to length) within each segment; equal segments must lie together.

    A bottom-up merge sort over all segments at once: an element's place in the merged run is its own index plus the number
    of smaller elements of the sibling run, found by binary search with hash comparisons.
    """
    n = len(starts)
    order = np.arange(n)
    begin = np.maximum.accumulate(np.where(np.diff(segment, prepend=segment[:1] - 1) != 0, np.arange(n), 0)) if n else order
    size = np.bincount(begin, minlength=n)[begin] if n else order
    width = 1
    while n and width < size.max():
        inner = np.arange(n) - begin
        run = inner // width
        mate = (run ^ 1) * width
        low, high = np.minimum(mate, size), np.minimum(mate + width, size)
        top = high.copy()
        mate_low = low.copy()
        right = run % 2 == 1
        while (act := np.flatnonzero(low < high)).size:
            mid = (low[act] + high[act]) // 2
            x, y = starts[order[act]], starts[order[begin[act] + mid]]
            same = common_extension(one, x, y, length)
            end = same == length
            step = np.minimum(same, length - 1)
            before = np.where(end, right[act], data[y + step] < data[x + step])  # is the sibling's element to go first?
            low[act], high[act] = np.where(before, mid + 1, low[act]), np.where(before, high[act], mid)
        target = begin + (run // 2) * 2 * width + inner % width + (low - mate_low)
        target = np.where(top <= mate_low, np.arange(n), target)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def repeated_windows(contexts: list[bytes], group: np.ndarray, offset: np.ndarray, length: int = LENGTH, dtype: type = np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (units over all windows that an anchor serves; offset is the anchor's place in its context), the first and
    last window start, within each context, that repeats in its group; -1 where none does."""
    data = np.frombuffer(b"".join(contexts), dtype)
    sizes = np.array([len(c) for c in contexts]) // data.itemsize
    base = np.cumsum(sizes) - sizes
    one = Hashes(data, BASE)
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = offset[owner] - inner  # how far the anchor is from the window's start
    start = base[owner] + inner
    by = np.lexsort((owner, place, group[owner]))
    owner, inner, place, start = owner[by], inner[by], place[by], start[by]
    segment = np.cumsum((np.diff(group[owner], prepend=-1) != 0) | (np.diff(place, prepend=1 << 40) != 0))
    order = sort_suffixes(data, one, start, segment, length)
    owner, inner, start, segment = owner[order], inner[order], start[order], segment[order]
    pair = np.flatnonzero((segment[1:] == segment[:-1]))
    pair = pair[common_extension(one, start[pair], start[pair + 1], length) == length]
    good = np.ones(len(pair), bool)
    for at in range(0, len(pair), 4096):  # collision verification
        x, y = start[pair[at : at + 4096]], start[pair[at : at + 4096] + 1]
        good[at : at + 4096] = (data[x[:, None] + np.arange(length)] == data[y[:, None] + np.arange(length)]).all(axis=1)
    hit = np.unique(np.concatenate([pair[good], pair[good] + 1]))
    low, high = np.full(len(contexts), np.iinfo(np.int64).max), np.full(len(contexts), -1)
    np.minimum.at(low, owner[hit], inner[hit])
    np.maximum.at(high, owner[hit], inner[hit])
    return np.where(high < 0, -1, low), high


FOUND = "k1 bigint, k2 bigint, low bigint, high bigint"


def _sorted_groups(rows: DataFrame, units: Units, length: int) -> DataFrame:
    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(part: pd.DataFrame) -> pd.DataFrame:
            group = pd.factorize(part["gram"])[0]
            low, high = repeated_windows(list(part["context"]), group, (part["at"] - part["first"]).to_numpy(), length, units.dtype)
            hit = (high >= 0) & part["open"].to_numpy()
            first = part["first"].to_numpy()
            return pd.DataFrame({"k1": part["k1"].to_numpy()[hit], "k2": part["k2"].to_numpy()[hit], "low": (first + low)[hit], "high": (first + high)[hit] + length})

        held: list[pd.DataFrame] = []
        waiting = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            waiting += len(batch)
            if waiting >= 2048 and batch["gram"].iloc[0] != batch["gram"].iloc[-1] or waiting >= 8192:
                rows = pd.concat(held, ignore_index=True)
                cut = int((rows["gram"] != rows["gram"].iloc[-1]).sum())  # the last group may go on
                if cut:
                    yield done(rows.iloc[:cut])
                held = [rows.iloc[cut:]]
                waiting = len(held[0])
        if waiting:
            yield done(pd.concat(held, ignore_index=True))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "gram").sortWithinPartitions("gram", *ROW, "at").mapInPandas(resolve, FOUND)


def _contexts(docs: DataFrame, wanted: DataFrame, searches: list[Search]) -> DataFrame:
    """The wanted entries of all searches with the units of all windows that they serve; a text is moved once for all of them."""
    own = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("search", "at", "first", "last", "gram", "open", "crowded")).alias("own"))  # a text's own anchors
    schema = "k1 bigint, k2 bigint, search int, at bigint, first bigint, last bigint, gram bigint, open boolean, crowded boolean, context binary"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k1, k2, text, own in zip(batch["k1"], batch["k2"], batch["text"], batch["own"]):
                data = {n: searches[n].units.of(text) for n in {e["search"] for e in own}}
                rows += [(k1, k2, n, e["at"], e["first"], e["last"], e["gram"], e["open"], e["crowded"], data[n][e["first"] : e["last"] + searches[n].length].tobytes()) for e in own for n in [e["search"]]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return docs.join(own, ROW).dropDuplicates(ROW).mapInPandas(cut, schema)


def _block_digests(rows: DataFrame, units: Units, length: int) -> DataFrame:
    """For each block of BLOCK distances from the anchor: digests of what all its windows share and, where all are served, of what they cover."""
    names = ["k1", "k2", "at", "open", "block", "low", "high", "core_a", "core_b", "all_a", "all_b"]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k1, k2, at, first, last, is_open, context in zip(*[batch[c] for c in ("k1", "k2", "at", "first", "last", "open", "context")]):
                data = np.frombuffer(context, units.dtype)
                block = np.arange((at - last) // BLOCK, (at - first) // BLOCK + 1)
                near, far = at - block * BLOCK, at - (block + 1) * BLOCK + 1  # last and first window start of the block
                core = _digests(data, near - first, far - first + length)
                low, high = np.maximum(far, first), np.minimum(near, last)
                cover = np.where(((far >= first) & (near <= last))[:, None], _digests(data, low - first, high - first + length), 0)
                yield pd.DataFrame(np.column_stack([np.full(len(block), k1), np.full(len(block), k2), np.full(len(block), at), np.full(len(block), is_open), block, low, high, core, cover]), columns=names).astype({"open": bool})

    return rows.mapInPandas(blocks, ", ".join(f"{n} {'boolean' if n == 'open' else 'bigint'}" for n in names))


def _window_digests(rows: DataFrame, units: Units, length: int) -> DataFrame:
    """Digests of the windows in `ranges` (first and last start) of each context."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k1, k2, at, first, is_open, context, ranges in zip(*[batch[c] for c in ("k1", "k2", "at", "first", "open", "context", "ranges")]):
                s = np.unique(np.concatenate([np.arange(r["low"], r["high"] + 1) for r in ranges])) - first
                found = _digests(np.frombuffer(context, units.dtype), s, s + length)
                yield pd.DataFrame({"k1": k1, "k2": k2, "at": at, "open": is_open, "start": first + s, "a": found[:, 0], "b": found[:, 1]})

    return rows.mapInPandas(windows, "k1 bigint, k2 bigint, at bigint, open boolean, start bigint, a bigint, b bigint")


def _crowded(rows: DataFrame, units: Units, length: int) -> DataFrame:
    """Repeated windows of grams with many contexts, by pre-aggregated counts of digests, from blocks of windows down to windows.

    Blocks whose common part occurs once are done, and blocks whose whole cover occurs again repeat as they are; of each such
    cover one block stays as a partner for the others. Only the windows of the remaining blocks are looked at one by one.
    """
    blocks = stored(_block_digests(rows, units, length), "blocks")
    core, cover, place = ["core_a", "core_b"], ["all_a", "all_b"], F.struct(*ROW, "at", "block")
    cores = stored(blocks.groupBy(*core).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cores")
    shared = stored(heavy_join(blocks, cores, core, "n").drop("n"), "shared-blocks")
    covers = shared.where("all_a <> 0 or all_b <> 0").groupBy(*cover).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")).where("n > 1")
    covers = stored(covers, "covers")
    known = stored(heavy_join(shared, covers, cover, "n"), "known-blocks")
    settled = known.where("open").select(*ROW, "low", (F.col("high") + length).alias("high"))
    unknown = heavy_anti(shared, covers, cover, "n")
    looked_at = unknown.select(*ROW, "at", "low", "high").union(known.where(place == F.col("one")).select(*ROW, "at", "low", "high"))
    ranges = looked_at.groupBy(*ROW, "at").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))  # blocks of one anchor
    each = stored(_window_digests(rows.join(ranges, [*ROW, "at"]), units, length), "windows")
    often = stored(each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    hit = heavy_join(each.where("open"), often, ["a", "b"], "n").groupBy(*ROW, "at").agg(F.min("start").alias("low"), (F.max("start") + length).alias("high"))
    found = stored(settled.union(hit.select(*ROW, "low", "high")), "crowded-spans")
    dropped(blocks, cores, shared, covers, known, each, often)
    return found


def _narrowed(docs: DataFrame, search: Search, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Ranges that repeat as a whole, and the entries whose contexts are to be looked at; both stored."""
    entries = stored(_entries(docs.where(F.octet_length("text") >= search.least), search.units, search.length, search.gram), "anchors")
    often = stored(entries.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    some = stored(heavy_join(entries, often, ["gram"], "n", hashed=True).drop("n"), "entries")
    dropped(entries, often)
    freed(docs)
    kinds = stored(some.groupBy(*RANGE).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "at", "first", "last")).alias("one")), "ranges")
    copies = stored(kinds.where("n > 1").select(*RANGE, "n"), "copies")
    clear = heavy_join(some, copies, RANGE, "n")
    clear = stored(clear.select(*ROW, F.col("first").alias("low"), (F.col("last") + search.length).alias("high")), "clear")
    contexts = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("rarest"))
    unclear = stored(contexts.where("kinds > 1 and rarest = 1").select("gram", "kinds", (F.col("kinds") > crowd).alias("crowded")), "unclear")
    wanted = stored(heavy_join(kinds, unclear, ["gram"], "kinds").select("gram", (F.col("n") == 1).alias("open"), "crowded", "one.*"), "wanted")
    dropped(some, kinds, copies, unclear)
    freed(docs)
    return clear, wanted


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, units: Units = BYTES, told: Search | None = None) -> DataFrame:
    """(k1, k2, spans): for rows (k1, k2, text), the ranges of units that repeated strings cover, not yet merged.

    With `told`, which is searched for beside, its ranges are in `passages`. Rows without any are left out.
    """
    searches = [Search(units, length, gram, length if units is BYTES else 0), *([told] if told else [])]
    clear, wanted = zip(*[_narrowed(docs, s, crowd) for s in searches])
    all_of = lambda each: reduce(DataFrame.unionByName, [t.withColumn("search", F.lit(n)) for n, t in enumerate(each)])
    rows = stored(_contexts(docs, all_of(wanted), searches), "contexts")
    dropped(*wanted)
    freed(docs)
    crowded = [_crowded(rows.where((F.col("search") == n) & F.col("crowded")), s.units, s.length) for n, s in enumerate(searches)]
    resolved = [_sorted_groups(rows.where((F.col("search") == n) & ~F.col("crowded")), s.units, s.length) for n, s in enumerate(searches)]
    found = stored(all_of([a.union(b).union(c) for a, b, c in zip(clear, resolved, crowded)]), "found")
    dropped(*clear, rows, *crowded)
    freed(docs)
    ranges = [F.collect_set(F.when(F.col("search") == n, F.struct("low", "high"))).alias(name) for n, name in zip(range(len(searches)), ("spans", "passages"))]
    return found.groupBy(*ROW).agg(*ranges)  # a text's own; grouped by the keys that the texts are joined by, so it is moved once


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


DEDUPED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, passage_words bigint, kept binary"


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, passage: int | None = None, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """For every row: size, removed bytes and runs, hash of the rest, repeated passages and their words, the rest as bytes (`kept`).

    Passages are maximal runs of words that strings of `passage` words cover which also start elsewhere; they are told, not
    removed (null without `passage`).

    Texts are UTF-8 bytes, null counts as empty; matches never cross rows. Rows that repeat, with or without equal doc_id, are
    different places, so their long strings repeat. Null doc_ids are kept. Texts of any length are read whole. An empty table
    gives an empty result. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    told = Search(WORDS, passage, passage_gram, 2 * passage - 1) if passage else None
    spans = repeated_spans(rows.where(F.octet_length("text") >= (min(length, told.least) if told else length)).select(*ROW, "text"), length, gram, crowd, told=told)
    passages = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    if told:
        passages = F.coalesce("passages", F.array().cast("array<struct<low:bigint,high:bigint>>"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, own, said in zip(batch["doc_id"], batch["text"], batch["spans"], batch["passages"]):
                data = text.encode("utf-8", "surrogatepass")
                runs = _merged(own) if own is not None else []
                at, kept = 0, []
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                told = _merged(said) if said is not None else None
                out.append((doc, len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), None if told is None else len(told), None if told is None else sum(b - a for a, b in told), rest))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DEDUPED.split(", ")]).astype({c: "Int64" for c in ("doc_id", "n_passages", "passage_words")})

    return rows.join(spans.hint("shuffle_hash"), ROW, "left").select("doc_id", "text", "spans", passages.alias("passages")).mapInPandas(cut, DEDUPED)
