"""Runs of words that repeat with a period, by block matching, and texts with the repeats taken out.

A run is a stretch of at least `LEAST` words and two periods whose words one period apart are equal, that no neighbouring word
extends, told with its smallest period q. In such a stretch max(q, LEAST - q) words in a row, or more, are met again q words
later, and among 2 b - 1 words in a row there is a whole block that starts at a multiple of b. So each scale b, a power of two,
serves the periods for which 2 b - 1 words in a row are certain: aligned blocks of b words are keys (integer sequences) of an
Aho-Corasick automaton that searches the document, and an occurrence at a distance that the scale serves seeds an exact extension
to both sides. A block can only have one if each of its words comes again within the greatest of those distances; other
blocks need no key. No pair of equal words is listed, and a stretch is extended once for each period that is no multiple of
one that it is known to have.

Documents are independent, so this is one pass over the table, and a task holds one batch of texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

#: Words of the shortest run.
LEAST = 12
_FAR = 1 << 40
#: White space that parts words: space and tab to carriage return.
_SPACE = "[\\x20\\x09-\\x0D]+"
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _scale(period: int) -> int:
    """The largest power of two b with 2 b - 1 words in a row that are met again one period later, in any run of that period."""
    return 1 << ((max(period, LEAST - period) + 1) // 2).bit_length() - 1


#: The scales whose periods are not simply 2 b - 1 to 4 b - 2.
_SMALL = {b: frozenset(q for q in range(1, 2 * LEAST) if _scale(q) == b) for b in sorted({_scale(q) for q in range(1, LEAST)})}


def _served(b: int) -> frozenset[int] | range:
    """The periods of a scale."""
    return _SMALL[b] if b in _SMALL and max(_SMALL[b]) < 2 * LEAST - 1 else range(2 * b - 1, 4 * b - 1)


def _gaps(ids: np.ndarray) -> np.ndarray:
    """For each word the distance to the next equal one."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), _FAR)
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    out[order[again]] = order[again + 1] - order[again]
    return out


def _ahead(raw: bytes, a: int, b: int, most: int) -> int:
    """How many words after places a and b are equal, `most` at most; steps double until one differs, then halve."""
    k, step, grow = 0, 8, True
    while k < most:
        m = min(step, most - k)
        if raw[4 * (a + k) : 4 * (a + k + m)] == raw[4 * (b + k) : 4 * (b + k + m)]:
            k, step = k + m, step * 2 if grow else step
        elif m == 1:
            break
        else:
            step, grow = m // 2, False
    return k


def _behind(raw: bytes, a: int, b: int, most: int) -> int:
    """How many words before places a and b are equal."""
    k, step, grow = 0, 8, True
    while k < most:
        m = min(step, most - k)
        if raw[4 * (a - k - m) : 4 * (a - k)] == raw[4 * (b - k - m) : 4 * (b - k)]:
            k, step = k + m, step * 2 if grow else step
        elif m == 1:
            break
        else:
            step, grow = m // 2, False
    return k


def _seeds(ids: list[int], keyed: Iterable[int], b: int) -> Iterator[tuple[int, int]]:
    """(place, distance) of the aligned blocks that occur again at a distance that the scale serves."""
    places: dict[tuple[int, ...], list[int]] = {}
    for p in keyed:
        places.setdefault(tuple(ids[p : p + b]), []).append(p)
    search = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, at in places.items():
        search.add_word(key, at)
    search.make_automaton()
    served = _served(b)
    most = max(served)
    for end, at in search.iter(tuple(ids)):
        again = end - b + 1
        for i in range(bisect_left(at, again - most), bisect_left(at, again)):
            if again - at[i] in served:
                yield at[i], again - at[i]


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of integers, by start, then period.

    Fewer than `LEAST` words have none.
    """
    n = len(ids)
    if n < LEAST:
        return []
    gap = _gaps(ids)
    raw, listed = ids.astype("<i4").tobytes(), None
    found: dict[tuple[int, int], int] = {}
    known_end, known_period = np.zeros(n, np.int64), np.ones(n, np.int64)  # of a run over each place, the one that ends last
    scales, b = sorted(_SMALL), max(_SMALL)
    while 4 * b - 1 <= n // 2:
        scales.append(b := 2 * b)
    for b in scales:
        worst = gap[: n // b * b].reshape(-1, b).max(axis=1)
        most = max(_served(b))
        keyed = np.flatnonzero(worst <= most) * b
        # within a run of a period of b words or fewer, a block only occurs at multiples of its smallest period
        keyed = keyed[(known_period[keyed] > b) | (known_end[keyed] < np.minimum(keyed + most + b, n))]
        if not len(keyed):
            continue
        listed = listed or ids.tolist()
        last: dict[int, tuple[int, int]] = {}
        new: list[tuple[int, int, int]] = []
        for p, q in _seeds(listed, keyed.tolist(), b):
            first, past = last.get(q, (0, 0))
            if first <= p and p + q + b <= past or p + q + b <= known_end[p] and q % known_period[p] == 0:
                continue
            first, past = p - _behind(raw, p, p + q, p), p + q + _ahead(raw, p, p + q, n - p - q)
            last[q] = first, past
            if past - first >= max(LEAST, 2 * q) and found.get((first, past), _FAR) > q:
                found[first, past] = q
                new.append((first, past, q))
                if q <= LEAST or past - first >= 4 * q:  # long beside its period: its multiples would be tried within this scale
                    _know(known_end, known_period, first, past, q)
        for first, past, q in new:
            _know(known_end, known_period, first, past, q)
    return sorted((first, past - first, q) for (first, past), q in found.items())


def _know(known_end: np.ndarray, known_period: np.ndarray, first: int, past: int, q: int) -> None:
    at = first + np.flatnonzero(known_end[first:past] < past)
    known_end[at], known_period[at] = past, q


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: a run keeps its first period, and a word that any run drops goes."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    last = dict(zip(words, range(len(words))))
    return np.fromiter(map(last.__getitem__, words), np.int64, len(words))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        counts, found_in, texts = [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = text.split()
            found = runs(numbered(words))
            stays = kept(len(words), found) if found else None
            counts.append(len(words))
            found_in.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            texts.append(b" ".join(words if stays is None else [w for w, k in zip(words, stays) if k]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(found_in, pa.list_(run)), pa.array(texts, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
        )


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of documents: its runs by start, then period, and the words that stay.

    A null text is an empty one: no words, no runs, an empty text. A null doc_id stays null; rows that repeat an id or a text
    are told each for itself; other columns take no part. An empty table gives none. A text is handled whole, in memory for
    its words and, for each scale, for the blocks whose words come again in time.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(_batches, FOUND)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, told by their id, get periods: from word a on, the p words there again and again.

    h = crc32 of the id as text; h % 10 = 0 marks such a document, and g = h div 10 gives a = g % n and
    p = 1 + (n - a) div (3 + g % 8) for n words. Documents without words and rows without id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parts = docs.select("doc_id", whole().alias("text"), F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    words = F.when(F.col("g").isNotNull(), F.array_remove(F.split("text", _SPACE), ""))
    parts = parts.withColumn("words", words).withColumn("n", F.size("words"))
    parts = parts.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    times = (F.col("g") % 8 + 3).cast("int")
    p = (F.floor(rest / times) + 1).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, p), times))
    again = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), rest)), " ")
    return parts.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run of each document (ties: least start, then period) and SHA-256 digests of all runs and of what stays."""
    ordered = F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))
    best = F.array_max(ordered)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))))
    out = found.withColumn("best", best)
    sha: Column = F.sha2(listed.cast("binary"), 256)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"), sha.alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
