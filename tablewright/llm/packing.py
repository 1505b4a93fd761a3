"""Best-fit packing of token sequences by the sum-of-squares rule.

A piece goes to the open bin where the sum over residual gaps of (open bins with that gap) squared becomes smallest; a new bin
is opened only where no open one has room. The rule keeps the open bins spread over many different gaps, so that later pieces
find an exact fit. (With a new bin as one more choice, as for endless streams, about 2 % more bins result on sorted pieces.)

Pieces are dealt by a hash of doc_id into groups of about `GROUP` pieces. Each group is packed on its own, in decreasing
length, so memory is bounded and a lost task repeats exactly; a group leaves only its last few bins partly empty.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole
from .tokens import encoder

CAPACITY = 2048
GROUP = 50_000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the token ids of a text, then id 0, cut into pieces of `capacity`; the first may be shorter.

    Null text counts as empty and gives the one id 0. Every row gives its pieces, repeated doc_ids included.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = known.ids(text) + b"\0\0\0\0"
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    end = at + ((n - 1) % capacity + 1 if at == 0 else capacity)
                    rows.append((doc, piece, at, end - at, zlib.crc32(memoryview(ids)[4 * at : 4 * end])))
                    at, piece = end, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInPandas(cut, PIECE)


class SumOfSquares:
    """Open bins by residual gap; add() returns (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.bins = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)

    def add(self, length: int) -> tuple[int, int]:
        c, n = self.capacity, self.count
        # change of the sum of squares when a bin of gap g (length..c-1) gets the piece; a closed bin has gap 0 and doesn't count
        gaps = n[length:c]
        change = np.where(gaps > 0, 2 - 2 * gaps, 1 << 60)
        if len(change):
            change[1:] += 2 * n[1 : c - length]
            change[0] -= 1
        g = int(change.argmin()) + length if len(change) else c
        if g == c or n[g] == 0:
            at, g = self.bins, c
            self.bins += 1
        else:
            at = self.open[g].pop()
            n[g] -= 1
        if g > length:
            n[g - length] += 1
            self.open[g - length].append(at)
        return at, c - g


def pack(cut: DataFrame, n_pieces: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Place every piece: adds sequence_id and offset. An empty table gives an empty result."""

    groups = max(1, round(n_pieces / group))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, base = SumOfSquares(capacity), None
        for batch in batches:
            base = int(batch["_group"].iloc[0]) << 40 if base is None and len(batch) else base
            if len(batch) and int(batch["_group"].iloc[0]) << 40 != base or batch["_group"].nunique() > 1:
                for number, part in batch.groupby("_group", sort=True):
                    if number << 40 != base:
                        packer, base = SumOfSquares(capacity), int(number) << 40
                    yield _placed(part, packer, base)
            else:
                yield _placed(batch, packer, base)

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "piece", "ids_crc32"), F.lit(groups)))
    dealt = dealt.repartition(groups, "_group").sortWithinPartitions("_group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInPandas(place, PIECE + ", sequence_id bigint, offset bigint")


def _placed(rows: pd.DataFrame, packer: SumOfSquares, base: int) -> pd.DataFrame:
    where = [packer.add(int(n)) for n in rows["length"]]
    rows = rows.drop(columns="_group")
    rows["sequence_id"] = np.array([b for b, _ in where], np.int64) + (base or 0)
    rows["offset"] = np.array([o for _, o in where], np.int64)
    return rows.astype({"doc_id": "Int64"})


def best_fit(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Tokenise, cut and pack whole documents of any length. Only doc_id and text are read, so other columns cannot clash.

    Null and empty texts are one token; rows that repeat are packed each. Pieces of equal length go in the order of doc_id and
    piece; of gaps that suit equally, the smallest is taken. An empty table gives an empty result.
    """
    cut = stored(pieces(docs, vocabulary, capacity), "pieces")
    return pack(cut, cut.count(), capacity, group)
