"""Sharding by proportional stratified interleaving.

Rows get a seeded pseudo-random order within their source. A row's fractional rank is (rank - 1/2) / rows of its source.
Sorted by that rank, every stretch of the corpus holds the sources in their global proportions, so cutting the order into
equal stretches gives shards that all match the mixture, with row counts at most one apart.

Both ranks come from counts per bucket plus a row number inside the bucket. Buckets split a source by its own shuffle hash,
so a source with a third of all rows is spread over `buckets` groups, and no sort ever needs one source in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored, whole

#: Groups of a source and of the global order are 2 ** BUCKET_BITS, and more where they would hold over BUCKET_ROWS rows.
BUCKET_BITS = 10
BUCKET_ROWS = 1 << 20


def interleave(docs: DataFrame, n_shards: int = 40, seed: str = "interleave-1", bucket_bits: int | None = None) -> DataFrame:
    """Assign every row to a shard; returns doc_id, source, size, text_crc32, position, shard, slot.

    Null text counts as empty (size 16, CRC 0); null source is a stratum of its own; null or repeated doc_id are allowed
    (rows without doc_id are dealt by their place in the table; rows equal in every ordering column are interchangeable). Ties
    of the shuffle go by doc_id, CRC and size. Texts of any length are read whole. An empty table gives an empty result. Other
    columns are ignored, so their names cannot clash. `bucket_bits` sets the groups per source and of the global order
    (2 ** bits); without it they follow from the number of rows.
    """
    if bucket_bits is None:
        bucket_bits = max(BUCKET_BITS, (docs.count() // BUCKET_ROWS).bit_length())
    text = F.encode(whole(), "UTF-8")
    stratum = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = docs.select(
        "doc_id", "source", (F.octet_length(whole()) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        stratum.alias("stratum"), F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()), whole()).alias("mix"),
    ).withColumn("bucket", F.shiftrightunsigned("mix", 64 - bucket_bits))
    rows = stored(rows, "shard-rows")

    within = ["stratum", "bucket"]
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*within).agg(F.count(F.lit(1)).alias("n")).select(
        *within, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("stratum")).alias("stratum_rows"),
    )
    tie = ["mix", "doc_id", "text_crc32", "size"]
    ranked = rows.join(starts, within).withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy(*within).orderBy(*tie)))
    ranked = ranked.withColumn("fraction", (F.col("rank") - 0.5) / F.col("stratum_rows"))
    ranked = stored(ranked.select("doc_id", "source", "size", "text_crc32", "stratum", "mix", "fraction", F.floor(F.col("fraction") * (1 << bucket_bits)).alias("stretch")), "shard-ranks")
    dropped(rows)

    # at most 2 ** bucket_bits rows reach this window
    stretches = ranked.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).select(
        "stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    order = Window.partitionBy("stretch").orderBy("fraction", "stratum", *tie)
    placed = ranked.join(stretches, "stretch").withColumn("position", F.col("first") + F.row_number().over(order) - 1)
    placed = placed.withColumn("shard", F.expr(f"position * {n_shards} div total").cast("int"))
    return placed.select(
        "doc_id", "source", "size", "text_crc32", "position", "shard",
        (F.col("position") - F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")).alias("slot"),
    )
