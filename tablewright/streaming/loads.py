"""Incremental vault and dimension loads over streams: each micro-batch runs the batch operators against the stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models
from ..sources.bucketed import BucketedTable


def _stored(spark, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def hub_stream(stream: DataFrame, name: str, key: list[str], source: str, path: str, checkpoint: str):
    """A query that appends the new business keys of every micro-batch to the hub at `path`.

    A batch writes to a folder of its own number, so a repeated batch overwrites itself and never doubles keys.
    """

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _stored(spark, path)
        old = None if old is None else old.where(F.col("batch") != number).drop("batch")
        models.hub(batch, name, key, source, F.col("LOAD_DTS"), old).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(stream: DataFrame, table: BucketedTable, stage: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A query that loads stage(micro-batch) of every micro-batch; a repeated one changes nothing, each reads the buckets that it touches."""
    return stream.writeStream.foreachBatch(lambda batch, number: table.load(stage(batch), number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key with a watermark, for change volumes of incremental loads."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), by, "n")
