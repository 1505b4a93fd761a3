"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lines, neardup, packing, quality
from .common import dropped, read, stored
from .queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts, unchanged; rejected ones go."""
    return quality.accepted(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated and near-repeated lines; n_chars follows the text."""
    return lines.dedup(docs, counts=False, words_per_edit=lines.WORDS_PER_EDIT).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.representatives(docs, neardup.Scheme(shingle=5, percent=80)).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in packed sequences."""
    return packing.best_fit(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            dropped(before)
    return docs
