"""Training-corpus pipeline: each stage reads all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import stages

#: (name, function); each function takes (spark, docs, sf_dir).
STAGES = stages.STAGES

#: Rule weights and packing have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's result written and read again."""
    return stages.run(spark, sf_dir)
