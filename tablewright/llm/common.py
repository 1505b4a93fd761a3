"""What the operators of this subpackage share: reading, scratch tables and UTF-8 access."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with one in so many rows of a table, or more, are dealt over SALTS groups; there can be no more than that many.
HEAVY = 2000
SALTS = 64
#: Keys of so few rows are never worth it.
CROWDED = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. In local mode, where none is named, a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", conf)
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone by the time the interpreter ends
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/tablewright-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs no recomputation.

    The files go with dropped(), or when the application ends; until then plans built on the table stay valid.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored() tables that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, t.stored_at)


def _heavy(keyed: DataFrame, count: str):
    """Whether a key of keyed, which is stored, has at least one in HEAVY of all counted rows."""
    total = keyed.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    return (F.col(count) * HEAVY >= total) & (F.col(count) > CROWDED)


def heavy_join(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, hashed: bool = False) -> DataFrame:
    """rows joined with keyed, which is stored and has one row for each key, with the number of rows of that key in `count`.

    Heavy keys, which are HEAVY at most, are told to every task and dealt over SALTS groups, so their rows are not brought
    together. With hashed, which is for a keyed of few short columns, each task holds its part of it in memory and rows need no sorting.
    """
    heavy = _heavy(keyed, count)
    hot = F.broadcast(keyed.where(heavy).select(*on, F.lit(True).alias("_hot")))
    plain = [F.col(c) for c, kind in rows.dtypes if "<" not in kind]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*plain), F.lit(SALTS))).otherwise(0)
    dealt = rows.join(hot, on, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    copies = keyed.withColumn("_salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies.hint("shuffle_hash") if hashed else copies, [*on, "_salt"]).drop("_salt")


def heavy_anti(rows: DataFrame, keyed: DataFrame, on: list[str], count: str) -> DataFrame:
    """The rows whose key is not in keyed; heavy keys are told to every task."""
    heavy = _heavy(keyed, count)
    return rows.join(F.broadcast(keyed.where(heavy).select(*on)), on, "left_anti").join(keyed.where(~heavy).select(*on), on, "left_anti")


def freed(df: DataFrame) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs, which it does for plans that the JVM has collected."""
    df.sparkSession.sparkContext._jvm.System.gc()


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
