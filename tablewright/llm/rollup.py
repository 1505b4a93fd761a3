"""Token counts as delta-maintained rollups.

Every change of a document is one or two signed rows: an insert adds its count, a delete takes it away, a revision does both.
A batch of changes is summed by source, language and tokenizer version, and its sums are published under the batch's name by
one rename: whole, or not at all, and once. A batch that runs again, after a failure or by mistake, changes nothing. Totals are
sums over the published batches, so no document is ever counted again. `compact` replaces batches by one table of totals and
one of their names, published by one rename as well.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole
from .tokens import encoder

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, docs bigint, tokens bigint"
WORDS = "words_v1"


def counted(changes: DataFrame, vocabularies: dict[str, str]) -> DataFrame:
    """Signed rows (sign, source, lang, tokenizer_version, tokens) of changes (sign, source, lang, text).

    Versions are those of `vocabularies` (name to vocabulary file) and `words_v1`, the number of runs between white space.
    Null text counts as empty, with 0 tokens; null source or language is a group of its own. Rows that repeat each count. Texts
    of any length are encoded whole. An empty table gives no rows. Only the four named columns are read.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoders = {name: encoder(path) for name, path in vocabularies.items()}
        for batch in batches:
            for name, known in encoders.items():
                yield batch.assign(tokenizer_version=name, tokens=[len(known.ids(t)) // 4 for t in batch["text"]]).drop(columns="text")

    rows = changes.select(F.col("sign").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), whole().alias("text"))
    words = F.size(F.filter(F.split(F.translate("text", "\t\n\u000b\f\r", "     "), " "), lambda w: w != "")).cast("long")
    plain = rows.select("sign", "source", "lang", F.lit(WORDS).alias("tokenizer_version"), words.alias("tokens"))
    return plain.unionByName(rows.mapInPandas(count, "sign bigint, source string, lang string, tokenizer_version string, tokens bigint")) if vocabularies else plain


def signed(log: DataFrame) -> DataFrame:
    """Signed rows (sign, source, lang, text) of a change log (op, source, lang, text, old_source, old_lang, old_text).

    op is insert, delete or revise; a delete reads the old columns, an insert the new ones, a revision both. Other ops, and
    null, change nothing.
    """
    new = log.where(F.col("op").isin("insert", "revise")).select(F.lit(1).alias("sign"), "source", "lang", "text")
    old = log.where(F.col("op").isin("delete", "revise")).select(F.lit(-1).alias("sign"), F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_text").alias("text"))
    return new.unionByName(old)


class TokenRollup:
    """The rollup in a folder that driver and executors share, on a file system whose rename is atomic.

    batches/<key> holds the sums of a batch, generations/<number> totals and the keys of all batches that they contain. Either
    folder is written elsewhere and renamed when it is whole, which only one writer can do, so there is no half commit.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        for name in ("batches", "generations"):
            self._fs.mkdirs(self._hadoop(f"{self.path}/{name}"))

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(f"{self.path}/{folder}"))]

    def _publish(self, written: str, name: str) -> bool:
        """Rename a whole folder to its place; False, with the folder deleted, if the place is taken."""
        try:
            self._files.rename(self._hadoop(written), self._hadoop(f"{self.path}/{name}"), self._options)
        except Exception as error:
            if self._fs.exists(self._hadoop(f"{self.path}/{name}")):
                self._fs.delete(self._hadoop(written), True)
                return False
            raise error
        return True

    def _generation(self) -> int:
        """The latest generation; 0 if there is none. Older ones are deleted, so the list is short."""
        return max(map(int, self._names("generations")), default=0)

    def _compacted(self, generation: int) -> DataFrame:
        """(batch) keys in a generation's totals."""
        return self.spark.read.schema("batch string").parquet(f"{self.path}/generations/{generation}/names")

    def committed(self, batch: str) -> bool:
        # the batch's folder goes only after a generation with its key is there, so this order misses none
        if self._fs.exists(self._hadoop(f"{self.path}/batches/{_key(batch)}")):
            return True
        now = self._generation()
        return now > 0 and not self._compacted(now).where(F.col("batch") == _key(batch)).isEmpty()

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add the signed rows of counted() under the batch's name; False, with no effect, if it was committed before."""
        if self.committed(batch):
            return False
        written = f"{self.path}/written/{uuid.uuid4().hex}"
        sums = rows.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        sums.withColumn("batch", F.lit(_key(batch))).coalesce(1).write.parquet(written)  # a row for each group, already summed by every task
        return self._publish(written, f"batches/{_key(batch)}")

    def _live(self) -> tuple[int, DataFrame]:
        """The latest generation and the rows of the batches that it lacks."""
        rows = self.spark.createDataFrame([], f"{DELTA}, batch string")
        if names := self._names("batches"):  # as many as came since the last compaction
            rows = self.spark.read.schema(rows.schema).parquet(*[f"{self.path}/batches/{n}" for n in names])
        now = self._generation()
        return now, rows.join(self._compacted(now), "batch", "left_anti") if now else rows

    def _summed(self, now: int, live: DataFrame) -> DataFrame:
        rows = live.drop("batch")
        if now:
            rows = rows.unionByName(self.spark.read.schema(DELTA).parquet(f"{self.path}/generations/{now}/totals"))
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens; groups whose documents are all gone are left out."""
        return self._summed(*self._live())

    def compact(self) -> bool:
        """Sum the live batches into a new generation; totals and the memory of batch names stay as they are.

        Of two compactions at once one takes effect; the other returns False, as does one without live batches.
        """
        now, live = self._live()
        if live.isEmpty() and not self._names("batches"):
            return False
        written = f"{self.path}/written/{uuid.uuid4().hex}"
        names = live.select("batch").distinct()
        stored = names.unionByName(self._compacted(now)) if now else names
        self._summed(now, live).coalesce(1).write.parquet(f"{written}/totals")
        stored.write.parquet(f"{written}/names")
        if not self._publish(written, f"generations/{now + 1}"):
            return False
        for old in self._names("generations"):
            if int(old) <= now:
                self._fs.delete(self._hadoop(f"{self.path}/generations/{old}"), True)
        for row in self._compacted(now + 1).where(F.col("batch").isin(self._names("batches"))).collect():  # batches since the last compaction
            self._fs.delete(self._hadoop(f"{self.path}/batches/{row.batch}"), True)
        return True


def _key(batch: str) -> str:
    return hashlib.sha256(batch.encode("utf-8", "surrogatepass")).hexdigest()
