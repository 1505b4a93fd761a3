"""Tables in buckets of a hashed key, loaded in batches of which each reads and rewrites only the buckets that it touches.

A table is a folder. `data/<version>-<batch>-<id>/_bucket=<n>` holds rows, `manifest/<version>.json` says which folder each bucket has
and which batches are in. A load merges some buckets at a time; a version appears by one rename of its manifest, so readers see a batch whole or not at all, a
batch that died before leaves only files that nothing names, and readers of earlier versions are not disturbed until
`vacuum`. A manifest has an entry for each bucket and for each gap in the batch numbers, so it does not grow with the rows.
One writer at a time.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import delete, tidy

#: Rows that one job of a load merges, but for those of a single bucket, and rows that one task merges.
AT_ONCE = 2_000_000
TASK = 250_000


@dataclass(frozen=True)
class Load:
    """What a batch did: buckets it rewrote, of how many, and the rows of the table that it read for that."""

    batch: int
    replayed: bool
    touched: int
    buckets: int
    rows_read: int


def _with(ranges: list[list[int]], n: int) -> list[list[int]]:
    """Ranges [first, last] of whole numbers with n among them."""
    out: list[list[int]] = []
    for lo, hi in sorted([*ranges, [n, n]]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


class BucketedTable:
    """One row for each key: of several, the one whose other columns, in their order, are least (or greatest).

    So the table follows from the set of its batches alone: late, repeated and overlapping batches in any order give equal
    tables. `by` are key columns whose hash names the bucket. Rows with a null in the key count as a key like any other. An empty batch
    is recorded and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], by: list[str] | None = None, buckets: int = 64, keep: str = "least"):
        if keep not in ("least", "greatest"):
            raise ValueError("keep is least or greatest")
        self.spark, self.path, self.schema, self.key, self.by, self.buckets, self.keep = spark, path.rstrip("/"), schema, key, by or key, buckets, keep

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def manifest(self, version: int | None = None) -> dict:
        """The named version, or the last; an empty one before the first batch."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "of": self.buckets, "buckets": {}, "batches": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        draft, fs = self._path(f"manifest/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final, _ = self._path(f"manifest/{manifest['version']:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer published version {manifest['version']} of {self.path}")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = manifest["buckets"] if buckets is None else {str(b): manifest["buckets"][str(b)] for b in buckets if str(b) in manifest["buckets"]}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{folder}/_bucket={b}" for b, folder in wanted.items()])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _dealt(self, seed: int, columns: list[str], parts: int) -> Column:
        """A number below parts by the columns' text; -0.0 goes where 0.0 goes, its equal."""
        kinds = {f.name: f.dataType.typeName() for f in self.schema.fields}
        texts = [(F.col(c) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c)).cast("string") for c in columns]
        return F.pmod(F.xxhash64(*[F.lit(seed)] * bool(seed), *texts), F.lit(parts)).cast("int")

    def _one(self, rows: DataFrame, place: list[str]) -> DataFrame:
        """One row for each key, with the columns that tell its place, by which rows are shuffled already."""
        rest = [f.name for f in self.schema.fields if f.name not in self.key]
        if not rest:
            return rows.select(*place, *self.key).distinct()
        best = (F.min if self.keep == "least" else F.max)(F.struct(*rest)).alias("_best")
        return rows.groupBy(*place, *self.key).agg(best).select(*place, *self.key, "_best.*").select(*place, *self.schema.fieldNames())

    def _written(self, rows: DataFrame, path: str) -> None:
        """Rows by bucket. Keys are mostly digests in hexadecimal: zstd halves them, and a larger dictionary holds those that come again."""
        rows.write.partitionBy("_bucket").option("compression", "zstd").option("parquet.dictionary.page.size", 4 << 20).mode("append").parquet(path)

    def _merge(self, known: dict, staged: str, touched: list[int], rows_read: int, bucket: Column, path: str) -> None:
        """The touched buckets of the known version with the staged rows, some buckets a job; what is merged is no longer staged.

        Rows are shuffled once, by their bucket and a part of it, and the disk that takes is given back after each job.
        """
        new = lambda some: self.spark.read.schema(self.schema).parquet(*[f"{staged}/_bucket={b}" for b in some])
        total = rows_read + new(touched).count()  # counted from the files' footers
        parts = math.ceil(total / len(touched) / TASK)
        step = math.ceil(len(touched) / math.ceil(total / AT_ONCE))
        for i in range(0, len(touched), step):
            some = touched[i : i + step]
            rows = self._rows(known, some).unionByName(new(some)).withColumns({"_bucket": bucket, "_part": self._dealt(1, self.key, parts)})
            self._written(self._one(rows.repartition(len(some) * parts, "_bucket", "_part"), ["_bucket", "_part"]).drop("_part"), path)
            for b in some:
                delete(self.spark, f"{staged}/_bucket={b}")

    def load(self, rows: DataFrame, batch: int) -> Load:
        """Add a batch, known by its number; a number that is in already changes nothing."""
        with tidy(self.spark):
            return self._load(rows, batch)

    def _load(self, rows: DataFrame, batch: int) -> Load:
        known = self.manifest()
        of = known["of"]
        if any(lo <= batch <= hi for lo, hi in known["batches"]):
            return Load(batch, True, 0, of, 0)
        bucket = self._dealt(0, self.by, of)
        version, name = known["version"] + 1, uuid.uuid4().hex
        staged = f"{self.path}/staged/{name}"
        self._written(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn("_bucket", bucket), staged)
        p, fs = self._path(f"staged/{name}")
        touched = sorted(int(m[1]) for s in fs.listStatus(p) if (m := re.fullmatch(r"_bucket=(\d+)", s.getPath().getName())))
        old = self._rows(known, touched)
        folder = f"{version:012d}-{batch}-{name}"
        rows_read = old.count()  # counted from the files' footers
        if touched:
            self._merge(known, staged, touched, rows_read, bucket, f"{self.path}/data/{folder}")
        self._publish({"version": version, "of": of, "buckets": known["buckets"] | {str(b): folder for b in touched}, "batches": _with(known["batches"], batch)})
        fs.delete(p, True)
        return Load(batch, False, len(touched), of, rows_read)

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests before the last `keep` and the files that no kept one names; gives the number of deleted folders."""
        kept = self.versions()[-keep:]
        named = {f"{folder}/_bucket={b}" for v in kept for b, folder in self.manifest(v)["buckets"].items()}
        data, fs = self._path("data")
        gone = 0
        for load in fs.listStatus(data) if fs.exists(data) else []:
            parts = [s.getPath() for s in fs.listStatus(load.getPath()) if s.getPath().getName().startswith("_bucket=")]
            dead = [x for x in parts if f"{load.getPath().getName()}/{x.getName()}" not in named]
            for x in [load.getPath()] if len(dead) == len(parts) else dead:
                fs.delete(x, True)
            gone += len(dead)
        for v in self.versions()[:-keep]:
            fs.delete(self._path(f"manifest/{v:012d}.json")[0], False)
        return gone
