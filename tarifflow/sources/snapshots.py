"""Tables as versions: new files are written first, then one manifest that says which files count.

A table's rows lie in folders of a write, by bucket of their key.  A manifest lists the
writes and, of each, the buckets that still count.  A version is there once its manifest
has been renamed to its number, which fails if another writer took that number: the one
who comes second reads again and tries again.  A write that fails leaves files that no
manifest names, and changes nothing.  Readers see one version throughout.

The store has to refuse a rename onto a file that exists, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shuffle_files_go

BUCKETS = 16


class Conflict(Exception):
    """Another writer was first with this version."""


@dataclass(frozen=True)
class Part:
    """What still counts of a write."""

    write: str
    buckets: tuple[int, ...]


@dataclass(frozen=True)
class Table:
    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...]
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last one; 0 before the first."""
        folder, files = self._file("")
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def parts(self, version: int) -> list[Part]:
        if not version:
            return []
        text = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0]
        return [Part(p["write"], tuple(p["buckets"])) for p in json.loads(text)["parts"]]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given; only those of some buckets if given, of others no file is read."""
        found = self.spark.createDataFrame([], f"{self.schema}, bucket int")
        for part in self.parts(self.version() if version is None else version):
            wanted = [b for b in part.buckets if buckets is None or b in buckets]
            if wanted:
                rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/data/{part.write}")
                found = found.unionByName(rows.where(F.col("bucket").isin(wanted)))
        return found.drop("bucket")

    def added(self, version: int) -> DataFrame:
        """The rows that `append` stored with a version."""
        part = self.parts(version)[-1:]
        schema = f"{self.schema}, bucket int"
        rows = self.spark.createDataFrame([], schema)
        return (rows.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/data/{part[0].write}")) if part else rows).drop("bucket")

    def stage(self, rows: DataFrame) -> Part:
        """Write rows that count once a version names them."""
        write = uuid.uuid4().hex
        # each task writes to all buckets, so rows needn't be dealt out first
        with shuffle_files_go(self.spark):
            rows.withColumn("bucket", self.bucket()).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/{write}")
        # as many values as there are buckets at most
        found = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/data/{write}").select("bucket").distinct().collect()
        return Part(write, tuple(sorted(r[0] for r in found)))

    def commit(self, base: int, parts: list[Part], last: bool = False) -> int:
        """The version after `base` has these parts, the last even if it has no rows if asked for; Conflict if there is one already."""
        text = json.dumps({"parts": [{"write": p.write, "buckets": p.buckets} for p in parts if p.buckets or last and p is parts[-1]]})
        draft, files = self._file(f".{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        refuse = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._file(f"{base + 1}.json")[0], refuse)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"version {base + 1} of {self.path}") from error
            raise
        return base + 1

    def append(self, base: int, rows: DataFrame) -> int:
        return self.commit(base, [*self.parts(base), self.stage(rows)], last=True)

    def replace(self, base: int, rows: DataFrame, buckets: list[int]) -> int:
        """Rows in place of all that these buckets held."""
        return self.swap(base, [self.stage(rows)], buckets)

    def swap(self, base: int, staged: list[Part], buckets: list[int]) -> int:
        """Staged rows in place of all that these buckets held."""
        kept = [Part(p.write, tuple(b for b in p.buckets if b not in buckets)) for p in self.parts(base)]
        return self.commit(base, [*kept, *staged])

    def compact(self, base: int) -> int:
        """The same rows in one write."""
        return self.commit(base, [self.stage(self.read(base))])
