"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and driver and executors are one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session while something runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _shuffle_files_go(spark: SparkSession):
    """What is written here is read from its table later, so the shuffle files behind it go when the job ends instead of when the driver next collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch:
    """Tables written to the shared folder; each cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[DataFrame] = []

    @contextmanager
    def passing(self):
        """Tables written within go at the end, also of a run that fails, but for those given to what is yielded."""
        first, stay = len(self.tables), []
        try:
            yield stay.append
        finally:
            self.drop(*(t for t in self.tables[first:] if not any(t is s for s in stay)))

    def _path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self._path()
        with _shuffle_files_go(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables.append(out)
        return out

    def bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """A table dealt by `column`, so that joins on it bring the other side here. Has to be dropped: it is listed in the catalogue."""
        path, name = self._path(), f"scratch_{uuid.uuid4().hex}"
        buckets = max(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        try:
            with _shuffle_files_go(self.spark):
                df.write.bucketBy(min(buckets, 100_000), column).sortBy(column).option("path", path).saveAsTable(name)
        except BaseException:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            raise
        out = self.spark.table(name)
        out._scratch_path, out._scratch_name = path, name
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later result reads."""
        self.tables = [t for t in self.tables if not any(t is gone for gone in tables)]
        for table in tables:
            if hasattr(table, "_scratch_name"):
                self.spark.sql(f"DROP TABLE IF EXISTS {table._scratch_name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
