"""Ingest of new files as they arrive: state stays within a file, so each batch is ingested like a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import Options, ingest_files
from ..sources.archive import files_of

TABLES = ("partners", "documents", "price_items", "issues")


def start(spark: SparkSession, source: str, target: str, checkpoint: str, options: Options = Options(), files_per_batch: int = 1000, **trigger) -> StreamingQuery:
    """Write the tables of new files under `target`, a folder for each table and batch, so that a batch run again replaces itself."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(source)

    def write(batch: DataFrame, number: int) -> None:
        tables = ingest_files(files_of(batch), options)
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
