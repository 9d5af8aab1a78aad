"""A corpus from raw documents: language, near duplicates, test leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of documents.  Empty tables pass through every stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifflow.llm import decontaminate, hd_language, ngram_join, packing, secret_scan
from tarifflow.llm.queries import tokenizer_path
from tarifflow.llm.scratch import Scratch


def _new(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without text or without a letter go."""
    # where no language can be learned, any will do: only a letter counts
    prototypes = hd_language.train(docs.where(~hd_language.held_out())) or {"any": np.ones(hd_language.DIMENSIONS)}
    language, cosine = _new(docs, "language"), _new(docs, "cosine")
    named = hd_language.predict(docs, prototypes, prediction=language, score=cosine)
    return named.where(F.col(language) != hd_language.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Where several rows of a group have that id, or all have none, the first by digest of
    text and then by the other columns stays. Texts without words are a group if equal and of one id.
    """
    scratch = Scratch(spark, "near-duplicates")
    digest, first = _new(docs, "text_digest"), F.col("doc_id").eqNullSafe(F.col("component_id"))
    groups = scratch.keep(ngram_join.jaccard_components(docs, scratch))
    others = groups.where(~first).select(F.col("doc_id").alias("other"), F.col("text_digest").alias("other_digest")).distinct()
    kept = docs.withColumn(digest, ngram_join.text_digest()).join(others, F.col("doc_id").eqNullSafe(F.col("other")) & (F.col(digest) == F.col("other_digest")), "left_anti")
    # ids that more than one row still has
    again = scratch.keep(groups.where(first).groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("rows")).where("rows > 1").select("again"))
    if again.isEmpty():
        return kept.select(*docs.columns)
    kept = scratch.keep(kept)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    keys = groups.join(again, same, "left_semi").select(F.col("doc_id").alias("again"), F.col("text_digest").alias("again_digest"), F.coalesce("group_key", "text_digest").alias("again_group")).distinct()
    repeated = kept.join(keys, same & (F.col(digest) == F.col("again_digest")))
    row = F.struct(digest, *docs.columns)
    once = repeated.groupBy("doc_id", "again_group").agg(F.min(row).alias("again_row")).select("again_row.*").select(*docs.columns)
    return kept.join(again, same, "left_anti").select(*docs.columns).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no test item, whatever their ids: those may be missing or shared. Null texts stay."""
    digest = _new(docs, "text_sha256")
    named = docs.withColumn(digest, F.sha2(F.col("text").cast("binary"), 256))
    leaks = decontaminate.find_leaks(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=digest, id_type="string")
    return named.join(leaks.select(F.col("doc_id").alias(digest)).distinct(), digest, "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    spans, redacted = _new(docs, "spans"), _new(docs, "redacted")
    scanned = secret_scan.scan(docs, spans=spans, redacted=redacted)
    found = F.size(spans) > 0
    kept = {"text": F.col(redacted)}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(found, F.length(redacted).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return scanned.withColumns(kept).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Hyperdimensional profiles, edited leaks and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
