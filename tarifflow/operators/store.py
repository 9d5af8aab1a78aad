"""Constraints, conflict rules and de-duplication over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def active_once(items: DataFrame, order: list[Column], keys=("partner_id", "service_name_raw", "effective_date")) -> DataFrame:
    """One active row for each key; rows that aren't active or lack a key column never collide."""
    binding = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.coalesce("is_active", F.lit(False)))
    ranked = items.withColumn("_binding", binding)
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return ranked.where("_binding").withColumn("_n", number).where("_n = 1").drop("_n", "_binding").unionByName(ranked.where("NOT _binding").drop("_binding"))


def insert_new(target: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """`target` with the rows whose key it doesn't hold yet; of rows with one key, one."""
    return target.unionByName(rows.dropDuplicates(list(keys)).join(target, list(keys), "left_anti").select(*target.columns))


def cascade(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is there."""
    return child.join(parent, key, "left_semi").select(*child.columns)


def set_null(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """All rows; a key without parent becomes null."""
    there = parent.select(F.col(key)).distinct().withColumn("_there", F.lit(True))
    kept = [F.when(F.col("_there"), F.col(key)).alias(key) if c == key else F.col(c) for c in child.columns]
    return child.join(there, key, "left").select(*kept)


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def set_match(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with service_id and match_confidence from (item_id, service_id, match_confidence) where decided."""
    new = decisions.select("item_id", F.col("service_id").alias("_s"), F.col("match_confidence").alias("_c"))
    changed = {"service_id": F.coalesce("_s", "service_id"), "match_confidence": F.coalesce("_c", "match_confidence")}
    return items.join(new, "item_id", "left").select(*(changed[c].alias(c) if c in changed else F.col(c) for c in items.columns))
