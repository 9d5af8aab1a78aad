"""Row rules, duplicates, status roll-up and reports over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def has_positive_price(*prices: Column) -> Column:
    found = F.lit(False)
    for price in prices:
        found = found | F.coalesce(price > 0, F.lit(False))
    return found


def nonresident_below(resident: Column, nonresident: Column) -> Column:
    return F.coalesce(nonresident < resident, F.lit(False))


def row_messages(as_of: Column) -> Column:
    """(rule, message) of each rule that an item breaks, in their order; `as_of` is today."""
    name = F.coalesce("service_name_raw", F.lit(""))
    positive = has_positive_price(F.col("price_resident_kzt"), F.col("price_nonresident_kzt"), F.col("price_original"))
    rules = (
        (X.spaces(name) == "", F.concat(F.lit("empty service name in item "), F.col("item_id").cast("string"))),
        (~positive, F.concat(F.lit("no positive price: "), name)),
        (nonresident_below(F.col("price_resident_kzt"), F.col("price_nonresident_kzt")), F.concat(F.lit("nonresident < resident: "), name)),
        (F.coalesce(F.col("effective_date") > as_of, F.lit(False)), F.concat(F.lit("future price date: "), name)),
    )
    return F.array_compact(F.array(*(F.when(rule, F.struct(F.lit(k).alias("rule"), message.alias("message"))) for k, (rule, message) in enumerate(rules))))


def row_issues(items: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(doc_id, item_id, rule, message), a row per broken rule."""
    messages = row_messages(F.current_date() if as_of is None else as_of)
    return items.select("doc_id", "item_id", F.explode(messages).alias("m")).select("doc_id", "item_id", "m.rule", "m.message")


def duplicate_positions(items: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Positions of one partner with one name (any case) and date more than once; missing dates are equal.

    `within`: columns that have to be equal too, such as the document.
    """
    key = [*map(F.col, within), F.col("partner_id"), F.lower("service_name_raw").alias("name_key"), F.col("effective_date")]
    return items.groupBy(*key).agg(F.count("*").alias("n"), *([] if "doc_id" in within else [F.min("doc_id").alias("doc_id")])).where("n > 1").withColumn("message", F.concat(F.lit("duplicate position: "), "name_key"))


def issues(items: DataFrame, as_of: Column | None = None, within: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All warnings: (doc_id, kind, ordinal, message), rules before duplicates, which are looked for in each document."""
    rules = row_issues(items, as_of).select("doc_id", F.lit("warning").alias("kind"), F.lit(0).alias("part"), F.col("item_id").cast("string").alias("at"), "rule", "message")
    twice = duplicate_positions(items, within).select("doc_id", F.lit("warning").alias("kind"), F.lit(1).alias("part"), F.col("name_key").alias("at"), F.lit(0).alias("rule"), "message")
    order = W.partitionBy("doc_id").orderBy("part", "at", "rule", "message")
    return rules.unionByName(twice).select("doc_id", "kind", F.row_number().over(order).cast("bigint").alias("ordinal"), "message")


def rolled_up(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with status (errors before warnings before done) and log (warnings before errors)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "error", 1).otherwise(0).alias("k"), "ordinal", "message")))
    counts = found.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "error").alias("errors"),
        F.count_if(F.col("kind") == "warning").alias("warnings"),
        F.array_join(F.transform(ordered, lambda x: x["message"]), "\n").alias("log"),
    )
    status = F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "needs_review").otherwise("done")
    others = [c for c in documents.columns if c not in ("parse_status", "parse_log")]
    return documents.join(counts, "doc_id", "left").select(*others, status.alias("parse_status"), F.coalesce("log", F.lit("")).alias("parse_log"))


def parse_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row of totals."""
    counted = documents.agg(
        F.count("*").alias("documents_total"),
        F.count_if(F.col("parse_status") == "done").alias("documents_done"),
        F.count_if(F.col("parse_status") == "needs_review").alias("documents_need_review"),
        F.count_if(F.col("parse_status") == "error").alias("documents_error"),
    )
    return counted.crossJoin(items.agg(F.count("*").alias("items_total")))
