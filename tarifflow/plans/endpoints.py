"""Queries that clients ask, over the tables of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..operators import trigram_index


def services(service: DataFrame, category: str | None = None) -> DataFrame:
    return service.where(F.col("category") == category) if category is not None else service


def service_partners(items: DataFrame, partner: DataFrame, service_id) -> DataFrame:
    """Partners of a service with their active prices."""
    rows = items.where((F.col("service_id") == service_id) & F.col("is_active"))
    return rows.join(partner.select("partner_id", "name", "city"), "partner_id").select("partner_id", "name", "city", "service_id", "price_resident_kzt", "price_nonresident_kzt", "effective_date")


def partners(partner: DataFrame, city: str | None = None, is_active: bool | None = None) -> DataFrame:
    out = partner if city is None else partner.where(F.col("city") == city)
    return out if is_active is None else out.where(F.col("is_active") == is_active)


def partner_services(items: DataFrame, service: DataFrame, partner_id) -> DataFrame:
    """Services of a partner with their active prices."""
    rows = items.where((F.col("partner_id") == partner_id) & F.col("is_active"))
    return rows.join(service.select("service_id", "service_name", "category"), "service_id").select("service_id", "service_name", "category", "price_resident_kzt", "price_nonresident_kzt", "effective_date")


def named(service: DataFrame, partner: DataFrame) -> DataFrame:
    """(kind, id, name) of services and partners."""
    services = service.select(F.lit("service").alias("kind"), F.col("service_id").cast("string").alias("id"), F.col("service_name").alias("name"))
    return services.unionByName(partner.select(F.lit("partner").alias("kind"), F.col("partner_id").cast("string").alias("id"), "name"))


def search(service: DataFrame, partner: DataFrame, text: str, least: float = 0.3, limit: int | None = None, index: str | None = None) -> DataFrame:
    """Services and partners with a name similar to `text`, the best first; by a stored index of their names if there is one."""
    if index is not None:
        spark = service.sparkSession
        found = trigram_index.search(spark, index, spark.sql("SELECT :text AS text", args={"text": text}), least).drop("text")
        return found.orderBy(F.desc("similarity"), "kind", "id").limit(limit) if limit else found
    # only names that share a trigram can be similar
    found = named(service, partner).where(F.arrays_overlap(S.search_trigrams(F.col("name")), S.search_trigrams(F.lit(text))))
    found = found.withColumn("similarity", S.search_similarity(F.col("name"), F.lit(text))).where(F.col("similarity") >= least)
    return found.orderBy(F.desc("similarity"), "kind", "id").limit(limit) if limit else found


def unmatched(items: DataFrame) -> DataFrame:
    return items.where(F.col("service_id").isNull() & F.col("is_active"))


def stats(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row: documents by status, items, and the share of active items that have a service in per cent."""
    docs = documents.agg(F.count("*").alias("documents_total"), *(F.count_if(F.col("parse_status") == s).alias(f"documents_{s}") for s in ("done", "needs_review", "error")))
    matched = F.count_if(F.col("service_id").isNotNull())
    rows = items.where("is_active").agg(F.count("*").alias("items_total"), matched.alias("items_matched"), F.coalesce(F.round(F.try_divide(matched, F.count("*")) * 100, 2), F.lit(0.0)).alias("normalized_percent"))
    return docs.crossJoin(rows)
