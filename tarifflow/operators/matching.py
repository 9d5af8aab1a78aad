"""Matching of raw names with a service catalogue: code, exact name, then similarity.

Names are normalised once each.  Code and exact matches are equi-joins with the
catalogue; only distinct names without either are compared with its names.  Their first
candidates come from `candidates`, which scores few of the pairs and loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import similarity as S
from .candidates import nearest
from .lemmas import lemmatize

AUTO, REVIEW, CANDIDATES = 0.78, 0.55, 30
CODE_SCORE = 0.98


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key that isn't null or empty."""
    columns = [c for c in df.columns if c != key]
    held = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_r"))
    return held.select(key, *(F.col(f"_r.{c}").alias(c) for c in columns))


def code_index(services: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(code_key, service_id, …): every code of every service, the last one of equals."""
    codes = F.array(*(F.lower(F.trim(c)) for c in ("code", "tarificator_code") if c in services.columns))
    rows = services.select(F.explode(codes).alias("code_key"), "service_id", "service_name", "category", ordinal)
    return last_by(rows, "code_key", ordinal)


def _normalized(names: DataFrame, result: str, normalize, lemmas: DataFrame | None) -> DataFrame:
    return names.withColumn(result, normalize(F.col("_raw"))) if lemmas is None else lemmatize(names, lemmas, "_raw", result)


def name_index(services: DataFrame, ordinal: str = "ordinal", normalize=N.normalize_name, lemmas: DataFrame | None = None) -> DataFrame:
    """(choice, service_id, …): every normalized name and synonym, the last one of equals."""
    names = F.concat(F.array("service_name"), F.coalesce("synonyms", F.array().cast("array<string>"))) if "synonyms" in services.columns else F.array("service_name")
    rows = services.select(F.explode(names).alias("_name"), F.col("service_id"), "service_name", "category", ordinal)
    # equal names are normalized once
    distinct = last_by(rows.withColumn("_raw", F.col("_name")), "_name", ordinal).drop("_name")
    return last_by(_normalized(distinct, "choice", normalize, lemmas).drop("_raw"), "choice", ordinal)


def distinct_normalized(items: DataFrame, name: str, result: str, normalize=N.normalize_name, lemmas: DataFrame | None = None) -> DataFrame:
    """(_key, result): each distinct name and its normalized form."""
    # normalized from what an aggregation returns: filters on the result don't move below it
    distinct = items.groupBy(F.col(name).alias("_key")).agg(F.first(name).alias("_raw"))
    return _normalized(distinct, result, normalize, lemmas).select("_key", result)


def with_normalized(items: DataFrame, name: str, result: str, normalize=N.normalize_name, lemmas: DataFrame | None = None) -> DataFrame:
    """`items` with the normalized form of a name, made once for each distinct name; an empty one where it is null."""
    return items.join(distinct_normalized(items, name, result, normalize, lemmas), F.col(name).eqNullSafe(F.col("_key")), "left").drop("_key")


def top_candidates(scored: DataFrame, query: str = "query", choice: str = "choice", order: str = "ordinal", limit: int = CANDIDATES, scorers=tuple(S.SCORERS)) -> DataFrame:
    """(query, choice, fuzzy, …): the first of each scorer, then the first by the best score. Equal scores go by `order`, then by the choice."""
    best = F.lit(None).cast("double")
    ranked, ties = scored, dict.fromkeys((order, choice))
    for name in scorers:
        ranked = ranked.withColumn(f"_{name}", F.row_number().over(W.partitionBy(query).orderBy(F.desc(name), *ties)))
        taken = F.when(F.col(f"_{name}") <= limit, F.col(name))
        best = F.greatest(best, taken)
    merged = ranked.withColumn("fuzzy", best).where("fuzzy IS NOT NULL").drop(*(f"_{n}" for n in scorers))
    place = F.row_number().over(W.partitionBy(query).orderBy(F.desc("fuzzy"), *ties))
    return merged.withColumn("place", place).where(F.col("place") <= limit)


def candidate_pairs(queries: DataFrame, choices: DataFrame, broadcast_bytes: int = 8 << 20, blocked: bool | None = None) -> DataFrame:
    """(query, choice, …) pairs: all with all, or if `blocked` those that share a trigram. A catalogue of at most `broadcast_bytes` is broadcast, a larger one dealt out in parts."""
    if not blocked:
        size = choices.agg(F.sum(F.octet_length("choice") + 64)).first()[0] or 0
        if size <= broadcast_bytes:
            # few names make many pairs, so they are dealt out, not gathered in tasks of a few bytes
            dealt = queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query")
            return dealt.crossJoin(F.broadcast(choices))
        return queries.crossJoin(choices.repartition(-(-size // max(broadcast_bytes, 1 << 20)), "choice"))
    grams = lambda column: F.explode(F.array_distinct(S.grams(F.col(column))))
    shared = queries.select("query", grams("query").alias("gram")).join(choices.select("choice", grams("choice").alias("gram")), "gram").select("query", "choice").distinct()
    return shared.join(choices, "choice")


def status_of(score: Column, auto: float = AUTO, review: float = REVIEW) -> Column:
    return F.when(score >= auto, "auto").when(score >= review, "needs_review").otherwise("unmatched")


def fuzzy_matches(queries: DataFrame, choices: DataFrame, auto: float = AUTO, review: float = REVIEW, limit: int = CANDIDATES) -> DataFrame:
    """(query, service_id, service_name, category, score, status, method, reason) for distinct normalized names."""
    top = top_candidates(nearest(queries, choices, limit), limit=limit)
    scored = top.withColumn("score", S.combined_score(F.col("query"), F.col("choice"), F.struct(*S.SCORERS), F.col("fuzzy")))
    # the first of the best; candidates of score 0 are none
    best = scored.where("score > 0").groupBy("query").agg(F.max_by(F.struct("service_id", "service_name", "category", "score"), F.struct(F.col("score"), -F.col("place"))).alias("b"))
    status = status_of(F.col("b.score"), auto, review)
    known = status != "unmatched"
    text = F.concat(F.lit("score="), S.three_places("b.score"))
    return best.select(
        "query",
        *(F.when(known, F.col(f"b.{c}")).alias(c) for c in ("service_id", "service_name", "category")),
        F.col("b.score").alias("score"),
        status.alias("status"),
        F.lit("fuzzy_semantic").alias("method"),
        F.when(known, text).otherwise(F.concat(F.lit("best candidate: "), F.col("b.service_name"), F.lit("; "), text)).alias("reason"),
    )


def match(items: DataFrame, services: DataFrame, name: str = "service_name_raw", code: str = "service_code_source", ordinal: str = "ordinal", normalize=N.normalize_name, auto: float = AUTO, review: float = REVIEW, lemmas: DataFrame | None = None) -> DataFrame:
    """Items with service_id, service_name, category, score, status, method and reason of their match.

    With `lemmas` (token, lemma), names are normalized through them instead of by `normalize`.
    """
    results = ("service_id", "service_name", "category", "score", "status", "method", "reason")
    kept = [c for c in items.columns if c not in results]
    choices = name_index(services, ordinal, normalize, lemmas)
    found = with_normalized(items.select(*kept), name, "query", normalize, lemmas)
    codes = code_index(services, ordinal).select("code_key", F.struct("service_id", "service_name", "category").alias("by_code"))
    found = found.withColumn("code_key", F.lower(F.trim(F.col(code).cast("string")))).join(codes, "code_key", "left")
    exact = choices.select(F.col("choice").alias("query"), F.struct("service_id", "service_name", "category").alias("by_name"))
    found = found.join(exact, "query", "left")
    open_names = distinct_normalized(items, name, "query", normalize, lemmas).select("query").distinct().join(exact, "query", "left_anti")
    near = fuzzy_matches(open_names, choices, auto, review).select("query", F.struct(*results).alias("near"))
    found = found.join(near, "query", "left")

    def result(service: Column, score: float, status: str, method: str, reason: str) -> Column:
        return F.struct(*((service[c] if service is not None else F.lit(None).cast("string")).alias(c) for c in results[:3]), F.lit(score).alias("score"), F.lit(status).alias("status"), F.lit(method).alias("method"), F.lit(reason).alias("reason"))

    best = (
        F.when(F.col("query") == "", result(None, 0.0, "unmatched", "none", "empty_name"))
        .when(F.col("by_code").isNotNull(), result(F.col("by_code"), CODE_SCORE, "auto", "code", "matched by source code"))
        .when(F.col("by_name").isNotNull(), result(F.col("by_name"), 1.0, "auto", "exact", "exact normalized name"))
        .when(F.col("near").isNotNull(), F.col("near"))
        .otherwise(result(None, 0.0, "unmatched", "none", "no_best_candidate"))
    )
    return found.withColumn("_m", best).select(*kept, F.col("query").alias("normalized_name"), *(F.col(f"_m.{c}").alias(c) for c in results))


def verification_note(matched: DataFrame) -> Column:
    return F.concat("status", F.lit(": "), F.coalesce("service_name", F.lit("None")), F.lit("; "), "reason")


def match_report(matched: DataFrame) -> DataFrame:
    """One row: total, auto, review, unmatched and the share of auto in per cent."""
    counts = matched.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "auto").alias("auto_matched"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "unmatched").alias("unmatched"),
    )
    return counts.withColumn("auto_rate", F.coalesce(F.round(F.try_divide("auto_matched", "total") * 100, 2), F.lit(0.0)))


def review_queue(matched: DataFrame) -> DataFrame:
    """What a reviewer sees of items that aren't sure."""
    rows = matched.where("status != 'auto'")
    return rows.select(F.col("service_name_raw").alias("raw_name"), "service_id", F.col("status").alias("match_status"), F.col("score").alias("match_confidence"), verification_note(rows).alias("verification_note"))
