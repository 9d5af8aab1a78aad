"""Lemmas of forms that a (token, lemma) table doesn't have, by rules on endings learned from it.

A pair says which ending to cut and which to put in its place.  Every ending of its token
that is long enough to hold the cut says the same, up to LONGEST letters.  Of the rules
for an ending the most frequent counts, then the shorter cut.  A new form follows the rule
of its longest known ending, if at least STEM letters stay.

Defined results: null and empty tokens and lemmas teach nothing; a token with several
lemmas has the first by alphabet.  Pairs without STEM common letters teach nothing.  A form
without a known ending has no lemma.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

LONGEST, STEM, LEAST_HELD = 6, 2, 2


def _endings(df: DataFrame, shortest) -> DataFrame:
    """A row for each ending of `token` that leaves a stem."""
    last = F.least(F.lit(LONGEST), F.length("token") - STEM)
    first = F.greatest(shortest, F.lit(1))
    sizes = F.when(first <= last, F.sequence(first, last))
    return df.select("*", F.explode(sizes).alias("size")).withColumn("ending", F.expr("right(token, size)"))


def learn(lemmas: DataFrame, least: int = LEAST_HELD) -> DataFrame:
    """(ending, cut, put, held, seen): for each ending what to cut and to put, in `held` of the `seen` forms with it."""
    pairs = lemmas.where("token != '' AND lemma != ''").groupBy("token").agg(F.min("lemma").alias("lemma"))
    # the longest beginning of both
    common = F.length(F.regexp_extract(F.concat_ws("\n", "token", "lemma"), r"^(.*).*\n\1", 1))
    taught = pairs.withColumn("common", common).where(F.col("common") >= STEM)
    taught = taught.withColumns({"cut": F.length("token") - F.col("common"), "put": F.expr("substring(lemma, common + 1)")})
    counts = _endings(taught, F.col("cut")).groupBy("ending", "cut", "put").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("cut", "put", "n"), F.struct(F.col("n"), -F.col("cut"), F.col("put"))).alias("b")
    rules = counts.groupBy("ending").agg(best, F.sum("n").alias("seen")).where(F.col("b.n") >= least)
    return rules.select("ending", "b.cut", "b.put", F.col("b.n").alias("held"), "seen")


def apply(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, lemma) of the distinct tokens that have a known ending."""
    found = _endings(tokens.select("token").distinct(), F.lit(1)).join(rules, "ending").where(F.length("token") - F.col("cut") >= STEM)
    chosen = found.groupBy("token").agg(F.max_by(F.struct("cut", "put"), "size").alias("r"))
    return chosen.select("token", F.expr("left(token, length(token) - r.cut) || r.put").alias("lemma"))


def complete(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(token, lemma) of the distinct tokens: as in the table, else by its rules."""
    known = lemmas.where("token IS NOT NULL").groupBy("token").agg(F.min("lemma").alias("lemma"))
    asked = tokens.select("token").distinct()
    # digits are left as they are
    unseen = asked.where(~F.col("token").rlike("^[0-9]+$")).join(known, "token", "left_anti")
    return asked.join(known, "token").select("token", "lemma").unionByName(apply(unseen, learn(lemmas)))


def lemmatize(names: DataFrame, lemmas: DataFrame, name: str, result: str = "normalized") -> DataFrame:
    """`names` normalised as by `functions.names.lemmatize`, forms that the table doesn't have by its rules."""
    tokens = names.select(name).distinct().select(F.explode(N.name_tokens(F.col(name))).alias("token"))
    return N.lemmatize(names, complete(tokens, lemmas), name, result)
