"""A stored index of names by trigram, asked with many texts at once.

Two names of m and n distinct trigrams with similarity t or more share at least
ceil(t * m) and ceil(t * n) of them.  So with the trigrams of each in one order, the first
m - ceil(t * m) + 1 of the one and n - ceil(t * n) + 1 of the other have one in common:
only those of a name are posted, and only those of a text are looked up.  The order is
rarest first, as of the first build, which leaves out the postings that would be long.
What shares one also has between t * m and m / t trigrams.  Texts are taken in parts; names
that may be near one of a part are held against all of it, by a product of matrices of
texts and names by trigrams, so a pair is never listed before its similarity is known.

Postings are those of distinct names, in folders by bucket of their trigram, each in
several files, so that a frequent trigram is neither written nor read by one task.  A
search reads the buckets of its texts' trigrams and no other.  What has a name lies by
bucket of the name.  Names that come later are appended; the order stays.

Defined results: null names, and those without a word, are not found; null texts find
nothing.  Equal texts are one.  Rows that repeat kind, id and name are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S

LEAST = 0.3
BUCKETS, SPREAD = 64, 8
SLACK = 1e-9
#: Texts of a part, about; groups of the names that are held against it; names in a product.
PART, GROUPS, AT_ONCE = 500, 16, 256


def _with_trigrams(df: DataFrame, text: str) -> DataFrame:
    found = df.where(F.col(text).isNotNull()).withColumn("trigrams", S.search_trigrams(F.col(text)))
    return found.withColumn("n", F.size("trigrams")).where("n > 0")


def _prefix(df: DataFrame, order: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, n, trigram): the first trigrams of each row that it needs."""
    each = df.select(*keys, "n", F.explode("trigrams").alias("trigram")).join(order, "trigram", "left")
    listed = each.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "trigram"))).alias("listed"))
    needed = F.col("n") - F.ceil(F.col("n") * least - SLACK).cast("int") + 1
    return listed.select(*keys, "n", F.explode(F.slice("listed", F.lit(1), F.least(needed, F.col("n")))["trigram"]).alias("trigram"))


def _bucket(trigram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(buckets)).cast("int")


def build(names: DataFrame, path: str, least: float = LEAST, buckets: int = BUCKETS) -> None:
    """Write an index of (kind, id, name) for searches with similarity `least` or more."""
    spark = names.sparkSession
    said = _with_trigrams(names.select("name").distinct(), "name")
    said.select(F.explode("trigrams").alias("trigram")).groupBy("trigram").agg(F.count("*").alias("held")).write.parquet(f"{path}/order")
    spark.createDataFrame([(least, buckets)], "least double, buckets int").coalesce(1).write.parquet(f"{path}/about")
    append(names, path)


def append(names: DataFrame, path: str) -> None:
    """Add names to an index; those that it has already are found once all the same."""
    spark = names.sparkSession
    about = spark.read.parquet(f"{path}/about").first()
    said = _with_trigrams(names.select("name").distinct(), "name")
    postings = _prefix(said, spark.read.parquet(f"{path}/order"), ["name"], about["least"]).withColumn("bucket", _bucket(F.col("trigram"), about["buckets"]))
    _write(postings, f"{path}/postings", ["name"], ["trigram", "n"])
    held = names.where("name IS NOT NULL").select("kind", "id", "name").distinct().withColumn("bucket", _bucket(F.col("name"), about["buckets"]))
    _write(held, f"{path}/names", ["kind", "id"], ["name"])


def _write(df: DataFrame, path: str, spread: list[str], order: list[str]) -> None:
    """Each bucket in up to SPREAD files."""
    dealt = df.repartition(F.col("bucket"), F.pmod(F.xxhash64(*spread), F.lit(SPREAD))).sortWithinPartitions("bucket", *order)
    dealt.write.mode("append").partitionBy("bucket").parquet(path)


def postings_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The postings in the buckets of `wanted`; of others no file is read."""
    # as many values as there are buckets at most
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]
    return spark.read.schema("trigram string, n int, name string, bucket int").parquet(f"{path}/postings").where(F.col("bucket").isin(buckets))


def _similar(least: float):
    def run(texts: pa.Table, names: pa.Table) -> pa.Table:
        """text, name, similarity of those that are at least so similar."""
        (one, n, two), (other, m, three) = ((t[a].combine_chunks().flatten(), t[b].to_numpy(), t[c].combine_chunks()) for t, a, b, c in ((texts, "trigrams", "n", "text"), (names, "its", "m", "name")))
        values = pa.chunked_array([one, other]).combine_chunks().dictionary_encode().indices.to_numpy() if len(one) + len(other) else np.zeros(0, np.int64)
        asked, held = values[: len(one)], values[len(one) :]
        width = int(asked.max()) + 1 if len(asked) else 0
        matrix = np.zeros((len(two), width), np.float32)
        matrix[np.repeat(np.arange(len(two)), n), asked] = 1
        first, found = np.append(0, np.cumsum(m)), []
        for k in range(0, len(three), AT_ONCE):
            sizes = m[k : k + AT_ONCE]
            its, row = held[first[k] : first[k + len(sizes)]], np.repeat(np.arange(len(sizes)), sizes)
            there = its < width  # trigrams that some text has come first
            part = np.zeros((len(sizes), width), np.float32)
            part[row[there], its[there]] = 1
            common = np.rint(matrix @ part.T).astype(np.int64)
            similarity = common / (n[:, None] + sizes[None, :] - common)
            i, j = np.nonzero((common > 0) & (similarity >= least))
            found.append((i, j + k, similarity[i, j]))
        i, j, similarity = (np.concatenate([np.zeros(0, t), *(f[k] for f in found)]) for k, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"text": two.take(pa.array(i)), "name": three.take(pa.array(j)), "similarity": similarity})

    return run


def search(spark: SparkSession, path: str, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """text, kind, id, name, similarity of names at least so similar, for each distinct text of `texts`."""
    about = spark.read.parquet(f"{path}/about").first()
    if least < about["least"]:
        raise ValueError(f"the index holds what searches from {about['least']} on need")
    texts = texts.select("text").distinct()
    parts = max(1, texts.count() // PART)
    asked = _with_trigrams(texts, "text").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    wanted = _prefix(asked, spark.read.parquet(f"{path}/order"), ["text", "part"], least).withColumn("bucket", _bucket(F.col("trigram"), about["buckets"]))
    # a trigram once for each part, however many of its texts have it
    wanted = wanted.groupBy("part", "bucket", "trigram").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    found = postings_of(spark, path, wanted).join(wanted, ["bucket", "trigram"])
    near = found.where((F.col("n") >= F.col("lo") * least - SLACK) & (F.col("n") * least <= F.col("hi") + SLACK)).select("part", "name").distinct()
    left = asked.select("part", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("group"), "text", "trigrams", "n")
    right = _with_trigrams(near, "name").select(F.col("part").alias("p"), F.pmod(F.xxhash64("name"), F.lit(GROUPS)).cast("int").alias("g"), "name", F.col("trigrams").alias("its"), F.col("n").alias("m"))
    pairs = left.groupBy("part", "group").cogroup(right.groupBy("p", "g")).applyInArrow(_similar(least), "text string, name string, similarity double")
    held = spark.read.schema("kind string, id string, name string, bucket int").parquet(f"{path}/names").distinct()
    return pairs.withColumn("bucket", _bucket(F.col("name"), about["buckets"])).join(held, ["bucket", "name"]).select("text", "kind", "id", "name", "similarity")
