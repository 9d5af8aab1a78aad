"""The stored index of names against a scan of all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tarifflow.operators import trigram_index
from tarifflow.plans import endpoints

NAMED = "kind string, id string, name string"


@pytest.fixture(scope="module")
def names():
    rng = random.Random(1)
    words = ["".join(rng.choice("абвгде xyz") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    rows = [("service", str(k), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for k in range(1500)]
    return rows + [("partner", str(k), f"клиника {rng.choice(words)}") for k in range(500)] + [("partner", "n", None), ("partner", "e", " -- "), ("service", "1", rows[1][2]), ("partner", "u", "Ünit É")]


@pytest.fixture(scope="module")
def index(spark, names, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "names")
    trigram_index.build(spark.createDataFrame(names[:1200], NAMED), path)
    trigram_index.append(spark.createDataFrame(names[1200:], NAMED), path)
    trigram_index.append(spark.createDataFrame(names[:5], NAMED), path)
    return path


def trigrams(text):
    return {f"  {w} "[k : k + 3] for w in re.split(r"\W+", text.lower()) if w for k in range(len(w) + 1)}


@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_a_thousand_texts_equal_the_scan(spark, names, index, least):
    rng = random.Random(2)
    swapped = lambda t: "".join(rng.choice("абв ") if rng.random() < 0.1 else c for c in t)
    texts = [(swapped(rng.choice(names)[2] or ""),) for _ in range(997)] + [(None,), ("",), ("ünit é",)]
    got = {(r["text"], r["kind"], r["id"], r["name"]): r["similarity"] for r in trigram_index.search(spark, index, spark.createDataFrame(texts, "text string"), least).collect()}
    held = {n: (trigrams(n), [(k, i) for k, i, x in set(names) if x == n]) for n in {n for _, _, n in names if n}}
    want = {}
    for text in {t for (t,) in texts if t}:
        asked = trigrams(text)
        for name, (its, ids) in held.items():
            if asked & its and len(asked & its) / len(asked | its) >= least:
                want |= {(text, k, i, name): len(asked & its) / len(asked | its) for k, i in ids}
    assert got == want
    assert len(got) > 200


def test_other_buckets_are_not_read(spark, index):
    read = trigram_index.search(spark, index, spark.createDataFrame([("абв",)], "text string"))
    plan = read._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    wanted = spark.createDataFrame([(3,), (5,)], "bucket int")
    files = {f.split("bucket=")[1].split("/")[0] for f in trigram_index.postings_of(spark, index, wanted).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert files == {"3", "5"}


def test_frequent_trigrams_are_left_out(spark, index):
    posted = spark.read.parquet(f"{index}/postings")
    held = {r["trigram"]: r["held"] for r in spark.read.parquet(f"{index}/order").collect()}
    most = max(held, key=held.get)
    assert posted.where(F.col("trigram") == most).count() < 0.2 * held[most]


def test_search_by_index(spark, names, index):
    rows = spark.createDataFrame(names, NAMED)
    service = rows.where("kind = 'service'").select(F.col("id").alias("service_id"), F.col("name").alias("service_name")).distinct()
    partner = rows.where("kind = 'partner'").select(F.col("id").alias("partner_id"), "name")
    scanned, asked = (endpoints.search(service, partner, "Клиника", index=i).orderBy("kind", "id") for i in (None, index))
    assert scanned.collect() == asked.collect() != []
    assert endpoints.search(service, partner, "клиника", limit=3, index=index).count() == 3


def test_a_bar_below_the_index(spark, index):
    with pytest.raises(ValueError, match="the index holds"):
        trigram_index.search(spark, index, spark.createDataFrame([("a",)], "text string"), 0.2)


def test_an_empty_index(spark, tmp_path):
    trigram_index.build(spark.createDataFrame([], NAMED), str(tmp_path / "i"))
    assert trigram_index.search(spark, str(tmp_path / "i"), spark.createDataFrame([("a",)], "text string")).count() == 0


def test_many_texts_near_many_names(spark, tmp_path, monkeypatch):
    """In small parts and products; no pair has its similarity computed by itself."""
    for name, value in (("PART", 40), ("GROUPS", 3), ("AT_ONCE", 7)):
        monkeypatch.setattr(trigram_index, name, value)
    monkeypatch.setattr(trigram_index.S, "search_similarity", None)
    held, texts = [f"Supplier#{k:06d}" for k in range(0, 900, 3)], [f"partner Supplier#{k:06d}" for k in range(0, 900, 7)]
    trigram_index.build(spark.createDataFrame([("partner", n[-3:], n) for n in held], NAMED), str(tmp_path / "i"))
    got = {(r["text"], r["name"]): r["similarity"] for r in trigram_index.search(spark, str(tmp_path / "i"), spark.createDataFrame([(t,) for t in texts], "text string"), 0.5).collect()}
    shares = {(t, n): len(trigrams(t) & trigrams(n)) / len(trigrams(t) | trigrams(n)) for t in texts for n in held}
    assert got == {k: v for k, v in shares.items() if v >= 0.5} != {}
