"""The pipeline's decisions on planted documents, and every query on small tables."""

import pytest

import corpus_pipeline
from tarifflow.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])))
def test_query_covers_its_table(spark, name):
    table, key = {"op4_embedding_dedup": ("embeddings", "vec_id"), "op11_centroids": ("embeddings", "vec_id"), "op6_chat_format": ("conversations", "conv_id"), "op13_lexical_search": ("benchmark", "item_id")}.get(name, ("documents", "doc_id"))
    want = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).distinct().collect()}
    got = {r[0] for r in QUERIES[name](spark, DATA).select(key).distinct().collect()}
    assert got <= want if name.startswith("op9") else got == want | ({-1} if name.startswith("op6") else set())


def test_stages(spark):
    test_item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    plain = "the garden of the old house was full of roses and the children played there all day until the evening came"
    rows = [
        (1, plain, "en", "a", len(plain)),
        (2, plain, "en", "a", len(plain)),
        (3, f"before {test_item} after", "en", "a", 10),
        (4, "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff and quite another text about trains and stations", "en", "b", 10),
        (5, "1234 !!", None, None, None),
        (6, None, None, None, None),
        (None, "a document without an id stays where it is", "en", None, 1),
    ]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.schema.simpleString() == spark.createDataFrame([], DOCUMENTS).schema.simpleString()
        docs = spark.createDataFrame(docs.collect(), DOCUMENTS)
        kept[name] = {r["doc_id"] for r in docs.collect()}
    assert kept == {"language_id": {1, 2, 3, 4, None}, "near_duplicates": {1, 3, 4, None}, "decontamination": {1, 4, None}, "secret_scans": {1, 4, None}}
    assert "24be64" not in {r["doc_id"]: r["text"] for r in docs.collect()}[4]
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, DATA).collect()} == {1, 4, None}


def test_leaks_of_clashing_and_missing_ids(spark):
    leak = f"before {spark.read.parquet(f'{DATA}/benchmark.parquet').first()['text']} after"
    clean = "trains leave the station every hour and nobody knows why the last of them is always late in the winter"
    rows = [(None, leak, "en", "a", 1), (7, leak, "en", "a", 1), (7, clean, "en", "a", 1), (8, clean, "en", "a", 1), (7, None, None, None, None), (None, "", None, None, None), (9, "and " * 50_000, "en", "a", 1)]
    got = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, DOCUMENTS), DATA).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows[2:], key=repr)


def test_near_duplicates_of_clashing_and_missing_ids(spark):
    one = "the garden of the old house was full of roses and the children played there all day until the evening came"
    two = "trains leave the station every hour and nobody knows why the last of them is always late in the winter"
    rows = [
        (6, one, "en", "b", 1),
        (6, one, "en", "a", 1),
        (6, two, "en", "a", 1),
        (7, one + " home", "en", "a", 1),
        (8, two + " again", "en", "a", 1),
        (None, one, "en", "a", 1),
        (None, "a text that nobody else has", "en", "a", 1),
        (None, "a text that nobody else has", "en", "a", 1),
        (9, "", None, None, None),
        (9, "", None, None, None),
        (10, None, None, None, None),
    ]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCUMENTS), DATA).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["source"] or "") for r in got) == [(0, "a text that nobody else has", "a"), (6, one, "a"), (6, two, "a"), (9, "", ""), (10, "", "")]


def test_columns_named_like_those_of_the_stages(spark):
    schema = DOCUMENTS + ", language string, cosine string, spans string, redacted string, text_digest string, score double, component_id string, item_id string"
    text = "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff and a text about trains and stations " + "again and again " * 4000
    docs = spark.createDataFrame([(1, text, "en", "a", 10, *"abcde", 0.5, "f", "g")], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    row = docs.collect()[0]
    assert tuple(row)[5:] == (*"abcde", 0.5, "f", "g") and row["text"] == text.replace("token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "[SECRET]")
    assert sum(r["length"] for r in corpus_pipeline.pack(spark, docs, DATA).collect()) > 12_000


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_unlabelled_corpus_is_kept(spark):
    rows = [(1, "the garden of the old house", None, "a", 10), (2, "12 !", None, "a", 4), (3, None, None, "a", None), (None, "é", None, "a", 1)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, DOCUMENTS), DATA).collect()
    assert {r["doc_id"] for r in got} == {1, None}


def test_near_duplicates_fetch_few_sets(spark, monkeypatch):
    """Texts that share a crowded passage, which can't make them near, stay, and their sets aren't sent."""
    import random

    import numpy as np

    from tarifflow.llm import ngram_join

    fetched, gather = [], ngram_join._Join.gather

    def counted(self, wanted):
        fetched.append(wanted.distinct().count())
        return gather(self, wanted)

    monkeypatch.setattr(ngram_join._Join, "gather", counted)
    monkeypatch.setattr(ngram_join, "common_columns", lambda *_: np.zeros(0, np.uint32))
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(14)
    texts = [" ".join(words(rng.randrange(90, 130)) + passage) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (500, texts[7] + " end")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {*range(300)}
    assert sum(fetched) < 60
