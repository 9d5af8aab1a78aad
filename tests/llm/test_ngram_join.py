import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifflow.llm import ngram_join
from tarifflow.llm.scratch import Scratch

SCHEMA = "doc_id bigint, text string, row string"


def brute(docs):
    sets = {}
    for key, text, _ in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for key, s in sets.items():
        common = Counter(k for g in s for k in holders[g])
        for other, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[other]) - n):
                a, b = sorted((find(key), find(other)))
                parent[b] = a
        for g in s:
            holders[g].append(key)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def check(spark, docs):
    frame = spark.createDataFrame(docs, SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame, Scratch(spark, "t")).collect()}
    assert got == brute(docs)
    return got


def words(rng, n, pool=5000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def test_no_group_gathers_a_crowded_column(spark):
    """However many near copies there are, a block gets as many of their entries as there are tasks."""
    rng, largest = random.Random(8), {}
    base = words(rng, 200)
    for count in (400, 1600):
        docs = [" ".join([*base[:k], f"x{rng.randrange(10**9)}", *base[k + 1 :]]) for k in (rng.randrange(200) for _ in range(count))]
        frame = spark.createDataFrame([(k, d, None) for k, d in enumerate(docs)], SCHEMA).repartition(4)
        sent = ngram_join.entries(frame, "text", 5, np.zeros(0, np.uint32), 16).select("block", (F.octet_length("rows") / 8).alias("n"))
        by_block = {r["block"]: r["n"] for r in sent.groupBy("block").agg(F.sum("n").alias("n")).collect()}
        largest[count] = max(n for b, n in by_block.items() if b < 16)
        assert sum(n for b, n in by_block.items() if b >= 16) > 20 * count
    assert largest[1600] < 2 * largest[400] and largest[1600] < 0.05 * 1600 * 40


def test_crowded_in_one_task_only(spark, monkeypatch):
    """A column that few rows of one task and many of another have is crowded for both."""
    monkeypatch.setattr(ngram_join, "_BUFFER", 1500)
    rng, base = random.Random(9), words(random.Random(9), 150)
    near = lambda n: [w if rng.random() > n / 300 else f"y{rng.randrange(10**9)}" for w in base]
    check(spark, [(k, " ".join(near(rng.choice([1, 2, 8, 16]))), None) for k in range(150)] + [(500 + k, " ".join(base), None) for k in range(60)])


def test_crowds_of_near_copies(spark):
    """Groups larger than CROWD whose members link only through others."""
    rng, docs = random.Random(5), []
    for group in range(2):
        base = words(rng, 200)
        for _ in range(90):
            text = base[:]
            for _ in range(rng.choice([1, 3, 4, 5])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**9)}"
            docs.append((len(docs), " ".join(text), None))
    docs += [(1000 + k, " ".join(words(rng, 60)), None) for k in range(40)]
    got = check(spark, docs)
    assert len(set(got.values())) > 42


def test_odd_texts(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "b"), (4, "One two", None), (5, "one  TWO", None), (6, "one two three four five", None), (7, "É é", None), (8, "é é", None), (9, "a " * 30_000, None), (10, "a a a a a a", None)]
    got = check(spark, docs)
    assert got[4][1] == got[5][1] == 4 and got[9][1] == 9 == got[10][1]


def test_empty_table_and_repeated_rows(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    rows = [(1, "a b c d e f", "x")] * 3 + [(None, "a b c d e f", "x")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert len(got) == 4 and {r["component_id"] for r in got} == {1}


def partitioned(spark, rows, n):
    return ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(n), Scratch(spark, "t")).collect()


@pytest.mark.parametrize("n", [1, 4])
def test_different_texts_under_one_id(spark, n):
    rng = random.Random(2)
    a, b = words(rng, 40), words(rng, 40)
    near = lambda t: " ".join([*t, "end"])
    got = partitioned(spark, [(6, " ".join(a), None), (6, " ".join(b), None), (7, near(a), None), (8, near(b), None), (9, " ".join(words(rng, 9)), None)], n)
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(6, 6), (6, 6), (7, 6), (8, 6), (9, 9)]
    assert len({r["group_key"] for r in got}) == 3


@pytest.mark.parametrize("n", [1, 4])
def test_links_of_texts_without_an_id(spark, n):
    rng = random.Random(4)
    base = words(rng, 75)
    steps = [" ".join(base[k : k + 60]) for k in (0, 5, 10, 15)]  # each near the next alone
    got = partitioned(spark, [(20, steps[0], None), (None, steps[1], None), (7, steps[2], None), (None, steps[3], None), (None, " ".join(words(rng, 30)), None), (None, None, None)], n)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(7, 7), (20, 7)]
    assert sorted(r["component_id"] or 0 for r in got if r["doc_id"] is None) == [0, 0, 7, 7]


@pytest.mark.parametrize("n", [1, 5, 10, 24, 100])
def test_prefix_meets_the_bound(n):
    assert n - ngram_join.prefix_size(n) < 0.8 * n


def test_what_a_crowded_column_shares_alone_is_not_fetched(spark, monkeypatch):
    """Texts of few common columns, which can't link by them, are told apart without their sets; their number may grow as a square otherwise."""
    fetched, gather = [], ngram_join._Join.gather

    def counted(self, wanted):
        fetched.append(wanted.distinct().count())
        return gather(self, wanted)

    monkeypatch.setattr(ngram_join._Join, "gather", counted)
    monkeypatch.setattr(ngram_join, "common_columns", lambda *_: np.zeros(0, np.uint32))
    rng = random.Random(12)
    shared = [words(rng, 7) for _ in range(2)]
    docs = [(k, " ".join(sum(shared, words(rng, rng.randrange(90, 130), 10**6))), None) for k in range(300)]
    docs += [(500, docs[7][1] + " end", None)]
    got = check(spark, docs)
    assert got[500] == (got[7][0] + 1, 7) and sum(fetched) < 60


def test_tiles_in_turns(spark, monkeypatch):
    """Chains in a crowd, whose tiles are compared a few at a time."""
    monkeypatch.setattr(ngram_join, "_AT_ONCE", 0)
    monkeypatch.setattr(ngram_join, "_AT_ONCE_BYTES", 60_000)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rng = random.Random(13)
    text, docs = words(rng, 150), []
    for k in range(70):
        text = [w if rng.random() > 0.02 else f"z{rng.randrange(10**9)}" for w in text]
        docs.append((k, " ".join(text), None))
    check(spark, docs + [(200 + k, " ".join(words(rng, 50)), None) for k in range(10)])


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n, m, both in ((0, 5, 0), (5, 9, 3), (130, 150, 120), (400, 400, 0), (1000, 1300, 900), (9000, 8000, 4000)):
        grams = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
        left, right = np.sort(grams[:n]), np.sort(grams[n - both :])
        bound = int(ngram_join.most_common([ngram_join.sketch(left)], [ngram_join.sketch(right)])[0, 0])
        assert both <= bound <= min(n, m)
        if both == 0 and n > 100:
            assert not ngram_join.links(bound, n, m)
    full = np.arange(100_000, dtype=np.uint64) << np.uint64(40)
    assert ngram_join.most_common([ngram_join.sketch(full)], [ngram_join.sketch(full[:90_000])])[0, 0] >= 90_000
