"""Edit similarities of many pairs, and the first candidates without all pairs, against the definitions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarifflow.functions import edit
from tarifflow.functions import similarity as S
from tarifflow.operators import candidates, matching

NAMES = st.text(alphabet="абв xé", max_size=14) | st.text(alphabet="аб ", min_size=60, max_size=150)


def vocabulary(rng, n=400):
    syllable = lambda: rng.choice("бвгджзклмнпрст") + rng.choice("аеиоуы")
    return ["".join(syllable() for _ in range(rng.randrange(2, 5))) + rng.choice(["", "н", "ие", "ия", "й"]) for _ in range(n)]


def random_names(rng, n):
    words = vocabulary(rng)
    return sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(n)})


def misspelled(rng, name):
    letters = list(name)
    for _ in range(rng.randrange(3)):
        letters[rng.randrange(len(letters))] = rng.choice("абвгд ")
    return "".join(letters)


def first_of_all_pairs(choices, queries, limit):
    i, j = np.divmod(np.arange(len(queries) * len(choices)), len(choices))
    scores = edit.scores(edit.Names(queries), edit.Names(choices), i, j).reshape(len(queries), len(choices), 4)
    found = {}
    for k, by_choice in enumerate(scores):
        rows = {r for s in by_choice.T for r in np.lexsort((np.arange(len(choices)), -s))[:limit]}
        found |= {(k, int(r)): by_choice[r].tolist() for r in rows}
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(NAMES, min_size=1, max_size=6), st.lists(NAMES, min_size=1, max_size=6))
def test_many_pairs_equal_the_definitions(left, right):
    i, j = np.divmod(np.arange(len(left) * len(right)), len(right))
    names = edit.Names(left), edit.Names(right)
    assert edit.scores(*names, i, j).tolist() == [list(S.scores_of(left[a], right[b])) for a, b in zip(i, j)]
    assert edit.subsequences(*names, i, j).tolist() == [S.lcs_length(left[a], right[b]) for a, b in zip(i, j)]


@settings(max_examples=40, deadline=None)
@given(st.lists(NAMES, max_size=12), st.lists(NAMES, min_size=1, max_size=4), st.integers(1, 4))
def test_bounds_hold(choices, queries, limit):
    index, names = candidates.Index(choices), edit.Names(queries)
    profiles = index._profiles(names)
    for k in range(len(queries)):
        bounds = index._bounds(names, profiles, k)
        scores = edit.scores(names, index.names, np.full(len(choices), k), np.arange(len(choices)))
        assert (bounds.T >= scores).all()
        assert (index._by_subsequence(names, k, np.arange(len(choices)), bounds).T >= scores).all()
        assert (index._by_ends(names, k, np.arange(len(choices)), bounds).T >= scores).all()
    owner, row, scores = index.search(queries, limit)
    assert dict(zip(zip(owner.tolist(), row.tolist()), scores.tolist())) == first_of_all_pairs(choices, queries, limit)


def test_search_equals_all_pairs():
    rng = random.Random(1)
    choices = random_names(rng, 3000)
    queries = [*(misspelled(rng, n) for n in random_names(rng, 15)), "", choices[5], "я"]
    index = candidates.Index(choices)
    owner, row, scores = index.search(queries, 30)
    assert dict(zip(zip(owner.tolist(), row.tolist()), scores.tolist())) == first_of_all_pairs(choices, queries, 30)


def test_few_pairs_of_a_large_catalogue_are_scored():
    rng = random.Random(2)
    choices = random_names(rng, 140_000)
    queries = [misspelled(rng, n) for n in rng.sample(choices, 4)] + [misspelled(rng, n) for n in random_names(rng, 4)]
    assert len(choices) >= 100_000
    index = candidates.Index(choices)
    index.search(queries, 30)
    assert index.scored < 0.05 * len(choices) * len(queries)


@pytest.mark.parametrize("part_bytes", [2_000, 8 << 20])
def test_first_candidates_of_a_catalogue(spark, part_bytes):
    rng = random.Random(3)
    rows = [(n, rng.randrange(50), "c") for n in random_names(rng, 200)] + [(None, 1, None), ("", 2, None)]
    choices = spark.createDataFrame(rows, "choice string, ordinal int, category string")
    queries = spark.createDataFrame([(misspelled(rng, n),) for n in random_names(rng, 12)] + [("",), (None,)], "query string")
    got = matching.top_candidates(candidates.nearest(queries, choices, 7, part_bytes), limit=7)
    pairs = queries.where("query IS NOT NULL").crossJoin(choices.where("choice IS NOT NULL")).withColumn("s", S.edit_scores("query", "choice"))
    want = matching.top_candidates(pairs.select("query", "choice", "ordinal", "category", "s.*"), limit=7)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert candidates.nearest(queries.limit(0), choices, 7).count() == candidates.nearest(queries, choices.limit(0), 7).count() == 0


def test_matching_needs_no_cross_join(spark):
    services = spark.createDataFrame([("1", "общий анализ крови", "lab", "a1", 1), ("2", "узи печени", "us", "b2", 2)], "service_id string, service_name string, category string, code string, ordinal int")
    items = spark.createDataFrame([("анализ крови общ", None)], "service_name_raw string, service_code_source string")
    found = matching.match(items, services)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and found.first()["service_id"] == "1"
    assert found.agg(F.max("score")).first()[0] >= matching.AUTO
