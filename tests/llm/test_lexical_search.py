import math
import random
import re

import numpy as np
import pyarrow as pa

from tarifflow.llm import lexical_search as lexical
from tarifflow.llm.scratch import Scratch

DOCS, ITEMS = "doc_id bigint, text string, score string, item_id int", "item_id bigint, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_force(docs, items, k=10):
    held = [(i, t) for i, t in ((d[0], terms(d[1])) for d in docs) if t]
    n, length = len(held), sum(len(t) for _, t in held)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(terms(t))
    df = {t: sum(t in d for _, d in held) for ts in asked.values() for t in ts}
    out = []
    for item, ts in asked.items():
        found = []
        for i, d in held:
            m = 10 + 90 * len(d) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * d.count(t) // (1000 * d.count(t) + 8 * m)) for t in ts if t in d)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(spark, docs, items):
    found = lexical.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS).repartition(2), Scratch(spark, "t"))
    return sorted(map(tuple, found.collect()), key=repr)


def corpus():
    rng = random.Random(2)
    words = ["Straße", "naïve", "x1", "Ünit", "the", "THE", "of", "kA", *(f"w{k}" for k in range(40))]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\t", "_"]) for _ in range(n))
    docs = [(k, "the " + say(rng.randrange(1, 60)), "s", k) for k in range(150)]
    docs += [(None, docs[3][1], None, None), (3, docs[3][1], None, None), (500, None, None, 1), (501, "", None, 1), (502, "-- !", None, None), (503, say(5_000), None, None)]
    docs += [(600 + k, "w1 w2 copied", None, None) for k in range(40)]
    items = [(k, say(12), "d") for k in range(30)] + [(900, None, None), (901, "", None), (902, "never said", None), (None, "w1 w3", None), (3, "w39 copied", None), (903, "the the the", None)]
    return docs, items


def test_ranks(spark, monkeypatch):
    docs, items = corpus()
    want = brute_force(docs, items)
    assert got(spark, docs, items) == want
    monkeypatch.setattr(lexical, "SLICE_BYTES", 300)
    monkeypatch.setattr(lexical, "MAX_ENTRIES", 50)
    assert got(spark, docs, items) == want


def test_empty_tables(spark):
    docs, items = corpus()
    assert got(spark, [], items) == got(spark, docs, []) == got(spark, [(1, None, None, None)], items) == []


def test_terms():
    texts = ["Aé-ß_1 b\x00C", None, "", "…x", "Z" * 100_000]
    hashes, at = lexical.term_hashes(pa.array(texts))
    assert np.diff(at).tolist() == [len(terms(t)) for t in texts]
    assert hashes[at[0]] == lexical.term_hashes(pa.array(["aé"]))[0][0]


def test_large_numbers():
    assert lexical.merged(np.array([0, 1, 0]), np.array([2**61, 3, 1]), 3).tolist() == [2**61 + 1, 3, 0]
    assert lexical.middles(np.array([10**8]), 10**12, 10**14).tolist() == [10 + 90 * 10**8 * 10**12 // 10**14]


def test_best_keeps_ties_by_id():
    best = lexical.Best(1, 2)
    for score, ids in (([5, 5], [9, 8]), ([5], [7]), ([5, 6], [None, 10]), ([5], [1])):
        best.add(0, np.array([score]), pa.array(ids, pa.int64()))
        best.reduce()
    assert list(zip(best.score.tolist(), best.id.to_pylist())) == [(6, 10), (5, 1)]
