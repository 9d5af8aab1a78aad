import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tarifflow.llm import suffix_dedup as op
from tarifflow.llm.scratch import Scratch

SCHEMA = "doc_id bigint, text string, n_bytes string"


def brute(docs):
    texts = [(key, (text or "").encode()) for key, text, _ in docs]
    counts = Counter(t[p : p + 400] for _, t in texts for p in range(len(t) - 399))
    out = []
    for key, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            if counts[t[p : p + 400]] > 1:
                gone[p : p + 400] = True
        edges = np.diff(gone.astype(int), prepend=0)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if t else b""
        out.append((key, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(spark, docs):
    got = op.dedup(spark.createDataFrame(docs, SCHEMA).repartition(3), Scratch(spark, "t"))
    got = got.collect()
    for r in got:
        assert r["n_kept"] == r["n_bytes"] - r["n_removed"]
        if "\ufffd" not in r["kept_text"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    got = sorted((tuple(r)[:5] for r in got), key=repr)
    assert got == brute(docs)
    return got


def noise(rng, n):
    return "".join(rng.choice("abcdefgh é\n") for _ in range(n))


def test_passages(spark):
    rng = random.Random(3)
    passage, long = noise(rng, 700), noise(rng, 3000)
    docs = [(k, noise(rng, rng.randrange(0, 900)) + passage[rng.randrange(0, 200) : 500 + rng.randrange(0, 200)] + noise(rng, 300), None) for k in range(40)]
    docs += [(100, long, None), (101, long[:1500] + "!" + long[1500:], None), (102, long[200:599], None), (103, long[200:600], None), (104, noise(rng, 399), "x"), (105, passage + passage, "x")]
    assert sum(r[2] for r in check(spark, docs)) > 0


def test_odd_texts(spark):
    check(spark, [(1, None, None), (2, "", None), (3, "a" * 399, None), (4, "a" * 400, None), (5, "b" * 401, None), (6, "b" * 900, None), (6, "b" * 900, None), (None, "ab" * 500, None)])
    assert op.dedup(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_text_longer_than_a_piece(spark):
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, op.PIECE + 5000)))
    at = op.PIECE - 300
    docs = [(1, text, None), (2, "?" * 50 + text[at : at + 900], None)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in op.dedup(spark.createDataFrame(docs, SCHEMA), Scratch(spark, "t")).collect()}
    assert got == {1: (900, 1), 2: (900, 1)}


def test_crowded_anchors(spark):
    """More places share their bytes than a task takes."""
    rng = random.Random(9)
    passage = noise(rng, 450)
    docs = [(k, noise(rng, 30) + passage + noise(rng, 30), None) for k in range(op.CROWD + 50)]
    got = op.dedup(spark.createDataFrame(docs, SCHEMA).repartition(4), Scratch(spark, "t")).collect()
    assert all(r["n_spans"] == 1 and r["n_removed"] >= len(passage.encode()) for r in got)
    some = {r["doc_id"]: r["n_removed"] for r in got}
    want = Counter(t.encode()[p : p + 400] for _, t, _ in docs for p in range(len(t.encode()) - 399))
    for key, text, _ in docs[:60]:
        t, gone = text.encode(), set()
        for p in range(len(t) - 399):
            if want[t[p : p + 400]] > 1:
                gone |= set(range(p, p + 400))
        assert some[key] == len(gone)


@pytest.mark.parametrize("seed", range(4))
def test_loser_tree_sorts_and_knows_prefixes(seed):
    rng = random.Random(seed)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(6)).ljust(op.LENGTH, b"\0") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 7))]
    coded = [op.decoded(*op.front_coded(r), k) for k, r in enumerate(runs) if r]
    got = list(op.LoserTree(coded or [iter(())]))
    want = sorted(s for r in runs for s in r)
    assert [g[1] for g in got] == want
    for before, after in zip(got, got[1:]):
        assert after[0] == op.common_prefix(before[1], after[1], 0)
