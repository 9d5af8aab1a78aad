import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tarifflow.llm import sharding
from tarifflow.llm.scratch import Scratch

DOCS = "doc_id bigint, text string, shard string, slot string, copies int"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 60)), max_size=12), st.integers(1, 6))
def test_runs_equal_single_placements(runs, shards):
    heap, plain = [(0, i) for i in range(shards)], [(0, i) for i in range(shards)]
    for size, count in runs:
        turns = sharding.deal(heap, size, count)
        for rank in range(count):
            load, shard = plain[0]
            heapq.heapreplace(plain, (load + size, shard))
            first, order = [t for t in turns if t[0] <= rank][-1]
            assert order[(rank - first) % len(order)] == shard
        assert sorted(heap) == sorted(plain) and heap[0] == min(heap)


def brute_force(rows, shards):
    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode()) + 8
    groups = Counter()
    for _, t, *_ in rows:
        groups[md5(t)] += size(t)
    heap, home = [(0, i) for i in range(shards)], {}
    for digest, total in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        home[digest] = shard
        heapq.heappush(heap, (load + total, shard))
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[home[md5(t)]].append((i is not None, i or 0, md5(t), i, t))
    return sorted(((i, size(t), zlib.crc32((t or "").encode()), "bytes", s, slot, None) for s, members in by.items() for slot, (*_, i, t) in enumerate(sorted(members, key=lambda x: x[:3]))), key=repr)


def got(spark, rows, shards):
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    out = sharding.assign(frame, Scratch(spark, "t"), shards=shards)
    return sorted((tuple(r)[:7] for r in out.collect()), key=repr)


def test_shards_and_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_GROUPS", 16)
    monkeypatch.setattr(sharding, "COPIES", 7)
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("abé ") for _ in range(rng.choice([0, 1, 2, 3, 9, 9, 9, 40]))), "x", None, k) for k in range(400)]
    rows += [(1000 + k, "copied", None, None, None) for k in range(300)] + [(None, None, None, None, 1), (None, "", None, None, 1), (5, None, None, "s", None)]
    rows += [(None, "without an id", None, None, None)] * 50 + [(77, "again", None, None, None)] * 3 + [(78, "long " * 50_000, None, None, None)]
    for shards in (1, 5, 24):
        assert got(spark, rows, shards) == brute_force(rows, shards)


def test_equal_sizes_are_near_equal(spark):
    rows = [(k, f"{k:06d}", None, None, None) for k in range(1000)]
    loads = Counter(r[4] for r in got(spark, rows, 24))
    assert max(loads.values()) - min(loads.values()) == 1 and len(loads) == 24


def test_no_documents(spark):
    assert got(spark, [], 24) == []
