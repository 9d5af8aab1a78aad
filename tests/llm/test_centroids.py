import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarifflow.llm import centroids
from tarifflow.llm.scratch import Scratch

VECTORS = "vec_id bigint, embedding array<double>, cluster string, points int"


def brute_force(rows, k, rounds, scale, d):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * Fraction(x)) for x in v]))
    start = lambda x: (x[0] is None, hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1])
    centers = [v for _, v in sorted(kept, key=start)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centers)), key=lambda c: (far(v, centers[c]), c))
    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(nearest(v), []).append(v)
        for c, members in by.items():
            centers[c] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, nearest(v), far(v, centers[nearest(v)])) for i, v in kept]
    total = {c: sum(dist for _, o, dist in found if o == c) for _, c, _ in found}
    fits = lambda v: v if v < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()
    return sorted(((i, c, fits(dist), fits(total[c]), fits(sum(total.values())), digest(c)) for i, c, dist in found), key=repr)


def got(spark, rows, **options):
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    return sorted(map(tuple, centroids.cluster(frame, Scratch(spark, "t"), **options).collect()), key=repr)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 5), st.integers(1, 60), st.integers(1, 9), st.sampled_from([1, 3, 50, 10**12]))
def test_tree_assigns_like_all_pairs(seed, d, n, k, spread):
    rng = random.Random(seed)
    draw = lambda: [rng.randint(-spread, spread) for _ in range(d)]
    points, centers = np.array([draw() for _ in range(n)], dtype=object), np.array([draw() for _ in range(k)], dtype=object)
    kind = np.float64 if spread < centroids.DOUBLE_BOUND else object
    tree, order = centroids.Tree.build(points.astype(kind), leaf_rows=3)
    tree = centroids.Tree.unpacked(tree.packed(), d) if d > 1 else tree
    owner, distance = centroids.labels(tree, centers)
    far = [[sum((a - b) ** 2 for a, b in zip(p, c)) for c in centers] for p in points[order]]
    assert owner.tolist() == [min(range(k), key=lambda c: (row[c], c)) for row in far]
    assert distance == [min(row) for row in far]
    sums = centroids.gathered(tree, centers)
    for c in range(k):
        members = [p for p, o in zip(points[order], owner) if o == c]
        assert sums[c].tolist() == [*(sum(p[j] for p in members) for j in range(d)), sum(x * x for p in members for x in p), len(members)]


def test_boxes_prune_centers():
    points = np.array([[float(x), float(y)] for x in range(64) for y in range(64)])
    tree, _ = centroids.Tree.build(points)
    whole, _, owner = centroids.assigned(tree, np.array([[5.0, 5.0], [60.0, 9.0], [30.0, 60.0]]))
    assert (owner < 0).mean() > 0.7 and (tree.ends - tree.starts)[whole].sum() == (owner < 0).sum()


@given(st.integers(-(2**200), 2**200))
def test_limbs(value):
    assert sum(limb << (32 * place) for place, limb in centroids.limbs(value)) == value


def test_whole_rounds(spark):
    rng = random.Random(3)
    near = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(k, [x + rng.gauss(0, 0.1) for x in near[k % 6]], "x", k) for k in range(500)]
    rows += [(9000 + k, rows[5][1], None, None) for k in range(200)] + [(7, rows[5][1], None, 1)] * 3
    rows += [(1, None, "a", 1), (2, [], None, 2), (3, [1.0, 2.0], None, 3), (4, [1.0, None, 0.0, 0.0], None, 4), (5, [math.nan, 0.0, 0.0, 0.0], None, 5), (6, [math.inf, 0.0, 0.0, 0.0], None, 6), (None, near[0], None, 7)]
    assert got(spark, rows, k=5, dimensions=4) == brute_force(rows, 5, 3, 64, 4)


def test_few_and_no_vectors(spark):
    rows = [(None, [0.5, -0.5], None, None), (8, [0.25, 0.0], None, None), (8, [0.25, 0.0], None, None)]
    assert got(spark, rows, dimensions=2) == brute_force(rows, 16, 3, 64, 2)
    assert got(spark, rows, dimensions=3) == got(spark, []) == []


def test_huge_components(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([1e300, -1e308, 1e20, 0.3, 3e9]) * rng.random() for _ in range(3)], None, None) for k in range(60)]
    want = brute_force(rows, 4, 3, 64, 3)
    assert got(spark, rows, k=4, dimensions=3) == want and any(r[2] is None for r in want)
