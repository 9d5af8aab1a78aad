"""Centroid clustering (Lloyd's rounds) by kd-tree filtering, in exact integers.

A component x becomes floor(scale * x).  Each partition's vectors become kd-trees of at
most TREE_ROWS rows, whose nodes hold counts, integer sums, sums of squares and boxes.
The trees are written once; every round reads them.  A round goes down a tree with the
centroids that may still be nearest.  Of these the one nearest the middle of a node's box
meets each other one at the corner of the box that suits the other best; where the other
is farther even there, strictly, it is pruned.  A node with one centroid left goes to it
whole, by its sums.  Leaves compare their vectors with the centroids left.

Tasks return sums by centroid and component, split in limbs of 32 bits that are added as
longs, so the driver gets a number of values that doesn't depend on the input.  Nothing
else leaves a task until the last assignment.  The inertia comes from the sums too.

Numbers are doubles where all of a tree's stay below 2**53, else Python's integers.

Defined results: vectors that are null, of another length, or hold null or non-finite
components are left out.  Ties go to the centroid with the smaller number; equal vectors
stay in one leaf.  Rows that repeat a vec_id count each; a start that repeats is taken as
often as its rows come.  A vector without an id comes after all others as a start.  With
fewer vectors than `k` there are fewer centroids, with none the result is empty.  Amounts
beyond 64 bits are null.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

K, ROUNDS, SCALE, DIMENSIONS, SEED = 16, 3, 64, 64, "1:"
TREE_ROWS, LEAF_ROWS = 8192, 32
#: Sums of TREE_ROWS squared distances of 64 such components stay below 2**53.
DOUBLE_BOUND = 1 << 16
LIMB = 32
#: Comes after every hexadecimal digest.
NO_HASH = "g"

_TREE = "vec_id array<bigint>, points binary, starts binary, ends binary, child binary, low binary, high binary, sums binary, squares binary"


def pack(a: np.ndarray) -> bytes:
    """Integers in the smallest size that holds them, or as decimal text."""
    if a.dtype == object:
        return b"O" + ",".join(map(str, a.ravel())).encode()
    top = float(np.abs(a).max()) if a.size else 0.0
    kind = next(k for k, most in (("b", 2**7), ("h", 2**15), ("i", 2**31), ("q", 2**63)) if top < most)
    return kind.encode() + a.astype(f"<{np.dtype(kind).str[1:]}").tobytes()


def unpack(data: bytes, width: int = 1) -> np.ndarray:
    """Rows of `width` numbers: doubles, or Python's integers."""
    if data[:1] == b"O":
        out = np.array([int(x) for x in data[1:].decode().split(",") if x], dtype=object)
    else:
        out = np.frombuffer(data, f"<{np.dtype(data[:1].decode()).str[1:]}", offset=1).astype(np.float64)
    return out.reshape(-1, width) if width > 1 else out


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly; as doubles where they're small."""
    if not x.size or np.abs(x).max() * scale < DOUBLE_BOUND:
        return np.floor(x * scale) + 0.0
    exact = [p * scale // q for p, q in (float(v).as_integer_ratio() for v in x.ravel())]
    return np.array(exact, dtype=object).reshape(x.shape)


def kept_rows(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, components as doubles) of the vectors of that many components, all finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False).to_numpy(zero_copy_only=False))
    flat = pc.cast(column.take(pa.array(rows)).flatten(), pa.float64())
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    good = (np.isfinite(values) & ~missing).reshape(-1, dimensions).all(axis=1)
    return rows[good], values.reshape(-1, dimensions)[good]


@dataclass
class Tree:
    """Rows in the order of the leaves; nodes as ranges of them. child: the first of two, or -1."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
        """The tree, and which row came to each place."""
        order = np.arange(len(points))
        starts, ends, child, low, high, k = [0], [len(points)], [], [], [], 0
        while k < len(starts):
            a, b = starts[k], ends[k]
            part = points[order[a:b]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            widest = int(np.argmax(high[k] - low[k]))
            if b - a > leaf_rows and high[k][widest] > low[k][widest]:
                order[a:b] = order[a:b][np.argsort(part[:, widest], kind="stable")]
                child.append(len(starts))
                middle = (a + b) // 2
                starts += [a, middle]
                ends += [middle, b]
            else:
                child.append(-1)
            k += 1
        points, starts, ends = points[order], np.array(starts), np.array(ends)
        upto = np.concatenate((points[:1] * 0, np.cumsum(points, axis=0)))
        norms = np.append(0, np.cumsum((points * points).sum(axis=1)))
        return cls(points, starts, ends, np.array(child), np.stack(low), np.stack(high), upto[ends] - upto[starts], norms[ends] - norms[starts]), order

    def packed(self) -> list[bytes]:
        return [pack(a) for a in vars(self).values()]

    @classmethod
    def unpacked(cls, data: list[bytes], width: int) -> Tree:
        points, starts, ends, child, low, high, sums, squares = data
        whole = [unpack(a).astype(np.int64) for a in (starts, ends, child)]
        return cls(unpack(points, width), *whole, unpack(low, width), unpack(high, width), unpack(sums, width), unpack(squares))

    def exact(self, centers: np.ndarray) -> tuple[Tree, np.ndarray]:
        """Both in doubles if those hold every sum, else in Python's integers."""
        if self.points.dtype != object and self.squares.dtype != object and np.abs(centers).max() < DOUBLE_BOUND:
            return self, centers.astype(np.float64)
        as_ints = lambda a: a if a.dtype == object else np.array([int(v) for v in a.ravel()], dtype=object).reshape(a.shape)
        return Tree(as_ints(self.points), self.starts, self.ends, self.child, *(as_ints(a) for a in (self.low, self.high, self.sums, self.squares))), as_ints(centers)


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all points from all centers."""
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ centers.T) + (centers * centers).sum(axis=1)[None, :]


def pruned(low: np.ndarray, high: np.ndarray, centers: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Without the centers that are strictly dominated everywhere in a node's box. alive: by node and center."""
    far = 4 * (centers * centers).sum(axis=1)[None, :] - 4 * ((low + high) @ centers.T)
    far = np.where(alive, far, far.max() + 1)
    best = centers[far.argmin(axis=1)][:, None, :]
    corner = np.where(centers[None, :, :] > best, high[:, None, :], low[:, None, :])
    # the squared distance of the corner from a center less that from the best one
    worse = ((centers[None, :, :] - best) * (centers[None, :, :] + best - 2 * corner)).sum(axis=2)
    return alive & ~(worse > 0)


def assigned(tree: Tree, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes assigned whole, the center of each, the center of each row of the other leaves or -1)."""
    owner = np.full(len(tree.points), -1)
    whole, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(centers)), bool)
    while len(nodes):
        alive = pruned(tree.low[nodes], tree.high[nodes], centers, alive)
        one = alive.sum(axis=1) == 1
        whole.append(nodes[one])
        to.append(alive[one].argmax(axis=1))
        nodes, alive = nodes[~one], alive[~one]
        leaf = tree.child[nodes] < 0
        for node, left in zip(nodes[leaf], alive[leaf]):
            a, b, left = tree.starts[node], tree.ends[node], np.flatnonzero(left)
            owner[a:b] = left[distances(tree.points[a:b], centers[left]).argmin(axis=1)]
        first = tree.child[nodes[~leaf]]
        nodes, alive = np.stack((first, first + 1), axis=1).ravel(), np.repeat(alive[~leaf], 2, axis=0)
    return np.concatenate(whole), np.concatenate(to), owner


def gathered(tree: Tree, centers: np.ndarray) -> np.ndarray:
    """By center: sums of the components, then of squares, then the count; Python's integers."""
    tree, centers = tree.exact(centers)
    whole, to, owner = assigned(tree, centers)
    out = np.zeros((len(centers), centers.shape[1] + 2), dtype=object)
    for c in range(len(centers)):
        nodes, rows = whole[to == c], tree.points[owner == c]
        sums = tree.sums[nodes].sum(axis=0) + rows.sum(axis=0)
        out[c] = [*(int(v) for v in sums), int(tree.squares[nodes].sum() + (rows * rows).sum()), int((tree.ends - tree.starts)[nodes].sum() + len(rows))]
    return out


def labels(tree: Tree, centers: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(center, squared distance) of each row."""
    tree, centers = tree.exact(centers)
    whole, to, owner = assigned(tree, centers)
    for node, c in zip(whole, to):
        owner[tree.starts[node] : tree.ends[node]] = c
    gap = tree.points - centers[owner]
    return owner, [int(v) for v in (gap * gap).sum(axis=1)]


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, limb) of an integer; limbs have its sign."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << LIMB) - 1))
        value, place = value >> LIMB, place + 1


def build_trees(vectors: DataFrame, vec_id: str, embedding: str, scale: int, dimensions: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows, values = kept_rows(batch.column(1), dimensions)
            for at in range(0, len(rows), TREE_ROWS):
                tree, order = Tree.build(whole_numbers(values[at : at + TREE_ROWS], scale))
                ids = batch.column(0).take(pa.array(rows[at : at + TREE_ROWS][order])).to_pylist()
                columns = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in tree.packed())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", *vars(tree)])

    return vectors.select(F.col(vec_id).cast("bigint"), embedding).mapInArrow(run, _TREE)


def _trees(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[list, Tree]]:
    for k in range(batch.num_rows):
        yield batch.column(0)[k].as_py(), Tree.unpacked([batch.column(c)[k].as_py() for c in range(1, batch.num_columns)], dimensions)


def first_centroids(trees: DataFrame, k: int, seed: str, dimensions: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and id, in that order; equal hashes by their components."""

    def run(batches):
        for batch in batches:
            for ids, tree in _trees(batch, dimensions):
                hashed = [(NO_HASH if i is None else hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), r) for r, i in enumerate(ids)]
                least = sorted(hashed)[:k]
                ties = [x for x in hashed if least and x[0] == least[-1][0] and x not in least]
                rows = sorted((h, [int(v) for v in tree.points[r]]) for h, r in [*least, *ties])[:k]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([",".join(map(str, v)) for _, v in rows], pa.string())], names=["hash", "point"])

    rows = trees.mapInArrow(run, "hash string, point string").orderBy("hash", "point").limit(k).collect()
    return np.array([[int(v) for v in r["point"].split(",")] for r in rows], dtype=object).reshape(-1, dimensions)


def round_sums(trees: DataFrame, centers: np.ndarray) -> np.ndarray:
    """`gathered` over all trees."""
    dimensions = centers.shape[1]

    def run(batches):
        total = np.zeros((len(centers), dimensions + 2), dtype=object)
        for batch in batches:
            for _, tree in _trees(batch, dimensions):
                total = total + gathered(tree, centers)
        rows = [(c, j, place, limb) for c, j in np.ndindex(*total.shape) for place, limb in limbs(total[c, j])]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "part", "place", "limb"])

    out = np.zeros((len(centers), dimensions + 2), dtype=object)
    # a row for each cluster, component and limb, whatever the input's size
    for r in trees.mapInArrow(run, "cluster int, part int, place int, limb bigint").groupBy("cluster", "part", "place").agg(F.sum("limb").alias("limb")).collect():
        out[r["cluster"], r["part"]] += r["limb"] << (LIMB * r["place"])
    return out


def cluster(vectors: DataFrame, scratch: Scratch, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector that is kept."""
    trees = scratch.keep(build_trees(vectors, vec_id, embedding, scale, dimensions))
    centers = first_centroids(trees, k, seed, dimensions)
    for _ in range(rounds if len(centers) else 0):
        sums = round_sums(trees, centers)
        for c in np.flatnonzero(sums[:, -1]):
            centers[c] = [s // sums[c, -1] for s in sums[c, :dimensions]]
    sums = round_sums(trees, centers) if len(centers) else np.zeros((0, dimensions + 2), dtype=object)
    spread = [int(s[dimensions] - 2 * (s[:dimensions] * c).sum() + s[-1] * (c * c).sum()) for s, c in zip(sums, centers)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    fits = lambda v: v if v < 1 << 63 else None

    def run(batches):
        for batch in batches:
            for ids, tree in _trees(batch, dimensions):
                owner, distance = labels(tree, centers)
                columns = (ids, owner, [fits(v) for v in distance], [fits(spread[c]) for c in owner], [fits(sum(spread))] * len(ids), [digests[c] for c in owner])
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return trees.mapInArrow(run, "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
