"""Connected components of a graph given as an edge table, by random contraction.

In each round every vertex moves to the neighbour (or itself) with the smallest hash of
that round, and edges are rewritten to where their ends moved; the number of vertices
with edges falls by a constant factor a round in expectation.  All steps are
aggregations with map-side combining and equi-joins that can be split when skewed;
nothing is gathered per vertex and nothing but a count reaches the driver.  Once at most
LAST_EDGES edges are left, one task finishes them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


LAST_EDGES = 12_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indices by pairs (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            return label


def _finish(table: pa.Table) -> pa.Table:
    ends = np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()])
    ids, index = np.unique(ends, return_inverse=True)
    label = forest(len(ids), *np.split(index, 2))
    return pa.table({"id": ids, "to": ids[label]})


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id of `edges` (a, b); component is the smallest id reachable."""
    edges = scratch.keep(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while True:
        left = edges.count()
        if left <= LAST_EDGES:
            if left:
                moves.append(scratch.keep(edges.withColumn("last", F.lit(0)).groupBy("last").applyInArrow(_finish, "id bigint, to bigint")))
            break
        turn = F.lit(len(moves))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("id"))).alias("n"))
        own = F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("id"))
        move = scratch.keep(nearest.select(F.col("a").alias("id"), F.least("n", own)["id"].alias("to")))
        left, right = move.select(F.col("id").alias("a"), F.col("to").alias("ta")), move.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        following = scratch.keep(moved)
        scratch.drop(edges)
        edges = following
        moves.append(move)
    if not moves:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    at = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("id").alias("to"), F.col("to").alias("next"))
        at = at.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    at = scratch.keep(at)
    smallest = at.groupBy("to").agg(F.min("id").alias("component"))
    return scratch.keep(at.join(smallest, "to").select("id", "component"))
