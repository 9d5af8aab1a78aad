"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes.  Two with cosine >= t lie within
e = sqrt(2 - 2t) in every coordinate, so a grid of cell width e over the leading axes
sends each vector to its own cell and to the neighbour cells it can reach; only there
are pairs compared.  A cell is dealt out in tiles of bounded size.  A tile sums products
of the leading axes first, adds the product of the suffix norms as a bound of the rest,
and goes on only with pairs whose bound still reaches t.

Tiles return link counts and a spanning forest, never pairs.  Equal vectors are one
class that is compared once and counted with its size.

Defined results: vectors that are null, empty, zero, or hold null or non-finite values
link with nothing.  Vectors of different lengths link with nothing of another length.
Rows that repeat a vec_id are one vector if they agree, else they count as copies under
that id.  A vector without an id links like others; a component's name is the smallest
id in it, null if it has none.  An empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .scratch import Scratch

THRESHOLD = 0.95
#: Doubles of a side of a tile: a vector is sent once for each tile of its cell.
TILE_VALUES, LEADING, CHUNK = 1 << 19, 16, 256
SLACK = 1e-12


def _unit_rows(column: pa.Array) -> list[bytes | None]:
    out: list[bytes | None] = []
    for value in column:
        row = value.as_py()
        if not row or any(v is None for v in row):
            out.append(None)
            continue
        v = np.array(row, dtype=np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        v = v / top
        out.append((v / math.sqrt(float(v @ v)) + 0.0).tobytes())
    return out


def unit_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, unit): doubles of length one as bytes, null where the vector can't link."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_unit_rows(batch.column(1)), pa.binary())], names=["vec_id", "unit"])

    return df.select(F.col(vec_id).cast("bigint"), embedding).mapInArrow(run, "vec_id bigint, unit binary")


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the axes of the second-moment matrix over all rows, largest first."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            by: dict[int, list] = {}
            for u in batch.column(0).to_pylist():
                by.setdefault(len(u) // 8, []).append(np.frombuffer(u))
            for d, rows in by.items():
                m = np.stack(rows)
                sums[d] = sums.get(d, 0) + m.T @ m
        for d, s in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], names=["d", "i", "j", "v"])

    cells = units.select("unit").mapInArrow(run, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for d, part in cells.groupby("d"):
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = part["v"]
        axes[int(d)] = np.linalg.eigh(m + np.triu(m, 1).T)[1][:, ::-1].T.copy()
    return axes


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs between the rows of a and b, or within a (i < j) if b is None."""
    other = a if b is None else b
    d = a.shape[1]
    cuts = [*dict.fromkeys([0, min(LEADING, d), min(4 * LEADING, d), d])]
    square = [np.concatenate((np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(m), 1))), axis=1) for m in (a, other)]
    rest = [np.sqrt(np.maximum(s, 0)) for s in square]
    left, right = [], []
    for at in range(0, len(a), CHUNK):
        part = a[at : at + CHUNK]
        sums = part[:, : cuts[1]] @ other[:, : cuts[1]].T
        bound = sums + np.outer(rest[0][at : at + CHUNK, cuts[1]], rest[1][:, cuts[1]])
        i, j = np.nonzero(bound >= threshold - SLACK)
        if b is None:
            i, j = i[j > i + at], j[j > i + at]
        value = sums[i, j]
        for c, e in zip(cuts[1:-1], cuts[2:]):
            if not len(i):
                break
            for k in range(0, len(i), 1 << 18):
                s = slice(k, k + (1 << 18))
                value[s] += np.einsum("ij,ij->i", part[i[s], c:e], other[j[s], c:e])
            alive = value + rest[0][i + at, e] * rest[1][j, e] >= threshold - (SLACK if e < d else 0)
            i, j, value = i[alive], j[alive], value[alive]
        if len(cuts) == 2:
            i, j = i[value >= threshold], j[value >= threshold]
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(df: DataFrame, scratch: Scratch, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    units = scratch.keep(unit_vectors(df, vec_id, embedding).distinct())
    valid = units.where("unit IS NOT NULL")
    classes = scratch.keep(valid.groupBy("unit").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("size")).withColumn("rep", F.monotonically_increasing_id()))
    n = classes.count()
    axes = principal_axes(classes)
    width = math.sqrt(2 - 2 * threshold) + 1e-9
    depth = 2 + max(0, round(math.log(max(n, 1) / 200_000, 16)))
    shared = df.sparkSession.sparkContext.broadcast(axes)

    def deal(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("rep", "size", "y", "cell", "home")}
            for rep, size, unit in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                u = np.frombuffer(unit)
                y = shared.value[len(u)] @ u
                k = min(depth, len(y))
                cell = np.floor(y[:k] / width).astype(int)
                moves = [()]
                for x, c in zip(y[:k] / width, cell):
                    # squared distance to the neighbour cells, in cell widths
                    moves = [(*m, s) for m in moves for s in ((0, 0.0), (-1, (x - c) ** 2), (1, (c + 1 - x) ** 2))]
                for m in moves:
                    step = tuple(s[0] for s in m)
                    if step >= (0,) * k and sum(s[1] for s in m) <= 1 + 1e-6:
                        out["rep"].append(rep)
                        out["size"].append(size)
                        out["y"].append(y.tobytes())
                        out["cell"].append(f"{len(y)}:" + ",".join(str(c + s) for c, s in zip(cell, step)))
                        out["home"].append(not any(step))
            types = {"rep": pa.int64(), "size": pa.int64(), "y": pa.binary(), "cell": pa.string(), "home": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], names=list(types))

    dealt = scratch.keep(classes.select("rep", "size", "unit").mapInArrow(deal, "rep bigint, size bigint, y binary, cell string, home boolean"))
    # at most (2 / width + 2) ** depth cells a vector length
    parts = lambda kept: F.ceil(F.sum(F.when(kept, F.octet_length("y") / 8)) / TILE_VALUES)
    counts = dealt.groupBy("cell").agg(parts(F.col("home")).alias("homes"), F.coalesce(parts(~F.col("home")), F.lit(0)).alias("guests"))
    counts = scratch.keep(counts.where("homes > 0"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")))
    spread = dealt.join(counts, "cell").withColumn("own", own)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    within = F.transform(upto(F.col("homes")), lambda j: F.struct(F.lit("w").alias("kind"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.col("own").alias("side")))
    outward = F.transform(upto(F.col("guests")), lambda j: F.struct(F.lit("x").alias("kind"), F.col("own").alias("i"), j.alias("j"), F.lit(0).cast("bigint").alias("side")))
    inward = F.transform(upto(F.col("homes")), lambda i: F.struct(F.lit("x").alias("kind"), i.alias("i"), F.col("own").alias("j"), F.lit(1).cast("bigint").alias("side")))
    tiles = spread.select("rep", "size", "y", "cell", F.explode(F.when(F.col("home"), F.concat(within, outward)).otherwise(inward)).alias("t")).select("rep", "size", "y", "cell", "t.*")

    def compare(table: pa.Table) -> pa.Table:
        rep, size = table["rep"].to_numpy(), table["size"].to_numpy()
        y = np.stack([np.frombuffer(v) for v in table["y"].to_pylist()])
        side, kind, ij = table["side"].to_numpy(), table["kind"][0].as_py(), (table["i"][0].as_py(), table["j"][0].as_py())
        order = np.lexsort((rep, y[:, 0]))
        rep, size, y, side = rep[order], size[order], y[order], side[order]
        if kind == "w" and ij[0] == ij[1]:
            i, j = tile_links(y, None, threshold)
        else:
            one, two = np.flatnonzero(side == (ij[0] if kind == "w" else 0)), np.flatnonzero(side == (ij[1] if kind == "w" else 1))
            if not len(one) or not len(two):
                i = j = np.zeros(0, np.int64)
            else:
                i, j = tile_links(y[one], y[two], threshold)
                i, j = one[i], two[j]
        links = np.bincount(i, size[j], len(rep)) + np.bincount(j, size[i], len(rep)) if len(i) else np.zeros(len(rep))
        root = forest(len(rep), i, j)
        hit = links > 0
        return pa.table({"rep": rep[hit], "links": links[hit].astype(np.int64), "root": rep[root[hit]]})

    found = scratch.keep(tiles.groupBy("cell", "kind", "i", "j").applyInArrow(compare, "rep bigint, links bigint, root bigint"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch).select(F.col("id").alias("rep"), "component")
    names = scratch.keep(linked.join(classes.select("rep", "smallest"), "rep").groupBy("component").agg(F.min("smallest").alias("name")))
    named = scratch.keep(linked.join(names, "component"))
    joined = (
        classes.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(named, "rep", "left")
        .select("unit", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("component").isNull(), F.col("smallest")).otherwise(F.col("name")).alias("component"), "size")
    )
    joined = scratch.keep(joined)
    # a row's own copies are the others of its class
    per_row = valid.join(joined, "unit").select("vec_id", (F.col("links") + F.col("size") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = units.where("unit IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return per_row.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
