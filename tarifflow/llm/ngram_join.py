"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row per document and a column per word n-gram.  Documents with equal
n-gram sets are one row.  For a threshold t, rows of sizes p <= q can only link if
p >= t q and their overlap reaches t/(1+t) (p + q); so under any fixed order of columns
two linked rows share a column among the first n - ceil(t n) + 1 of each.  Only those
entries are multiplied:

1. Columns that many documents of a task share are counted; the MAX_COMMON most frequent
   come last in the column order.  The order decides cost, never results.
2. Tasks send their entries, packed in arrays by column block.  In a block, a column of
   one row is dropped and one of up to CROWD rows multiplied out; products are summed over
   blocks to the number of leading columns that a pair shares.  With c of them the whole
   overlap is below c + ceil(t q), q the larger size; pairs that can't reach the bound go.
   A column of more than CROWD rows among what a task holds sends its block a mark only;
   its entries go to other groups, which pass them on, so no group gathers such a column.
3. The overlap of the others is accumulated over both whole rows.
4. Columns of more rows aren't multiplied out.  First each row is held against one row of
   the column.  Then columns whose rows are all in one component are done.  Of the rest,
   rows are dealt to blocks by the largest such column that they have, by size and by the
   number of such columns; blocks that share a column meet unless all their rows are
   linked already or no sizes in them can reach the bound of step 2.  What meets are
   sketches: counts of the n-grams by hash, 1/64 to 1/32 of a set; the sum of the smaller
   counts is at least the overlap.  Only rows that may link by that are sent whole, to
   dense tiles, which return a spanning forest of their links.

No link between different components is lost, and a group of near copies costs a few
comparisons a row.

Defined results: null texts, empty ones and texts of white space have n_shingles 0 and
are linked with nothing.  Texts of fewer than n words have one n-gram.  Repeated rows
give repeated results.  Different texts under one id are rows of their own.  Texts
without an id link like others; a component's name is the smallest id in it, null if it
has none.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .scratch import Scratch, setting
from .text import SHINGLE_WORDS, mix, pieces, shingle_sets

#: The threshold as a fraction: 4 overlap-units of 5.
TIMES, OF = 4, 5
MAX_COMMON = 500_000
CROWD, TILE, ROUNDS = 32, 128, 2
#: Entries that a task holds before it sends them, and those of a block.
_BUFFER, _BLOCK = 400_000, 150_000
#: The size in an entry that only says that its column is crowded.
_MARK = -1
#: Columns are counted by 32 bits, over so many entries; those that occur less often in them aren't reported.
_COUNTED, _OFTEN = 5_000_000, 4
#: Bits that stand for the documents whose sets are fetched, at most; those that share a bit with one are dropped later.
_SLOTS = 1 << 27
#: Bands of sizes within a factor of 1 / threshold.
_BANDS = 8
#: A sketch has 4 to 8 n-grams a count, and so many counts at least; counts from _FULL on are unknown.
_PER_COUNT, _COUNTS, _FULL = 8, 16, 255
#: Whole sets that are sent to tiles at a time: as a part of all sets, and bytes at least.
_AT_ONCE, _AT_ONCE_BYTES = 0.2, 1 << 27


def row_id(grams: np.ndarray) -> int:
    """64 bits that stand for a set; with 10**9 different sets two agree with probability below 3 %."""
    return int((np.add.reduce(mix(grams ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(grams))).view(np.int64)) if len(grams) else 0


def sketch(grams: np.ndarray) -> bytes:
    """Counts of the n-grams by their last bits."""
    size = _COUNTS
    while size * _PER_COUNT < len(grams):
        size *= 2
    return np.minimum(np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size), _FULL).astype(np.uint8).tobytes()


def most_common(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each two sketches of `left` and `right`, a number that the overlap of their sets doesn't exceed."""
    size = min(len(s) for s in (*left, *right))

    def folded(sketches: list[bytes]) -> np.ndarray:
        counts = [np.frombuffer(s, np.uint8).astype(np.int32) for s in sketches]
        return np.array([np.where(c == _FULL, 1 << 20, c).reshape(-1, size).sum(0) for c in counts])

    one, two = folded(left), folded(right)
    return np.array([np.minimum(s, two).sum(1) for s in one])


def document_rows(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(doc_id, digest, n, row, sketch): digest of the text, set size, row and sketch of each document."""

    def run(batches):
        for batch in batches:
            sets = [(len(s), row_id(s), sketch(s)) for s in shingle_sets(batch.column(2), words)]
            n, row, counts = zip(*sets) if sets else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(row, pa.int64()), pa.array(counts, pa.binary())], names=["doc_id", "digest", "n", "row", "sketch"])

    return docs.select(F.col(doc_id).cast("bigint"), text_digest(text), text).mapInArrow(run, "doc_id bigint, digest bigint, n bigint, row bigint, sketch binary")


def text_digest(text: str = "text"):
    """64 bits of a text; texts of one id are told apart by them."""
    return F.xxhash64(F.col(text))


def common_columns(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """The first 32 bits of the most frequent n-grams, at most MAX_COMMON, sorted."""

    def run(batches):
        held, size = [], 0

        def counted():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= _OFTEN
            return pa.RecordBatch.from_arrays([pa.array(grams[often].astype(np.int64)), pa.array(counts[often])], names=["gram", "count"])

        for batch in batches:
            for grams in shingle_sets(batch.column(0), words):
                held.append(column_key(grams))
                size += len(grams)
                if size >= _COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = docs.select(text).mapInArrow(run, "gram bigint, count bigint").groupBy("gram").agg(F.sum("count").alias("count"))
    top = counts.orderBy(F.desc("count"), "gram").limit(MAX_COMMON).select("gram").toArrow()
    return np.sort(top["gram"].to_numpy().astype(np.uint32))


def column_key(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(32)).astype(np.uint32)


def prefix_size(n: int) -> int:
    return n - -(-TIMES * n // OF) + 1


def entries(docs: DataFrame, text: str, words: int, common: np.ndarray, blocks: int) -> DataFrame:
    """(block, columns, rows, sizes): the leading entries of every row, packed; blocks from `blocks` on have entries of crowded columns."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        last = shared.value
        held: list[tuple] = []
        size = 0

        def packed():
            column = np.concatenate([h[0] for h in held])
            counts = [len(h[0]) for h in held]
            row = np.repeat(np.array([h[1] for h in held], np.int64), counts)
            n = np.repeat(np.array([h[2] for h in held], np.int32), counts)
            block = (mix(column ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(blocks)).astype(np.int64)
            order = np.lexsort((row, column, block))
            column, row, n, block = column[order], row[order], n[order], block[order]
            new = np.ones(len(order), bool)
            new[1:] = (column[1:] != column[:-1]) | (row[1:] != row[:-1])
            column, row, n, block = column[new], row[new], n[new], block[new]
            starts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
            counts = np.diff(np.append(starts, len(column)))
            many = np.repeat(counts > CROWD, counts)
            marks = starts[counts > CROWD]
            # apart from their column, in parts that go to any group
            spread = np.arange(int(many.sum())) // _BLOCK
            spread = blocks + (mix(row[:1].view(np.uint64) + spread.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            column, row, n, block = (
                np.concatenate(x)
                for x in ((column[~many], column[marks], column[many]), (row[~many], np.zeros(len(marks), np.int64), row[many]), (n[~many], np.full(len(marks), _MARK, np.int32), n[many]), (block[~many], block[marks], spread))
            )
            order = np.argsort(block, kind="stable")
            column, row, n, block = column[order], row[order], n[order], block[order]
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(cuts[1:], len(block))
            return pa.RecordBatch.from_arrays([pa.array(block[cuts].astype(np.int32)), *(pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for v in (column, row, n))], names=["block", "columns", "rows", "sizes"])

        for batch in batches:
            for grams in shingle_sets(batch.column(0), words):
                if not len(grams):
                    continue
                need, late = prefix_size(len(grams)), np.zeros(len(grams), bool)
                if len(last):
                    keys = column_key(grams)
                    late = last[np.minimum(np.searchsorted(last, keys), len(last) - 1)] == keys
                lead = grams[~late][:need]
                if len(lead) < need:
                    lead = np.concatenate([lead, grams[late][: need - len(lead)]])
                held.append((lead, row_id(grams), len(grams)))
                size += need
                if size >= _BUFFER:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return docs.select(text).mapInArrow(run, "block int, columns binary, rows binary, sizes binary")


def _multiply(table: pa.Table, blocks: int) -> pa.Table:
    """Of one block: pairs of rows with their products (kind 0: a, b, sizes n and m, count), and the entries of crowded columns (kind 1: column a, row b, size n).

    Blocks from `blocks` on have entries of crowded columns only.
    """
    column, row, n = (np.concatenate([np.frombuffer(v, t) for v in table[k].to_pylist()]) for k, t in (("columns", np.uint64), ("rows", np.int64), ("sizes", np.int32)))
    order = np.lexsort((row, column))
    column, row, n = column[order], row[order], n[order]
    new = np.ones(len(order), bool)
    new[1:] = (column[1:] != column[:-1]) | (row[1:] != row[:-1])
    column, row, n = column[new], row[new], n[new]
    starts = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
    counts = np.diff(np.append(starts, len(column)))
    full = (counts > CROWD) | np.logical_or.reduceat(n == _MARK, starts) | (table["block"][0].as_py() >= blocks)
    crowded = np.repeat(full, counts) & (n != _MARK)
    counts = np.where(full, CROWD + 1, counts)
    left, right = [], []
    for k in range(2, CROWD + 1):
        at = starts[counts == k]
        if len(at):
            i, j = np.triu_indices(k, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            fit = np.minimum(n[a], n[b]) * OF >= np.maximum(n[a], n[b]) * TIMES
            left.append(a[fit])
            right.append(b[fit])
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    order = np.lexsort((row[b], row[a]))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate(([True], (row[a[1:]] != row[a[:-1]]) | (row[b[1:]] != row[b[:-1]])))) if len(a) else a
    products = np.diff(np.append(first, len(a)))
    a, b = a[first], b[first]
    many, none = np.flatnonzero(crowded), np.zeros(int(crowded.sum()), np.int32)
    return pa.table(
        {
            "kind": np.concatenate([np.zeros(len(a), np.int32), none + 1]),
            "a": np.concatenate([row[a], column[many].view(np.int64)]),
            "b": np.concatenate([row[b], row[many]]),
            "n": np.concatenate([n[a], n[many]]),
            "m": np.concatenate([n[b], none]),
            "count": np.concatenate([products.astype(np.int64), none]),
        }
    )


def links(common: np.ndarray | int, n, m):
    """Whether an overlap of `common` links rows of sizes n and m."""
    return common * (TIMES + OF) >= TIMES * (n + m)


def can_link(shared, n, m):
    """Whether rows of sizes n and m that share so many leading columns can link, as columns."""
    return links(shared + F.ceil(F.greatest(n, m) * TIMES / OF) - 1, n, m)


def _blocks_can_link(shared: str, small: str, large: str) -> str:
    """`can_link` for a smaller and a larger size, rounded up, as SQL over bounds."""
    return f"{OF * (TIMES + OF)} * ({shared} - 1) + {(TIMES + OF) * (OF - 1)} + {TIMES * TIMES} * {large} >= {OF * TIMES} * {small}"


def _may_link(batches):
    """Pairs (a, b, both sizes) whose sketches let them link."""
    for batch in batches:
        one, two, both = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(2).to_pylist()
        keep = [bool(links(int(most_common([x], [y])[0, 0]), n, 0)) for x, y, n in zip(one, two, both)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _unpacked(column: pa.ListArray) -> list[tuple]:
    """(rows, sizes, leading columns that are crowded, components, sketches) of each block."""
    at, held = column.offsets.to_numpy(), column.values
    rows, n, hidden, component = (held.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    return [(rows[a:b], n[a:b], hidden[a:b], component[a:b], held.field(4)[a:b].to_pylist()) for a, b in zip(at, at[1:])]


def _near(batches):
    """Of two blocks i and j (one, two), the rows that may link with one of the other block and another component."""
    for batch in batches:
        found: list[tuple[int, int, np.ndarray, int]] = []
        for i, j, one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(batch.column(2)), _unpacked(batch.column(3))):
            n, m = one[1][:, None], two[1][None, :]
            large = np.maximum(n, m)
            may = (one[3][:, None] != two[3][None, :]) & (np.minimum(n, m) * OF >= large * TIMES)
            may &= links(np.minimum(one[2][:, None], two[2][None, :]) - (-large * TIMES // OF) - 1, n, m)
            a, b = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if len(a):
                may = may[np.ix_(a, b)] & links(most_common([one[4][k] for k in a], [two[4][k] for k in b]), n[a], m[:, b])
                rows = one[0][a[may.any(1)]], two[0][b[may.any(0)]]
                if i == j:
                    rows = np.union1d(*rows), rows[1][:0]
                found += [(i, j, r, side) for side, r in enumerate(rows) if len(r)]
        counts = [len(r) for _, _, r, _ in found]
        column = lambda k, kind: pa.array(np.repeat(np.array([f[k] for f in found], kind), counts))
        yield pa.RecordBatch.from_arrays([column(0, np.int64), column(1, np.int64), pa.array(np.concatenate([np.zeros(0, np.int64), *(f[2] for f in found)])), column(3, np.int32)], names=["i", "j", "row", "side"])


def _overlaps(batches):
    for batch in batches:
        a, b, keep = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(links(common, len(x), len(y)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tile(table: pa.Table) -> pa.Table:
    """Links between the two sides of a tile, or within its rows if it has one: a spanning forest."""
    rows, side = table["row"].to_numpy(), table["side"].to_numpy()
    sets = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    columns, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(at, minlength=len(columns)) > 1
    place = np.cumsum(shared) - 1
    use = shared[at]
    matrix = np.zeros((len(sets), int(shared.sum())), np.float32)
    matrix[owner[use], place[at[use]]] = 1
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(two) == 0:
        two = one
    overlap = np.rint(matrix[one] @ matrix[two].T).astype(np.int64)
    i, j = np.nonzero(links(overlap, sizes[one][:, None], sizes[two][None, :]))
    i, j = one[i], two[j]
    root = forest(len(rows), i, j)
    moved = np.flatnonzero(root != np.arange(len(rows)))
    return pa.table({"a": rows[root[moved]], "b": rows[moved]})


class _Join:
    """State of one join: whole rows, and what is linked."""

    def __init__(self, docs: DataFrame, scratch: Scratch, doc_id: str, text: str, words: int):
        self.scratch, self.docs, self.words = scratch, docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), words
        self.rows = scratch.keep(document_rows(docs, doc_id, text, words))
        # by row: its smallest id, and one document that holds it
        self.firsts = scratch.keep(self.rows.where("n > 0").groupBy("row").agg(F.min("doc_id").alias("smallest"), F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest")))
        self.links: list[DataFrame] = []

    def gather(self, wanted: DataFrame) -> DataFrame:
        """(row, grams): the n-gram sets of the rows that may be compared. Documents that hold none of them aren't dealt out."""
        words, wanted = self.words, self.scratch.keep(wanted.distinct())
        first = self.firsts.join(wanted, "row", "left_semi").select(F.pmod(F.xxhash64("digest", "doc_id"), F.lit(_SLOTS)).alias("slot"))
        # at most _SLOTS / 64 rows
        marks = first.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
        bits = np.zeros(_SLOTS // 64, np.int64)
        bits[marks["at"].to_numpy()] = marks["bits"].to_numpy()
        shared = self.scratch.spark.sparkContext.broadcast(bits.view(np.uint64))

        def run(batches):
            for batch in batches:
                slot = batch.column(0).to_numpy()
                held = (shared.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                for p in pieces(batch.filter(pa.array(held)), 1):
                    sets = list(shingle_sets(p.column(1), words))
                    yield pa.RecordBatch.from_arrays([pa.array([row_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["row", "grams"])

        slot = F.pmod(F.xxhash64(text_digest(), "doc_id"), F.lit(_SLOTS)).alias("slot")
        sets = self.docs.select(slot, "text").mapInArrow(run, "row bigint, grams binary").join(wanted, "row", "left_semi").dropDuplicates(["row"])
        # bucketed by row: pairs come to the sets
        return self.scratch.bucketed(sets, "row", int(self.total >> 25))

    def compare(self, pairs: DataFrame) -> None:
        """Overlaps of (a, b) over the whole rows; keeps those that link."""
        both = pairs.join(self.sets.toDF("a", "grams_a"), "a").join(self.sets.toDF("b", "grams_b"), "b").select("a", "b", "grams_a", "grams_b")
        self.links.append(self.scratch.keep(both.mapInArrow(_overlaps, "a bigint, b bigint")))

    def labels(self) -> DataFrame:
        found = self.links[0]
        for more in self.links[1:]:
            found = found.unionByName(more)
        return components(found, self.scratch).select(F.col("id").alias("row"), "component")

    def crowd(self, entries: DataFrame, hidden: DataFrame) -> DataFrame:
        """Takes crowded columns (column, row, n) and how many of them a row has; the pairs (a, b) of rows with one row of a column that may link."""
        self.entries = self.scratch.keep(entries.join(hidden, "row").select("column", "row", "n", "hidden"))
        self.sketches = self.scratch.keep(self.rows.select("row", "sketch").join(hidden, "row").select("row", "sketch").dropDuplicates(["row"]))
        pairs = self.held_against(self.entries, 0).select("a", "b", "both")
        for turn in range(1, ROUNDS):
            pairs = pairs.unionByName(self.held_against(self.entries, turn).select("a", "b", "both"))
        one, two = self.sketches.toDF("a", "sketch_a"), self.sketches.toDF("b", "sketch_b")
        pairs = pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "both", "sketch_a", "sketch_b")
        self.candidates = self.scratch.keep(pairs.mapInArrow(_may_link, "a bigint, b bigint"))
        return self.candidates

    def held_against(self, entries: DataFrame, turn: int) -> DataFrame:
        """Entries with the row of that turn of their column, if its number of crowded columns and size let them link."""
        centre = F.min(F.struct(F.xxhash64("row", F.lit(turn)).alias("h"), "row", "n", "hidden")).alias("centre")
        at = entries.join(entries.groupBy("column").agg(centre), "column").where("row != centre.row")
        at = at.where(F.least("n", "centre.n") * OF >= F.greatest("n", "centre.n") * TIMES)
        # pairs that share columns which aren't crowded are judged by all of them
        at = at.where(can_link(F.least("hidden", "centre.hidden"), F.col("n"), F.col("centre.n")))
        return at.withColumns({"a": F.least("row", "centre.row"), "b": F.greatest("row", "centre.row"), "both": F.col("n") + F.col("centre.n")})

    def crowds(self) -> None:
        """Links of rows that share crowded columns."""
        entries = self.entries
        for turn in range(ROUNDS + 1):
            at = self.scratch.keep(entries.join(self.labels(), "row", "left").select("column", "row", "n", "hidden", F.coalesce("component", "row").alias("component")))
            # of columns whose rows are in more than one component
            mixed = at.groupBy("column").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("column")
            at = self.scratch.keep(at.join(mixed, "column"))
            if at.isEmpty():
                return
            entries = at.select("column", "row", "n", "hidden")
            if turn < ROUNDS:
                pairs = self.held_against(entries, turn).select("a", "b").distinct().join(self.candidates, ["a", "b"], "left_semi")
                labels = at.select("row", "component").distinct()
                pairs = pairs.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").where("x != y").select("a", "b")
                self.compare(self.scratch.keep(pairs))
        self._tiles(at)

    def _blocks(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of (column, row, n, hidden, component) by block, and the blocks (i, j) that meet."""
        sizes = entries.groupBy("column").agg(F.count("*").alias("size"))
        top = F.max(F.struct("size", "column"))["column"].alias("top")
        band = (F.floor(F.log("n") / math.log(OF / TIMES) * _BANDS).cast("int") * 64 + F.floor(F.log2("hidden")).cast("int")).alias("band")
        rows = self.scratch.keep(entries.join(sizes, "column").groupBy("row", "n", "hidden", "component", band).agg(top))
        # the largest component of a column has blocks of its own, which needn't meet each other
        counts = rows.groupBy("top", "band", "component").agg(F.count("*").alias("count"))
        largest = counts.groupBy("top", "band").agg(F.max(F.struct("count", "component")).alias("m"), F.sum("count").alias("all")).select("top", "band", F.col("m.component").alias("largest"), F.col("m.count").alias("majors"), (F.col("all") - F.col("m.count")).alias("minors"))
        major = F.col("component") == F.col("largest")
        chunk = F.pmod(F.xxhash64("row"), F.ceil(F.when(major, F.col("majors")).otherwise(F.col("minors")) / TILE))
        rows = self.scratch.keep(rows.join(largest, ["top", "band"]).select("row", "n", "hidden", "component", F.xxhash64("top", "band", major, chunk).alias("block")))
        bounds = rows.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("hidden").alias("most"))
        placed = self.scratch.keep(entries.select("column", "row").join(rows.select("row", "block"), "row").select("column", "block").distinct().join(bounds, "block"))
        one, two = placed.toDF("i", "column", "x1", "y1", "lo1", "hi1", "most1"), placed.toDF("j", "column", "x2", "y2", "lo2", "hi2", "most2")
        meet = one.join(two, "column").where("i <= j AND (x1 != y1 OR x2 != y2 OR x1 != x2)").where(f"hi1 * {OF} >= lo2 * {TIMES} AND hi2 * {OF} >= lo1 * {TIMES}")
        shared = "least(most1, most2)"
        meet = meet.where(f"{_blocks_can_link(shared, 'lo1', 'hi2')} OR {_blocks_can_link(shared, 'lo2', 'hi1')}")
        return rows, self.scratch.keep(meet.select("i", "j").distinct())

    def _tiles(self, entries: DataFrame) -> None:
        """Blocks that meet show each other sketches; what may link by them is compared whole, some tiles at a time."""
        rows, meet = self._blocks(entries)
        packed = self.scratch.keep(rows.join(self.sketches, "row").groupBy("block").agg(F.collect_list(F.struct("row", "n", "hidden", "component", "sketch")).alias("held")))
        pairs = meet.join(packed.toDF("i", "one"), "i").join(packed.toDF("j", "two"), "j").select("i", "j", "one", "two")
        with setting(self.scratch.spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "100"):
            near = self.scratch.keep(pairs.mapInArrow(_near, "i bigint, j bigint, row bigint, side int"))
        near = self.scratch.keep(near.join(rows.select("row", "n"), "row"))
        size = near.agg(F.sum("n")).first()[0] or 0
        if not size:
            return
        sets = self.gather(near.select("row"))
        try:
            turns = -(-8 * size // max(_AT_ONCE_BYTES, int(8 * self.total * _AT_ONCE)))
            for turn in range(turns):
                dealt = near.select("i", "j", "row", "side").where(F.pmod(F.xxhash64("i", "j"), F.lit(turns)) == turn)
                if turn:
                    # tiles whose rows have been linked since are done
                    at = dealt.join(self.labels(), "row", "left").select("i", "j", F.coalesce("component", "row").alias("component"))
                    dealt = dealt.join(at.groupBy("i", "j").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("i", "j"), ["i", "j"], "left_semi")
                dealt = dealt.join(sets, "row").select("i", "j", "row", "side", "grams")
                self.links.append(self.scratch.keep(dealt.groupBy("i", "j").applyInArrow(_tile, "a bigint, b bigint")))
        finally:
            self.scratch.drop(sets)


def jaccard_components(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, text_digest, group_key: one row per row of `docs`.

    group_key: the same for all rows of a component and of no other, null without shingles.
    """
    join = _Join(docs, scratch, doc_id, text, words)
    join.total = total = join.rows.agg(F.sum("n")).first()[0] or 0
    blocks = int(max(16, total // (OF * _BLOCK)))
    common = common_columns(docs, text, words)
    product = entries(docs, text, words, common, blocks).groupBy("block").applyInArrow(lambda t: _multiply(t, blocks), "kind int, a bigint, b bigint, n int, m int, count bigint")
    product = scratch.keep(product)
    # tasks may send the same entry of a crowded column to different groups
    crowded = scratch.keep(product.where("kind = 1").select(F.col("a").alias("column"), F.col("b").alias("row"), "n").distinct())
    hidden = scratch.keep(crowded.groupBy("row").agg(F.count("*").alias("hidden")))  # leading columns that products don't show
    pairs = product.where("kind = 0").groupBy("a", "b", "n", "m").agg(F.sum("count").alias("count"))
    pairs = pairs.join(hidden.toDF("a", "hidden_a"), "a", "left").join(hidden.toDF("b", "hidden_b"), "b", "left")
    shared = F.col("count") + F.least(F.coalesce("hidden_a", F.lit(0)), F.coalesce("hidden_b", F.lit(0)))
    pairs = scratch.keep(pairs.where(can_link(shared, F.col("n"), F.col("m"))).select("a", "b"))
    scratch.drop(product)
    wanted = pairs.unionByName(join.crowd(crowded, hidden))
    join.sets = join.gather(wanted.select(F.col("a").alias("row")).unionByName(wanted.select(F.col("b").alias("row"))))
    try:
        join.compare(pairs)
        join.crowds()
    finally:
        scratch.drop(join.sets)
    labels = join.labels()
    # sides that are read from tables: a hot row or component can be split among tasks
    named = scratch.keep(join.firsts.join(labels, "row").groupBy("component").agg(F.min("smallest").alias("component_id")))
    renamed = scratch.keep(labels.join(named, "component").select("row", "component", "component_id"))
    names = scratch.keep(join.firsts.join(renamed, "row", "left").select("row", F.coalesce("component", "row").alias("component"), F.when(F.col("component").isNull(), F.col("smallest")).otherwise(F.col("component_id")).alias("component_id")))
    return join.rows.join(names, "row", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("digest").alias("text_digest"),
        F.when(F.col("n") > 0, F.col("component")).alias("group_key"),
    )
