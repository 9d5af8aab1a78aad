"""Ranked lexical search: a blocked sparse product of items by terms and terms by documents.

A term is a maximal run of ASCII letters and digits and of code points from U+0080, with
only A-Z lower-cased.  Documents become blocks: of each block the terms that any item has,
with the documents that hold each and how often.  Blocks are written once and give the
counts of documents (N), of terms (L) and of documents by term (df).  A term's weight is
floor(1000 * ln((2N+2) / (2df+1))), its impact on a document of n terms
(10**9 * tf) div (1000 * tf + 8m) with m = 10 + (90 * n * N) div L, and a document's score
the sum of weight times impact over an item's terms, in 64-bit integers.

The product goes row by row (Gustavson): an item's row merges the rows of its terms in
the block.  A task keeps the best `k` of each item over its blocks and sends only those.

Items are handled in slices of about SLICE_BYTES of text, each broadcast as term hashes;
every slice reads the documents again.  Terms are 64-bit hashes (see `text`).

Defined results: null and empty documents, and those without a term, count nowhere and
are never found; items without a term find nothing.  Rows that repeat an item_id are one
item with the terms of all.  Equal scores go by doc_id, nulls last; repeated documents
each have a rank.  Empty tables give an empty result.  Whole texts are read; a single
text takes about 50 bytes of memory a byte.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decontaminate import lookup
from .scratch import Scratch
from .text import pieces, string_buffers, word_hashes

TOP = 10
SLICE_BYTES = 16 << 20
#: Entries of a product that are merged at once.
MAX_ENTRIES = 1 << 21

#: Bytes that are no part of a term become spaces.
_TERMS = np.arange(256, dtype=np.uint8)
_TERMS[[b for b in range(128) if not chr(b).isalnum()]] = 32

_BLOCK = "texts bigint, terms bigint, ids array<bigint>, sizes binary, keys binary, starts binary, docs binary, times binary"


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, first term of each text with the total last)."""
    offsets, data = string_buffers(column)
    return word_hashes(offsets, _TERMS[data])


@dataclass
class Items:
    """Items of one slice: ids, sorted distinct terms, and the terms of each item."""

    ids: list[int | None]
    terms: np.ndarray
    starts: np.ndarray
    term: np.ndarray

    @classmethod
    def read(cls, benchmark: DataFrame) -> Items:
        """From (item_id, text)."""

        def run(batches):
            for batch in (p for b in batches for p in pieces(b, 1)):
                hashes, at = term_hashes(batch.column(1))
                owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(hashes.view(np.int64))], names=["item_id", "term"])

        table = benchmark.mapInArrow(run, "item_id bigint, term bigint").distinct().toArrow()
        owners, hashes = table["item_id"].to_pylist(), table["term"].to_numpy().view(np.uint64)
        ids = sorted(set(owners), key=lambda i: (i is None, i or 0))
        number = {i: k for k, i in enumerate(ids)}
        item = np.array([number[i] for i in owners], np.int64)
        terms, term = np.unique(hashes, return_inverse=True)
        order = np.lexsort((term, item))
        return cls(ids, terms, np.searchsorted(item[order], np.arange(len(ids) + 1)), term[order])


@dataclass
class Block:
    """Documents with a term, and by term of an item the documents that hold it with the times."""

    ids: pa.Array
    sizes: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array, terms: np.ndarray) -> Block:
        hashes, at = term_hashes(texts)
        place, key = lookup(terms, hashes)
        doc = np.searchsorted(at, place, side="right") - 1
        kept = np.unique(doc)
        cells, times = np.unique(key * len(kept) + np.searchsorted(kept, doc), return_counts=True)
        keys, starts = np.unique(cells // max(len(kept), 1), return_index=True)
        return cls(ids.take(pa.array(kept)), np.diff(at)[kept], keys, np.append(starts, len(cells)), cells % max(len(kept), 1), times)

    def scores(self, items: Items, weights: np.ndarray, texts: int, terms: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first item, scores by item and document) for runs of items."""
        impact = impacts(self.times, middles(self.sizes, texts, terms)[self.docs]) * np.repeat(weights[self.keys], np.diff(self.starts))
        hit, row = lookup(self.keys, items.term)
        owner = np.searchsorted(items.starts, hit, side="right") - 1
        counts = np.diff(self.starts)[row]
        width, upto, a = len(self.ids), np.append(0, np.cumsum(counts)), 0
        most = max(1, MAX_ENTRIES // max(width, 1))
        while a < len(owner):
            # whole items, of about MAX_ENTRIES entries and as many sums
            b = int(np.searchsorted(upto, upto[a] + MAX_ENTRIES, side="right")) - 1
            b = min(b, int(np.searchsorted(owner, owner[a] + most)))
            b = int(np.searchsorted(owner, owner[b])) if b < len(owner) else b
            b = b if b > a else int(np.searchsorted(owner, owner[a] + 1))
            n = counts[a:b]
            entry = np.repeat(self.starts[row[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            first, last = int(owner[a]), int(owner[b - 1])
            cell = np.repeat(owner[a:b] - first, n) * width + self.docs[entry]
            yield first, merged(cell, impact[entry], (last - first + 1) * width).reshape(-1, width)
            a = b


def merged(cell: np.ndarray, value: np.ndarray, cells: int) -> np.ndarray:
    """Sums of values by cell, in 64-bit integers."""
    if value.sum(dtype=np.float64) < 2.0**52:  # no sum in doubles is rounded
        return np.bincount(cell, value, cells).astype(np.int64)
    out = np.zeros(cells, np.int64)
    np.add.at(out, cell, value)
    return out


def middles(sizes: np.ndarray, texts: int, terms: int) -> np.ndarray:
    """m of documents by their number of terms."""
    if 90 * int(sizes.max(initial=0)) * texts < 1 << 63:
        return 10 + 90 * sizes.astype(np.int64) * texts // max(terms, 1)
    return np.array([10 + 90 * int(n) * texts // terms for n in sizes], np.int64)


def impacts(times: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times.astype(np.int64) // (1000 * times + 8 * middle)


def weight(texts: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * texts + 2) / (2 * holding + 1)))


class Best:
    """The best k (score, then id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.int64())
        self.waiting: list[tuple] = []
        self.count = 0

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        item, doc = np.nonzero(scores >= self.least[first : first + len(scores), None])
        if len(item):
            self.waiting.append((item + first, scores[item, doc], ids.take(pa.array(doc))))
            self.count += len(item)
        if self.count > MAX_ENTRIES:
            self.reduce()

    def reduce(self) -> None:
        parts = [(self.item, self.score, self.id), *self.waiting]
        item, score = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        ids = pa.concat_arrays([p[2] for p in parts])
        missing, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        order = np.lexsort((value, missing, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order, last = order[place < self.k], order[place == self.k - 1]
        self.item, self.score, self.id = item[order], score[order], ids.take(pa.array(order))
        self.least[item[last]] = score[last]
        self.waiting, self.count = [], 0


def blocks_of(docs: DataFrame, items: Items) -> DataFrame:
    """Blocks of (doc_id, text)."""
    terms = docs.sparkSession.sparkContext.broadcast(items.terms)

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, 1)):
            _, at = term_hashes(batch.column(1))
            block = Block.of(batch.column(0), batch.column(1), terms.value)
            sizes = np.diff(at)
            whole = [block.sizes, block.keys, block.starts, block.docs, block.times]
            columns = [pa.array([int((sizes > 0).sum())]), pa.array([int(at[-1])]), pa.array([block.ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([a.astype(np.int32).tobytes()], pa.binary()) for a in whole)]
            yield pa.RecordBatch.from_arrays(columns, names=["texts", "terms", "ids", "sizes", "keys", "starts", "docs", "times"])

    return docs.mapInArrow(run, _BLOCK)


def _read(batches) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch.column(2)[k].values, *(np.frombuffer(batch.column(c)[k].as_py(), np.int32).astype(np.int64) for c in range(3, 8)))


def holding_counts(blocks: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each of the items' terms."""

    def run(batches):
        counts = np.zeros(terms, np.int64)
        for block in _read(batches):
            counts[block.keys] += np.diff(block.starts)
        term = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(counts[term])], names=["term", "n"])

    out = np.zeros(terms, np.int64)
    table = blocks.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[table["term"].to_numpy()] = table["n"].to_numpy()
    return out


def _search_slice(spark: SparkSession, texts: DataFrame, items: Items, scratch: Scratch, k: int) -> DataFrame:
    blocks = scratch.keep(blocks_of(texts, items))
    total = blocks.agg(F.sum("texts").alias("texts"), F.sum("terms").alias("terms")).first()
    n, length = total["texts"] or 0, total["terms"] or 0
    weights = np.array([weight(n, int(d)) for d in holding_counts(blocks, len(items.terms))], np.int64)
    shared = spark.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = shared.value
        best = Best(len(items.ids), k)
        for block in _read(batches):
            for first, scores in block.scores(items, weights, n, length):
                best.add(first, scores, block.ids)
        best.reduce()
        yield pa.RecordBatch.from_arrays([pa.array([items.ids[i] for i in best.item], pa.int64()), best.id, pa.array(best.score)], names=["item_id", "doc_id", "score"])

    return blocks.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tests = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    slices = -(-(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES) or 1
    found = None
    for part in range(slices):
        items = Items.read(tests.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == part))
        best = _search_slice(docs.sparkSession, texts, items, scratch, k)
        found = best if found is None else found.unionByName(best)
    # at most k rows for each item and task
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
