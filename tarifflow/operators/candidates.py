"""The first candidates of many names in a catalogue by edit similarities, exactly and without scoring all pairs.

A part of the catalogue becomes an index: for each choice its sizes, its character counts
as bits (one word a level, so that common characters are a population count), and for
each word the choices that hold it.  From these each similarity of a name with every
choice is bounded.  The choices with the highest bounds are scored; their scores set a
bar for each similarity; others that may reach it get a closer bound from their longest
common subsequence; only those that still may are scored, the highest bounds first.

Names and choices meet on a grid: choices in parts of bounded size, names in batches, a
task for each part and batch.  A task returns the first of each similarity only, and an
aggregate over the parts picks the first of all.

Equal scores go by `ordinal`, then by the choice.  Null names and choices have no
candidates; empty ones are compared like others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import edit
from ..functions.similarity import SCORERS

PART_BYTES, BATCH_NAMES = 8 << 20, 16
LEVELS, BUCKETS = 4, 64


@dataclass
class Profile:
    """Character counts of texts in BUCKETS buckets: bits[k] has those that occur more than k times, `over` what exceeds LEVELS."""

    bits: np.ndarray
    over: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: edit.Texts, alphabet: np.ndarray) -> Profile:
        """alphabet: sorted code points with a bucket of their own; all others share the last."""
        at = np.minimum(np.searchsorted(alphabet, texts.codes), max(len(alphabet) - 1, 0))
        bucket = np.where(alphabet[at] == texts.codes, at, BUCKETS - 1) if len(alphabet) else np.full(len(texts.codes), BUCKETS - 1)
        counts = np.bincount(np.repeat(np.arange(len(texts.sizes)), texts.sizes) * BUCKETS + bucket, minlength=len(texts.sizes) * BUCKETS).reshape(-1, BUCKETS)
        bits = np.stack([np.packbits(counts > k, axis=1).view(np.uint64)[:, 0] for k in range(LEVELS)])
        return cls(bits, np.maximum(counts - LEVELS, 0).sum(axis=1), texts.sizes)

    def common(self, other: Profile, k: int) -> np.ndarray:
        """No fewer than the characters that each text shares with the k-th of `other`."""
        shared = np.minimum(self.over, other.over[k])
        for mine, its in zip(self.bits, other.bits[:, k]):
            shared += np.bitwise_count(mine & its)
        return np.minimum(shared, np.minimum(self.sizes, other.sizes[k]))


class Index:
    """Choices in the order in which equal scores go."""

    def __init__(self, choices: list[str]):
        self.names = edit.Names(choices)
        points, counts = np.unique(self.names.text.codes, return_counts=True)
        self.alphabet = np.sort(points[np.argsort(-counts, kind="stable")[: BUCKETS - 1]])
        self.text, self.sorted, self.distinct = self._profiles(self.names)
        word, row = [w for ws in self.names.words for w in ws], np.repeat(np.arange(len(choices)), [len(ws) for ws in self.names.words])
        self.words = np.array([len(ws) for ws in self.names.words], np.int64)
        found, place = np.unique(np.array(word, dtype=object), return_inverse=True) if word else (np.zeros(0, object), np.zeros(0, np.int64))
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(len(found) + 1))
        self.holding = {w: row[order[a:b]] for w, a, b in zip(found, cuts[:-1], cuts[1:])}
        #: Pairs that have been scored.
        self.scored = 0

    def _profiles(self, names: edit.Names) -> tuple[Profile, Profile, Profile]:
        return tuple(Profile.of(t, self.alphabet) for t in (names.text, names.sorted, names.distinct))

    def _bounds(self, names: edit.Names, profiles: tuple[Profile, Profile, Profile], k: int) -> np.ndarray:
        """By scorer and choice, no less than the score of the k-th name."""
        text, ordered, distinct = profiles
        m, n = names.text.sizes[k], self.text.sizes
        common, short = self.text.common(text, k), np.minimum(m, n)
        most = np.where(short > 0, edit.ratio(common, short, common), (m == n).astype(float))
        sort = edit.ratio(self.sorted.common(ordered, k), self.sorted.sizes, ordered.sizes[k])
        one, two = distinct.sizes[k], self.distinct.sizes
        sets = np.where((one > 0) & (two > 0), edit.ratio(self.distinct.common(distinct, k), one, two), 0.0)
        shared, letters = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for word in names.words[k]:
            rows = self.holding.get(word)
            if rows is not None:
                shared[rows] += 1
                letters[rows] += len(word)
        rows = np.flatnonzero(shared)
        both = (letters + shared - 1)[rows]
        best = np.maximum(np.maximum(sets[rows], edit.ratio(both, both, one)), edit.ratio(both, both, two[rows]))
        sets[rows] = np.where((shared[rows] == len(names.words[k])) | (shared[rows] == self.words[rows]), 1.0, best)
        return np.stack((edit.weighted(edit.ratio(common, m, n), sets, sort, most, m, n), sets, sort, most))

    def search(self, names: list[str], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, choice, scores) of the pairs that are among the first `limit` of any scorer."""
        parts = [self._search(edit.Names(names[a : a + BATCH_NAMES]), limit, a) for a in range(0, len(names), BATCH_NAMES)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(SCORERS))))

    def _search(self, names: edit.Names, limit: int, first: int):
        profiles, n = self._profiles(names), len(names.names)
        rows = [np.zeros(0, np.int64)] * n  # scored
        values = [np.zeros((0, len(SCORERS)))] * n
        bounds = [self._bounds(names, profiles, k) for k in range(n)]
        open_rows = [np.arange(len(self.words))] * n
        turn = 0
        while True:
            chosen = [np.unique(np.concatenate([r[_highest(x, 2 * limit << turn)] for x in b])) if len(r) else r for r, b in zip(open_rows, bounds)]
            pair = np.repeat(np.arange(n), [len(c) for c in chosen]), np.concatenate(chosen)
            if not len(pair[0]):
                break
            found = edit.scores(names, self.names, *pair)
            self.scored += len(found)
            for k in range(n):
                rows[k], values[k] = np.concatenate((rows[k], chosen[k])), np.concatenate((values[k], found[pair[0] == k]))
                left = ~np.isin(open_rows[k], chosen[k], assume_unique=True)
                open_rows[k], bounds[k] = open_rows[k][left], bounds[k][:, left]
            closer = (self._by_subsequence, self._by_ends) if turn == 0 else ()
            for bound in (None, *closer):
                for k in range(n):
                    if bound is not None:
                        bounds[k] = bound(names, k, open_rows[k], bounds[k])
                    left = self._may(open_rows[k], bounds[k], rows[k], values[k], limit)
                    open_rows[k], bounds[k] = open_rows[k][left], bounds[k][:, left]
            turn += 1
        taken = [np.unique(np.concatenate([np.lexsort((r, -v))[:limit] for v in x.T])) for r, x in zip(rows, values)]
        owner = first + np.repeat(np.arange(n), [len(t) for t in taken])
        return owner, np.concatenate([r[t] for r, t in zip(rows, taken)]), np.concatenate([v[t] for v, t in zip(values, taken)])

    def _by_subsequence(self, names: edit.Names, k: int, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bounds of the k-th name with choices from their longest common subsequence."""
        common = edit.subsequences(names, self.names, np.full(len(rows), k), rows)
        m, n = names.text.sizes[k], self.names.text.sizes[rows]
        short = np.minimum(m, n)
        most = np.where(short > 0, edit.ratio(common, short, common), bounds[3])
        return np.stack((edit.weighted(edit.ratio(common, m, n), bounds[1], bounds[2], most, m, n), bounds[1], bounds[2], most))

    def _by_ends(self, names: edit.Names, k: int, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bounds that know the sorted words, the windows at the ends, and runs of a few windows each."""
        ratio, sort, most = edit.ratios(names, self.names, np.full(len(rows), k), rows).T
        m, n = names.text.sizes[k], self.names.text.sizes[rows]
        # without common and repeated words the words as sets are the sorted words
        apart = np.ones(len(self.words), bool)
        for word in names.words[k]:
            apart[self.holding.get(word, [])] = False
        apart = apart[rows] & (names.sorted.sizes[k] == names.distinct.sizes[k]) & (self.names.sorted.sizes[rows] == self.names.distinct.sizes[rows])
        sets = np.where(apart & (bounds[1] > 0), sort, bounds[1])
        return np.stack((edit.weighted(ratio, sets, sort, most, m, n), sets, sort, most))

    @staticmethod
    def _may(rows: np.ndarray, bounds: np.ndarray, scored: np.ndarray, values: np.ndarray, limit: int) -> np.ndarray:
        """Whether rows may still be among the first of any scorer."""
        out = np.zeros(len(rows), bool)
        for bound, value in zip(bounds, values.T):
            if len(value) < limit:
                return np.ones(len(rows), bool)
            last = np.lexsort((scored, -value))[limit - 1]
            out |= (bound > value[last]) | ((bound == value[last]) & (rows < scored[last]))
        return out


def _highest(bounds: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest bounds, the first of equal ones."""
    if len(bounds) <= n:
        return np.arange(len(bounds))
    least = np.partition(bounds, len(bounds) - n)[len(bounds) - n]
    above = np.flatnonzero(bounds > least)
    return np.concatenate((above, np.flatnonzero(bounds == least)[: n - len(above)]))


def nearest(queries: DataFrame, choices: DataFrame, limit: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """query, the columns of `choices` (choice, ordinal, ...) and SCORERS: for each query a part's first `limit` choices by each scorer.

    Nothing else of a part can be among the first `limit` of all choices.
    """
    spark = queries.sparkSession
    choices = choices.where("choice IS NOT NULL")
    size = choices.agg(F.sum(F.octet_length("choice") + 64)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    batches = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // parts))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    asked = queries.where("query IS NOT NULL").select("query", F.pmod(F.xxhash64("query"), F.lit(batches)).cast("int").alias("_batch"), numbers(parts).alias("_part"))
    held = choices.select("*", F.pmod(F.xxhash64("choice"), F.lit(parts)).cast("int").alias("_part"), numbers(batches).alias("_batch"))
    columns = choices.columns
    fields = [T.StructField("query", T.StringType()), *choices.schema.fields, *(T.StructField(s, T.DoubleType()) for s in SCORERS)]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.select(columns).sort_by([(c, "ascending") for c in ("ordinal", "choice")])
        names, found = left["query"].to_pylist(), right["choice"].to_pylist()
        owner, row, scores = Index(found).search(names, limit) if names and found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(SCORERS))))
        taken = right.take(pa.array(row))
        arrays = [left["query"].take(pa.array(owner)), *(taken[c] for c in columns), *(pa.array(s) for s in scores.T)]
        return pa.table(arrays, names=["query", *columns, *SCORERS])

    grid = ("_part", "_batch")
    return asked.groupBy(*grid).cogroup(held.groupBy(*grid)).applyInArrow(search, T.StructType(fields))
