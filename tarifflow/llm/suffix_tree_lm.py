"""LM scoring with a probabilistic suffix tree over words.

Symbols are words and one end per text.  A context is up to `depth` words before a
symbol.  The next-symbol distribution of a context is smoothed with that of its suffix,
p(s | xc) = (n(xcs) + m p(s | c)) / (n(xc) + m), down to
p(s) = (n(s) + 0.5) / (N + 0.5 (V + 1)), which leaves a share for unknown words.

A context that occurs MIN_CONTEXT times or more in training is kept if it diverges from
its suffix by more than its own sampling: the sum over its training occurrences of
log p(s | xc) / p(s | c), with the occurrence itself left out of the counts, has to
exceed MIN_GAIN.  The sum is known without the other blocks where a context has one next
symbol only or all its occurrences are in one block, and nothing is sent of those that it
rules out.  A text is scored at each symbol in the state of the longest kept suffix.

N-grams of all training texts are counted, order by order: those of three words and more
only behind contexts that occur MIN_CONTEXT times, since no other can be kept, so what is
sent shrinks with the order.  Counts are on hashes: 64 bits for words and
log2(tokens) + 16 for longer ones, so at any size fewer than one n-gram in 2**14 shares
its count with another.  Documents are read into blocks of token numbers, and counts and
divergences are added up over blocks (see exchange); a block asks for the n-grams that it
holds and nothing grows with the corpus on one task or the driver.  An answer says too
whether another block has asked: what only one block holds is in no other n-gram of
another block, so of all that contains it the block's own counts and divergences are
those of the corpus, and nothing is sent.

What a block has been answered is stored beside it, so each answer is sent once and blocks
are written once.  The divergences of one order go with the counts of the next: of what
is sent, only one round's share lies on disk at a time.

Defined results: null and empty texts consist of the end alone.  Repeated rows give
repeated results and count as often as they occur.  Without training texts N and V are
0 and every score is that of the empty model.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .scratch import Scratch
from .text import crc_bucket, mix, slices, string_buffers, word_hashes

#: Larger blocks send fewer n-grams; at a million tokens an executor of 3,000 MB was exceeded.
BLOCK_TOKENS = 500_000
#: Words of the longest context.
DEPTH = 4
#: Two occurrences are the fewest that the divergence with one left out can test.
PRIOR, MIN_CONTEXT, MIN_GAIN = 3.0, 2, 2.0
END = np.uint64(0x1F83D9ABFB41BD6B)
#: Kinds of keys: k for n-grams behind contexts of k words, CONTEXT + k for those contexts.
CONTEXT = 64
#: ALONE + k: which n-grams behind contexts of k words no other block has asked for.
ALONE = 128
_STEP = np.uint64(0x9FB21C651E98DF25)

BLOCKS = "block bigint, docs array<bigint>, held array<boolean>, sizes array<int>, vocabulary binary, tokens binary"
KNOWN = "block bigint, kinds array<int>, answers array<binary>"

_BLOCK = {"block": pa.int64(), "docs": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "vocabulary": pa.binary(), "tokens": pa.binary()}
_KNOWN = {"block": pa.int64(), "kinds": pa.list_(pa.int32()), "answers": pa.list_(pa.binary())}


def read_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of token numbers from (doc_id, text, held)."""

    def run(batches):
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        ids, held, sizes, words = [], [], [], []

        def block():
            nonlocal count
            vocabulary, tokens = np.unique(np.concatenate(words), return_inverse=True)
            row = [[(task << 32) + count], [ids[:]], [held[:]], [sizes[:]], [X.pack_sorted(vocabulary)], [X.pack(tokens.astype(np.int32))]]
            count += 1
            for x in (ids, held, sizes, words):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _BLOCK.values())], names=list(_BLOCK))

        size = 0
        for batch in batches:
            offsets, data = string_buffers(batch.column(1))
            doc, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j in slices(offsets):
                hashes, at = word_hashes(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                words.append(np.insert(hashes, at[1:], END))
                sizes += (np.diff(at) + 1).tolist()
                ids += doc[i:j]
                held += out[i:j]
                size += len(words[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    size = 0
        if ids:
            yield block()

    return docs.mapInArrow(run, BLOCKS)


@dataclass
class Level:
    """Positions of a block behind a context of k words, and the n-grams that end there."""

    at: np.ndarray
    context: np.ndarray  # of each position, an index into the keys of the level before
    keys: np.ndarray  # sorted distinct n-grams
    index: np.ndarray  # of each position, into keys
    own: np.ndarray  # of each key, training occurrences in the block
    local: np.ndarray  # of each key, whether a part of it is known to be in no other block


class Block:
    """One block's positions: symbol, and by level the n-grams that end there."""

    def __init__(self, sizes, held, vocabulary: bytes, tokens: bytes, bits: int):
        self.words, token = X.unpack_sorted(vocabulary), X.unpack(tokens, np.int32)
        sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.train = np.repeat(~np.array(held, bool), sizes)
        self.before = (np.arange(len(token)) - np.repeat(self.first, sizes)).astype(np.int32)
        self.shift = np.uint64(64 - bits)
        self.levels = [Level(np.arange(len(token), dtype=np.int32), np.zeros(0, np.int32), self.words, token, np.bincount(token[self.train], minlength=len(self.words)), np.zeros(len(self.words), bool))]

    def grow(self, depth: int, answers: dict) -> Block:
        """Levels for contexts of up to `depth` words; from two on they need the counts of the levels before."""
        last = self.levels[0]
        symbol = self.words[last.index]
        gram, place = symbol, last.index
        for k in range(1, depth + 1):
            alone = np.zeros(len(symbol), bool)
            alone[last.at] = self.alone(k - 1, answers)[last.index]
            at = last.at if k == 1 else last.at[(self.times(k - 1, answers) >= MIN_CONTEXT)[last.index]]
            at = at[at < len(symbol) - 1] + 1
            at = at[self.before[at] >= k]
            longer = np.zeros(len(symbol), np.uint64)
            longer[at] = mix(gram[at - 1] * _STEP + symbol[at])
            keys, index = np.unique(longer[at] >> self.shift, return_inverse=True)
            local = np.ones(len(keys), bool)
            local[index[~(alone[at - 1] | alone[at])]] = False
            own = np.bincount(index[self.train[at]], minlength=len(keys))
            last = Level(at, place[at - 1], keys, index.astype(np.int32), own, local)
            self.levels.append(last)
            gram, place = longer, np.zeros(len(symbol), np.int32)
            place[at] = last.index
        return self

    def alone(self, k: int, answers: dict) -> np.ndarray:
        """Which n-grams of a level no other block holds."""
        out = self.levels[k].local.copy()
        out[~out] = answers.get(ALONE + k, False)
        return out

    def times(self, k: int, answers: dict) -> np.ndarray:
        """Training occurrences of a level's n-grams: as answered, the block's own where nothing was asked."""
        level = self.levels[k]
        out = level.own.astype(np.float64)
        out[~level.local] = answers.get(k, np.zeros(0))
        return out

    def counts(self, levels):
        """(kind, sorted keys, training count of each), without those that no other block can hold."""
        for k in levels:
            level = self.levels[k]
            asked = ~level.local
            yield k, level.keys[asked], level.own[asked].astype(np.uint32)

    def states(self, answers: dict, depth: int | None = None):
        """(k, level, n-gram and context counts of its positions), by level from 0 to `depth`."""
        before = None
        for k, level in enumerate(self.levels[: None if depth is None else depth + 1]):
            counts = self.times(k, answers)
            yield k, level, counts[level.index], None if k == 0 else before[level.context]
            before = counts

    def contexts(self, k: int, answers: dict) -> np.ndarray:
        """Which n-grams of the level before are contexts of level k that may be kept.

        One that occurs twice, before different symbols, can't be: its divergence is
        2 log(PRIOR / (PRIOR + 1)).  A block that sees one of the two needs no answer.
        """
        before, level = self.levels[k - 1], self.levels[k]
        times = self.times(k - 1, answers)
        may = (np.bincount(level.context, minlength=len(before.keys)) > 0) & (times >= MIN_CONTEXT)
        once = self.times(k, answers)[level.index] == 1
        may[level.context[once & (times[level.context] == 2)]] = False
        return may

    def divergences(self, answers: dict, total: float, distinct: float, levels: range):
        """(k, this block's part of each context's divergence, contexts that surely are kept, those to ask about), by level.

        Behind a context with one next symbol all parts are equal, so any block that sees
        one knows their sum, and so does a block that sees all occurrences.
        """
        for k, level, n, c in self.states(answers, levels[-1]):
            if k == 0:
                left = base(n, total, distinct)
                continue
            suffix = left[level.at]
            own = (n - 1 + PRIOR * suffix) / (c - 1 + PRIOR)
            left[level.at] = own
            if k not in levels:
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.log(own / suffix)
            may, one = self.contexts(k, answers), n == c
            parts = np.bincount(level.context, np.where(self.train[level.at], gain, 0), len(may))
            whole = np.where(self.levels[k - 1].own == self.times(k - 1, answers), parts, np.nan)
            whole[level.context[one]] = (c * gain)[one]
            may[whole <= MIN_GAIN] = False
            yield k, parts, may & (whole > MIN_GAIN), may & ~self.alone(k - 1, answers)

    def gains(self, k: int, answers: dict, total: float, distinct: float):
        """(kind, sorted keys, this block's part of each divergence) of contexts of k words; one known to be kept has a mark that is enough alone."""
        ((_, parts, sure, ask),) = self.divergences(answers, total, distinct, range(k, k + 1))
        parts[sure] = 2 * MIN_GAIN
        yield CONTEXT + k, self.levels[k - 1].keys[ask], parts[ask].astype(np.float32)

    def scores(self, answers: dict, total: float, distinct: float):
        """By document: tokens, known tokens, base score, score."""
        contexts = {}
        for k, _, sure, ask in self.divergences(answers, total, distinct, range(1, len(self.levels))):
            contexts[k] = sure
            contexts[k][ask] = answers.get(CONTEXT + k, np.zeros(0)) > 0
        for k, level, n, c in self.states(answers):
            if k == 0:
                known, p = n > 0, base(n, total, distinct)
                first, best = p.copy(), p.copy()
                continue
            own = (n + PRIOR * p[level.at]) / (c + PRIOR)
            p[level.at] = own
            use = contexts[k][level.context]
            best[level.at[use]] = own[use]
        add = lambda v: np.add.reduceat(v, self.first)
        return add(np.ones(len(best), np.int64)), add(known.astype(np.int64)), add(np.log10(first)), add(np.log10(best))


def base(counts: np.ndarray, total: float, distinct: float) -> np.ndarray:
    return (counts + 0.5) / (total + 0.5 * (distinct + 1))


def _rows(rows: list[tuple], types: dict) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def _known(kinds, answers) -> dict[int, np.ndarray]:
    """Answers to a block by kind: counts, which n-grams no other block asked for, kept contexts."""
    out = {}
    for kind, answer in zip(kinds or (), answers or ()):
        values = X.unpack(answer, _kind_of(kind))
        if kind < CONTEXT:
            out[ALONE + kind] = (values & np.uint64(1)).astype(bool)
            values = values >> np.uint64(1)
        out[kind] = values
    return out


def _answered(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Answers that have come for a block, by kind, in the order of its keys."""
    by: dict[int, list] = {}
    for kind, bucket, answer in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["answer"].to_pylist()):
        by.setdefault(kind, []).append((bucket, answer))
    return [*by], [X.pack(np.concatenate([X.unpack(a, _kind_of(k)) for _, a in sorted(v)])) for k, v in by.items()]


def _kind_of(kind: int) -> type:
    return np.uint64 if kind < CONTEXT else np.uint8


_PARTS = {"block": pa.int64(), "kind": pa.int32(), "bucket": pa.int32(), "keys": pa.binary(), "amounts": pa.binary()}


def score_texts(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", held_out=None, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns contexts of up to `depth` words, one or more, from rows where `held_out` (a Column) is not true."""
    if not 1 <= depth < CONTEXT:
        raise ValueError("a context has between one and 63 words")
    with scratch.passing() as stays:
        out = _score_texts(docs, scratch, doc_id, text, held_out, depth)
        stays(out)
    return out


def _score_texts(docs: DataFrame, scratch: Scratch, doc_id: str, text: str, held_out, depth: int) -> DataFrame:
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    length = docs.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0
    # bucketed by block: later passes send counts to the blocks, not blocks to the counts
    share = int(length >> 28)
    blocks = scratch.bucketed(read_blocks(docs.select(F.col(doc_id).cast("bigint"), text, held)), "block", share)
    size = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()[0] or 0
    bits = min(64, max(32, int(size).bit_length() + 16))
    buckets = max(4, int(-(-size // 1_500_000)))
    words, total, distinct = (0, CONTEXT + 1), 0, 0

    def block_of(row) -> Block:
        return Block(row["sizes"], row["held"], row["vocabulary"], row["tokens"], bits)

    def sent(row, found):
        return [p for kind, keys, n in found for p in X.parts(row["block"], kind, keys, n, 64 if kind in words else bits, buckets)]

    def asking(found):
        """What each block sends: found(its block, the answers that it has)."""

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    yield _rows(sent(row, found(block_of(row), _known(row["kinds"], row["answers"]))), _PARTS)

        return run

    def add(table: pa.Table) -> pa.Table:
        """Sums of a bucket for each block: twice the count, and one if no other block asks; of divergences, whether the context is kept."""
        kind, bucket, n = table["kind"][0].as_py(), table["bucket"][0].as_py(), table.num_rows
        sums, places, _ = X.add_up(table["keys"].to_pylist(), table["amounts"].to_pylist(), np.uint32 if kind < CONTEXT else np.float32)
        if kind < CONTEXT:
            blocks_with = np.bincount(np.concatenate(places), minlength=len(sums))
            values = sums.astype(np.uint64) * np.uint64(2) + (blocks_with == 1).astype(np.uint64)
        else:
            values = (sums > MIN_GAIN).astype(np.uint8)
        answers, found = [X.pack(values[p]) for p in places], kind == 0
        return pa.table({"block": pa.concat_arrays([table["block"].combine_chunks(), pa.array([None], pa.int64())]), "kind": pa.array([kind] * (n + 1), pa.int32()), "bucket": pa.array([bucket] * (n + 1), pa.int32()), "answer": pa.array([*answers, None], pa.binary()), "total": pa.array([0] * n + [int(sums.sum()) if found else 0]), "distinct": pa.array([0] * n + [int((sums > 0).sum()) if found else 0])})

    def learn(known: pa.Table, answers: pa.Table) -> pa.Table:
        kinds, values = _answered(answers)
        rows = [(row["block"], row["kinds"] + kinds, row["answers"] + values) for row in known.to_pylist()]
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(_KNOWN.items(), zip(*rows) if rows else [[]] * len(_KNOWN))})

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            got = _known(row["kinds"], row["answers"]) | _known(*_answered(answers))
            n, known, first, score = block_of(row).grow(depth, got).scores(got, total, distinct)
            out.append(pa.table({"doc_id": pa.array(row["docs"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": n, "n_known": known, "train_tokens": pa.array([total] * len(n), pa.int64()), "base_score": first, "score": score}))
        return pa.concat_tables(out) if out else empty.slice(0, 0)

    empty = pa.table({"doc_id": pa.array([0]), "held_out": pa.array([False]), "n_tokens": pa.array([0]), "n_known": pa.array([0]), "train_tokens": pa.array([0]), "base_score": pa.array([0.0]), "score": pa.array([0.0])})

    def with_answers(rows: DataFrame, answers: DataFrame, function, schema: str) -> DataFrame:
        return rows.groupBy("block").cogroup(answers.select("block", "kind", "bucket", "answer").where("block IS NOT NULL").groupBy("block")).applyInArrow(function, schema)

    def answer(rows: DataFrame, found) -> DataFrame:
        return scratch.keep(rows.drop("docs").mapInArrow(asking(found), X.PARTS).groupBy("kind", "bucket").applyInArrow(add, X.ANSWERS + ", total bigint, distinct bigint"))

    def found_in(k: int, total: int, distinct: int):
        """What is sent in round k: counts behind contexts of k words, divergences of contexts of k - 1."""

        def found(block: Block, got: dict):
            block.grow(min(k, depth), got)
            if k <= depth:
                yield from block.counts((k,))
            if k > 1:
                yield from block.gains(k - 1, got, total, distinct)

        return found

    rows = blocks.withColumns({"kinds": F.array().cast("array<int>"), "answers": F.array().cast("array<binary>")})
    known = rows.select(*_KNOWN)
    for k in range(depth + 1):
        counted = answer(rows, found_in(k, total, distinct))
        if k == 0:
            total, distinct = (int(x or 0) for x in counted.where("block IS NULL").agg(F.sum("total"), F.sum("distinct")).first())
        told = scratch.bucketed(with_answers(known, counted, learn, KNOWN), "block", share)
        scratch.drop(counted, *([known] if k else []))
        # both are dealt by block alike, so they meet where they lie
        known, rows = told, blocks.join(told.hint("merge"), "block", "left")
    kept = answer(rows, found_in(depth + 1, total, distinct))
    return scratch.keep(with_answers(rows, kept, finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))


def held_out(column="doc_id"):
    return F.coalesce(crc_bucket(F.col(column), 5) == 1, F.lit(False))
