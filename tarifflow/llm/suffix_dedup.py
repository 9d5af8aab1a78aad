"""Suffix-array dedup: every byte covered by a 400-byte string that also starts elsewhere.

Which suffixes are sorted.  A window (400 bytes from p) has an anchor: the leftmost
smallest hash of 16 bytes among the first 128 places of the window.  Equal windows have
equal anchors at equal places, an anchor serves a run of windows, and only suffixes at
anchors are sorted, one in about 64 bytes.  Windows of one anchor share at least 273
bytes from the anchor on; an anchor whose 273 bytes occur once in the corpus is dropped.

The sort.  Blocks of documents sort their suffixes and send them as front-coded runs:
common prefix length with the one before, and the rest.  A task merges the runs of its
share with a loser tree that keeps each candidate's common prefix with the last winner
and never compares those bytes again; it yields the suffixes in order with their common
prefix lengths.  Bytes before the anchors are ordered alike.  Two windows with the anchor
at o are equal iff no common prefix below 400 - o lies between them in the one order
and none below o in the other.

Skew.  Texts that occur more than once are removed whole and represented by one of them.
If more than CROWD places share their 273 bytes, no task gathers them: blocks send each
distinct window once as a hash with its count (see exchange), and sums decide.

Defined results: null and empty texts have n_bytes 0 and nothing removed; repeated rows
are copies of each other.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .scratch import Scratch
from .text import mix, slices, string_buffers

LENGTH, PLACES, GRAM = 400, 128, 16
SHARED = LENGTH - PLACES + 1
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20  # long texts are read in pieces that overlap by LENGTH - 1 bytes
CROWD = 2000
PER_PART = 15_000
TEXT, ANCHOR, SUFFIX, WINDOW = range(4)

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC3A5C85C97CB3127))
_STEP = [np.uint64(0x9AE16A3B2F90404F), np.uint64(0xB492B66FBE98F273), np.uint64(0xD6D0E8FEB8665FD9), np.uint64(0xA0761D6478BD642F)]
_FAR = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)

BLOCKS = "block bigint, docs array<bigint>, sizes binary, data binary"


def read_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of whole texts from (doc_id, text)."""

    def run(batches):
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        ids, sizes, data, size = [], [], [], 0

        def block():
            packed = zstandard.ZstdCompressor(level=1).compress(b"".join(data))
            row = [pa.array([(task << 32) + count]), pa.array([ids], pa.list_(pa.int64())), pa.array([X.pack(np.concatenate(sizes))], pa.binary()), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["block", "docs", "sizes", "data"])

        for batch in batches:
            offsets, raw = string_buffers(batch.column(1))
            doc = batch.column(0).to_pylist()
            for i, j in slices(offsets):
                ids += doc[i:j]
                sizes.append(np.diff(offsets[i : j + 1]))
                data.append(raw[offsets[i] : offsets[j]].tobytes())
                size += len(data[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    count, ids, sizes, data, size = count + 1, [], [], [], 0
        if ids:
            yield block()

    return docs.mapInArrow(run, BLOCKS)


def gram_values(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place (fewer at the end, where no window begins)."""
    h = _BYTE[data]
    for k, step in enumerate(_STEP):
        n = 1 << k
        if len(h) <= n:
            return h[:0]
        h = h[:-n] * step + h[n:]
        h ^= h >> np.uint64(29)
    return h


def spread(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of `length` bytes from each place of `at`."""
    out = np.zeros(len(at), np.uint64)
    steps = [*range(0, length - GRAM + 1, GRAM)]
    if steps[-1] != length - GRAM:
        steps.append(length - GRAM)
    for k, s in enumerate(steps):
        out += h[at + s] * _FAR[k]
    return mix(out)


def anchor_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash of the bytes shared) of each run of windows, for texts [starts, ends)."""
    pieces = []
    for k in np.flatnonzero(ends - starts >= LENGTH):
        a, b = int(starts[k]), int(ends[k])
        while b - a > PIECE + LENGTH:
            pieces.append((a, a + PIECE + LENGTH - 1))
            a += PIECE
        pieces.append((a, b))
    out: list[tuple] = []
    group: list[tuple[int, int]] = []
    for a, b in pieces:
        if group and (a < group[-1][1] or b - group[0][0] > PIECE):
            out.append(_runs_of(data, group))
            group = []
        group.append((a, b))
    if group:
        out.append(_runs_of(data, group))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs_of(data: np.ndarray, texts: list[tuple[int, int]]):
    """Runs of texts of one stretch of the data."""
    base, end = texts[0][0], texts[-1][1]
    h = gram_values(data[base:end])
    place = np.uint64((1 << 21) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    for k in range(7):
        low = np.minimum(low[: -(1 << k)], low[1 << k :]) if len(low) > 1 << k else low[:0]
    valid = np.zeros(len(low), bool)
    text = np.zeros(len(low), np.int32)
    for k, (a, b) in enumerate(texts):
        valid[a - base : b - base - LENGTH + 1] = True
        text[a - base : b - base - LENGTH + 1] = k
    p = np.flatnonzero(valid)
    anchor = (low[p] & place).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[p[1:]] != text[p[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return anchor[first] + base, p[first] + base, p[last] + base, spread(h, anchor[first], SHARED)


class Block:
    def __init__(self, row: dict):
        self.number, self.docs = row["block"], row["docs"]
        self.sizes = X.unpack(row["sizes"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]) if len(self.sizes) and self.sizes.sum() else b"", np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        raw = memoryview(self.data)
        keys = np.array([(d := xxhash.xxh3_128_intdigest(raw[a:b])) & 0xFFFFFFFFFFFFFFFF for a, b in zip(self.starts.tolist(), self.ends.tolist())], dtype=np.uint64)
        self.checks = np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(self.starts.tolist(), self.ends.tolist())], dtype=np.uint64)
        #: distinct texts, by their first document here
        order = np.lexsort((np.arange(len(keys)), self.checks, keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (self.checks[order[1:]] != self.checks[order[:-1]])
        self.first = order[new]
        self.text = np.empty(len(keys), np.int64)
        self.text[order] = np.cumsum(new) - 1
        self.keys, self.checks = keys[self.first], self.checks[self.first]
        self.copies = np.bincount(self.text, minlength=len(self.first))

    def runs(self, texts: np.ndarray):
        """Anchor runs of the given distinct texts, in the order of the data."""
        docs = np.sort(self.first[texts])
        return anchor_runs(self.data, self.starts[docs], self.ends[docs])


def front_coded(suffixes: list[bytes]) -> tuple[bytes, bytes]:
    """(common prefix lengths, the rests) of sorted suffixes of LENGTH bytes."""
    m = np.frombuffer(b"".join(suffixes), np.uint8).reshape(-1, LENGTH)
    differ = m[1:] != m[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    common = np.concatenate(([0], common)).astype(np.uint16)
    rest = m[np.arange(LENGTH)[None, :] >= common[:, None]]
    return X.pack(common), zstandard.ZstdCompressor(level=1).compress(rest.tobytes())


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Common prefix length of two suffixes of LENGTH bytes that agree in `known` bytes."""
    differ = int.from_bytes(x[known:], "big") ^ int.from_bytes(y[known:], "big")
    return LENGTH - (differ.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (common prefix with the one before in the run, suffix, tag)."""

    def __init__(self, runs: list):
        self.runs, self.n = runs, 1
        while self.n < len(runs):
            self.n *= 2
        self.now = [None] * self.n  # candidate of each run: [common prefix with the last winner, suffix, tag]
        for k, run in enumerate(runs):
            self.now[k] = next(run, None)
        self.losers = [0] * self.n
        winners = [0] * (2 * self.n)
        winners[self.n :] = range(self.n)
        for node in range(self.n - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.top = winners[1]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix is from now on that with the winner."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if x[0] != y[0]:  # more in common with the last winner: smaller
            return (a, b) if x[0] > y[0] else (b, a)
        common = common_prefix(x[1], y[1], x[0])
        if common == LENGTH or x[1][common] < y[1][common]:
            y[0] = common
            return a, b
        x[0] = common
        return b, a

    def __iter__(self):
        while self.now[self.top] is not None:
            k = self.top
            yield self.now[k]
            self.now[k] = next(self.runs[k], None)
            node = (self.n + k) // 2
            while node:
                k, self.losers[node] = self._play(k, self.losers[node])
                node //= 2
            self.top = k


def decoded(common: bytes, rest: bytes, tag):
    """The candidates of a front-coded run."""
    lengths, data, at, last = X.unpack(common, np.uint16).tolist(), zstandard.ZstdDecompressor().decompress(rest), 0, b""
    for k, n in enumerate(lengths):
        last = last[:n] + data[at : at + LENGTH - n]
        at += LENGTH - n
        yield [n, last, (tag, k)]


def repeated_windows(common: np.ndarray, before: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(suffix, o) -> whether the window with the anchor at o is held by another suffix too.

    `common`: prefix lengths of the sorted suffixes; `before`: bytes before each anchor,
    last first; a suffix serves o = low..high.
    """
    n = len(common)
    order = np.array(sorted(range(n), key=before.__getitem__))
    m = np.zeros((n, PLACES), np.uint8)
    length = np.array([len(b) for b in before])
    m[np.arange(PLACES)[None, :] < length[:, None]] = np.frombuffer(b"".join(before), np.uint8)
    m, length = m[order], length[order]
    differ = m[1:] != m[:-1]
    left = np.where(differ.any(axis=1), differ.argmax(axis=1), PLACES)
    left = np.concatenate(([0], np.minimum(left, np.minimum(length[1:], length[:-1]))))
    out = np.zeros((n, PLACES), bool)
    left_class = np.empty(n, np.int64)
    for o in range(PLACES):
        serves = np.flatnonzero((low <= o) & (o <= high))
        if len(serves) < 2:
            continue
        left_class[order] = np.cumsum(left < o)
        code = left_class[serves] * (n + 1) + np.cumsum(common < LENGTH - o)[serves]
        _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
        out[serves, o] = counts[inverse] > 1
    return out


_ASK = {"block": pa.int64(), "kind": pa.int32(), "part": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary(), "e": pa.binary()}
ASK = "block bigint, kind int, part int, a binary, b binary, c binary, d binary, e binary"
ANSWER = "block bigint, kind int, part int, a binary, b binary"


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(_ASK)
    return pa.table({k: pa.array(c, t) for c, (k, t) in zip(columns, _ASK.items())})


def first_questions(block: Block, buckets: int):
    """Copies of each distinct text, and places of each anchor's shared bytes."""
    order = np.argsort(block.keys, kind="stable")
    keys = block.keys[order]
    cuts = X.bucket_cuts(keys, 64, buckets)
    for b in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[b], cuts[b + 1])
        yield block.number, TEXT, int(b), X.pack_sorted(keys[s]), X.pack(block.copies[order][s].astype(np.uint32)), X.pack(block.checks[order][s]), None, None
    _, _, _, shared = block.runs(np.arange(len(block.first)))
    keys, counts = np.unique(shared, return_counts=True)
    for number, kind, b, k, amounts in X.parts(block.number, ANCHOR, keys, counts.astype(np.uint32), 64, buckets):
        yield number, kind, b, k, amounts, None, None, None


def first_answers(table: pa.Table) -> pa.Table:
    """TEXT: copies in all blocks, and whether the block is the first with the text. ANCHOR: places in all blocks."""
    kind, part, blocks = table["kind"][0].as_py(), table["part"][0].as_py(), table["block"].to_numpy()
    n = table.num_rows
    sizes_of = lambda v: np.minimum(v, 0xFFFFFFFF).astype(np.uint32)
    if kind == ANCHOR:
        sums, places, _ = X.add_up(table["a"].to_pylist(), table["b"].to_pylist(), np.uint32)
        a, b = [X.pack(sizes_of(sums[p])) for p in places], [b""] * n
    else:
        keys = [X.unpack_sorted(k) for k in table["a"].to_pylist()]
        counts = np.concatenate([X.unpack(k, np.uint32) for k in table["b"].to_pylist()])
        checks = np.concatenate([X.unpack(k, np.uint64) for k in table["c"].to_pylist()])
        owner = np.repeat(blocks, [len(k) for k in keys])
        at = np.cumsum([len(k) for k in keys])[:-1]
        keys = np.concatenate(keys)
        order = np.lexsort((owner, checks, keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
        group = np.cumsum(new) - 1
        sums = np.bincount(group, counts[order])
        total, first = np.empty(len(order)), np.empty(len(order), np.uint8)
        total[order], first[order] = sums[group], new
        a, b = [X.pack(sizes_of(x)) for x in np.split(total, at)], [X.pack(x) for x in np.split(first, at)]
    return pa.table({"block": blocks, "kind": pa.array([kind] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


class Found:
    """What a block knows after the first answers: which texts are copied, which anchors are shared."""

    def __init__(self, block: Block, answers: list[dict]):
        text = sorted((r for r in answers if r["kind"] == TEXT), key=lambda r: r["part"])
        order = np.argsort(block.keys, kind="stable")
        self.total, first = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        self.total[order] = np.concatenate([X.unpack(r["a"], np.uint32) for r in text])
        first[order] = np.concatenate([X.unpack(r["b"], np.uint8) for r in text])
        self.anchor, self.low, self.high, shared = block.runs(np.arange(len(block.first)))
        keys, inverse = np.unique(shared, return_inverse=True)
        anchors = sorted((r for r in answers if r["kind"] == ANCHOR), key=lambda r: r["part"])
        places = np.concatenate([np.zeros(0, np.uint32), *(X.unpack(r["a"], np.uint32) for r in anchors)]).astype(np.int64)[inverse]
        text_of = block.text[np.searchsorted(block.ends, self.low, side="right")]
        # one document stands for all copies of its text
        used = first[text_of] & (places > 1)
        self.anchor, self.low, self.high, self.shared, places = self.anchor[used], self.low[used], self.high[used], shared[used], places[used]
        self.crowded = places > CROWD
        self.end = block.ends[np.searchsorted(block.ends, self.anchor, side="right")]


def windows_of(found: Found, block: Block):
    """Of crowded anchors: (window start, hash of the window)."""
    runs = np.flatnonzero(found.crowded)
    counts = found.high[runs] - found.low[runs] + 1
    p = np.repeat(found.low[runs] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    values = np.zeros(len(p), np.uint64)
    if len(p):
        piece = p // PIECE
        order = np.argsort(piece, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
            base = int(p[group].min())
            h = gram_values(block.data[base : int(p[group].max()) + LENGTH])
            values[group] = spread(h, p[group] - base, LENGTH)
    return p, values


def second_questions(block: Block, found: Found, parts: int, buckets: int):
    """Front-coded sorted runs of suffixes, and hashes of crowded windows."""
    plain = np.flatnonzero(~found.crowded)
    part = (mix(found.shared[plain]) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    raw = block.data.tobytes()
    start_of = block.starts[np.searchsorted(block.ends, found.anchor, side="right")] if len(found.anchor) else found.anchor
    for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
        runs = plain[group]
        suffix = [raw[a : min(a + LENGTH, e)].ljust(LENGTH, b"\0") for a, e in zip(found.anchor[runs].tolist(), found.end[runs].tolist())]
        rank = sorted(range(len(runs)), key=suffix.__getitem__)
        runs = runs[rank]
        before = [raw[max(s, w) : a][::-1] for a, w, s in zip(found.anchor[runs].tolist(), found.low[runs].tolist(), start_of[runs].tolist())]
        common, rest = front_coded([suffix[r] for r in rank])
        serves = np.stack([found.anchor[runs] - found.high[runs], found.anchor[runs] - found.low[runs]]).astype(np.uint8)
        yield block.number, SUFFIX, int(part[group[0]]), common, rest, serves.tobytes(), zstandard.ZstdCompressor(level=1).compress(b"".join(before)), X.pack(runs.astype(np.int32))
    _, values = windows_of(found, block)
    keys, counts = np.unique(values, return_counts=True)
    for number, kind, b, k, amounts in X.parts(block.number, WINDOW, keys, counts.astype(np.uint32), 64, buckets):
        yield number, kind, b, k, amounts, None, None, None


def second_answers(table: pa.Table) -> pa.Table:
    """SUFFIX: flags of the repeated windows of each suffix. WINDOW: whether each occurs more than once."""
    kind, part, rows = table["kind"][0].as_py(), table["part"][0].as_py(), table.to_pylist()
    if kind == WINDOW:
        sums, places, _ = X.add_up([r["a"] for r in rows], [r["b"] for r in rows], np.uint32)
        a, b = [X.pack((sums[p] > 1).astype(np.uint8)) for p in places], [b""] * len(rows)
    else:
        serves, before = [], []
        for r in rows:
            own = np.frombuffer(r["c"], np.uint8).reshape(2, -1).astype(np.int64)
            data, at, lefts = zstandard.ZstdDecompressor().decompress(r["d"]), 0, []
            for n in own[1].tolist():
                lefts.append(data[at : at + n])
                at += n
            serves.append(own)
            before.append(lefts)
        common, tags = [], []
        for n, _, tag in LoserTree([decoded(r["a"], r["b"], k) for k, r in enumerate(rows)]):
            common.append(n)
            tags.append(tag)
        low, high = (np.array([serves[k][side, i] for k, i in tags]) for side in (0, 1))
        flags = repeated_windows(np.array(common), [before[k][i] for k, i in tags], low, high)
        place = {tag: n for n, tag in enumerate(tags)}
        a = [X.pack(np.packbits(flags[[place[k, i] for i in range(serves[k].shape[1])]], axis=1).ravel()) for k in range(len(rows))]
        b = [r["e"] for r in rows]
    return pa.table({"block": table["block"], "kind": table["kind"], "part": pa.array([part] * len(rows), pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def removals(block: Block, found: Found, answers: list[dict]):
    """Per document: bytes removed, spans removed, the rest."""
    repeated = []
    for r in (r for r in answers if r["kind"] == SUFFIX):
        runs = X.unpack(r["b"], np.int32)
        flags = np.unpackbits(X.unpack(r["a"], np.uint8).reshape(len(runs), -1), axis=1)
        k, o = np.nonzero(flags)
        repeated.append(found.anchor[runs[k]] - o)
    p, values = windows_of(found, block)
    if len(p):
        keys, inverse = np.unique(values, return_inverse=True)
        flags = np.concatenate([X.unpack(r["a"], np.uint8) for r in sorted((r for r in answers if r["kind"] == WINDOW), key=lambda r: r["part"])])
        repeated.append(p[flags[inverse] > 0])
    starts = np.concatenate([np.zeros(0, np.int64), *repeated]).astype(np.int64)
    n = len(block.data) + 1
    gone = np.cumsum(np.bincount(starts, minlength=n) - np.bincount(starts + LENGTH, minlength=n))[:-1] > 0
    raw = memoryview(block.data)
    for d, (a, b) in enumerate(zip(block.starts.tolist(), block.ends.tolist())):
        text = block.text[d]
        if found.total[text] > 1:
            n, spans, rest = (b - a, 1, b"") if b - a >= LENGTH else (0, 0, raw[a:b])
        else:
            own = gone[a:b]
            n = int(own.sum())
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            rest = raw[a:b] if not n else block.data[a:b][~own].tobytes()
        yield n, spans, bytes(rest)


def dedup(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept_text: one row per row of `docs`.

    kept_text: the bytes that stay, in order; a character cut by a removal becomes U+FFFD.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0
    # bucketed by block: answers go to the blocks, texts are not dealt again
    blocks = scratch.bucketed(read_blocks(docs.select(F.col(doc_id).cast("bigint"), text)), "block", int(size >> 28))
    buckets = max(4, int(size >> 26))

    def ask(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _table(list(first_questions(Block(batch.slice(k, 1).to_pylist()[0]), buckets))).to_batches()

    first = scratch.keep(blocks.mapInArrow(ask, ASK).groupBy("kind", "part").applyInArrow(first_answers, ANSWER))
    parts = max(8, int(size // (64 * PER_PART) // 4))

    def ask_again(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row in block.to_pylist():
            own = Block(row)
            rows += second_questions(own, Found(own, answers.to_pylist()), parts, buckets)
        return _table(rows)

    asked = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask_again, ASK)
    second = scratch.keep(asked.groupBy("kind", "part").applyInArrow(second_answers, ANSWER))

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        got, ids, sizes, out = answers.to_pylist(), [], [], []
        for row in block.to_pylist():
            own = Block(row)
            ids += own.docs
            sizes += own.sizes.tolist()
            out += removals(own, Found(own, got), got)
        n, spans, rests = zip(*out) if out else ((), (), ())
        texts = [rest.decode(errors="replace") for rest in rests]
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_bytes": pa.array(sizes, pa.int64()),
            "n_removed": pa.array(n, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(rest).hexdigest() for rest in rests], pa.string()),
            "n_kept": pa.array([len(rest) for rest in rests], pa.int64()),
            "kept_text": pa.array(texts, pa.string()),
        }
        return pa.table(columns)

    done = blocks.groupBy("block").cogroup(first.unionByName(second).groupBy("block")).applyInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_kept bigint, kept_text string")
    done = scratch.keep(done)
    scratch.drop(blocks, first, second)
    return done
