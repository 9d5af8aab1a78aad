"""Packing of documents into token windows by the sum-of-squares rule.

A document's ids are cut into full windows, which need no packing, and a rest.  Each
rest goes, online, to the fill level that minimises the sum of squared counts of
partially filled windows: with N[h] windows at level h, moving one from h to h + s
changes the sum by 2 (N[h+s] - N[h]) + 2, so the level array alone decides.  Tasks pack
independently.  What is still partially filled when a task ends (or when more than
MAX_OPEN windows are open, which bounds memory) is cut again into full windows; the
last of these is cut into sequences whose lengths are powers of two, which need no
padding.

Defined results: null and empty texts consist of the end id alone.  Repeated rows are
packed once each.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, string_buffers, word_spans

WINDOW, END_ID, MAX_OPEN = 2048, 1, 4096
MAX_CACHED_WORDS = 1_000_000
_LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
_WORD_END = "</w>"

_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of whole texts, word by word through a bounded cache.

    Holds for tokenizers that lower-case and whose words never span white space: ids of
    a text are then those of its words in order.  Full stops and commas that end a word
    after a-z are a word of their own.  The cache is a sorted array of 64-bit word
    hashes, so a block of text is looked up at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith(_WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, count for each word, words in the order of their ids). Words of letters alone are one run of ids up to a word end, so they are encoded as one text."""
        plain = np.fromiter((_LETTERS.fullmatch(w) is not None for w in words), bool, len(words))
        ids, sizes = [], np.zeros(len(words), np.int64)
        at = np.flatnonzero(plain)
        for i in range(0, len(at), 2048):
            part = at[i : i + 2048]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(words[k] for k in part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends_word[got])
            if len(ends) != len(part):  # not such a tokenizer
                plain[part] = False
                continue
            sizes[part] = np.diff(ends, prepend=-1)
            ids.append(got)
        order = [at[plain[at]]]
        at = np.flatnonzero(~plain)
        for i in range(0, len(at), 4096):
            part = at[i : i + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False)]
            sizes[part] = [len(x) for x in found]
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
            order.append(part)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), sizes, np.concatenate(order)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids, sizes, order = self._ids(words)
        rows = np.empty(len(words), np.int64)
        rows[order] = np.arange(len(words)) + len(self.offsets) - 1
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes[order])])
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, place, keys), np.insert(self.rows, place, rows)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Token ids of each text, without an end id."""
        offsets, data = string_buffers(column)
        for i, j in slices(offsets):
            part = offsets[i : j + 1] - offsets[i]
            here = data[offsets[i] : offsets[j]]
            hashes, starts, lengths, at = word_spans(part, here, _final_points(part, here))
            keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            known = np.searchsorted(self.keys, keys)
            new = self.keys[np.minimum(known, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool)
            if new.any():
                if len(self.keys) + new.sum() > MAX_CACHED_WORDS:
                    self.clear()
                    new[:] = True
                raw = here.tobytes()
                self.learn(keys[new], [raw[a : a + n].decode().lower() if raw[a : a + n].isascii() else raw[a : a + n].decode() for a, n in zip(starts[first[new]].tolist(), lengths[first[new]].tolist())])
                known = np.searchsorted(self.keys, keys)
            rows = self.rows[known] if len(keys) else np.zeros(0, np.int64)
            base, n = self.offsets[rows][inverse], (self.offsets[rows + 1] - self.offsets[rows])[inverse]
            ends = np.concatenate(([0], np.cumsum(n)))
            ids = self.ids[np.arange(ends[-1]) + np.repeat(base - ends[:-1], n)] if ends[-1] else np.zeros(0, np.uint32)
            for a, b in zip(ends[at[:-1]], ends[at[1:]]):
                yield ids[a:b]


def _final_points(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where a run of full stops and commas begins that follows a-z and ends its word."""
    n = len(data)
    point = (data == 46) | (data == 44)
    begins = point.copy()
    begins[1:] &= ~point[:-1]
    firsts = np.flatnonzero(begins)
    ends = point.copy()
    ends[:-1] &= ~point[1:]
    lasts = np.flatnonzero(ends)
    stop = np.zeros(n + 1, bool)
    stop[:n] = (data == 32) | (data >= 9) & (data <= 13)
    stop[offsets] = True
    small = np.zeros(n + 1, bool)
    small[1:] = (data | 32 >= 97) & (data | 32 <= 122)
    small[offsets] = False
    out = np.zeros(n, bool)
    out[firsts[small[firsts] & stop[lasts + 1]]] = True
    return out


def tokenizer_for(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Sum-of-squares packing of one stream of documents; `place` and `finish` yield piece rows."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level: windows, each a list of pieces
        self.n_open = 0

    def _close(self, pieces):
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, self.next_id, at
            at += len(ids)
        self.next_id += 1

    def place(self, doc, ids: np.ndarray):
        w, total = self.window, len(ids)
        full = total - total % w
        for start in range(0, full, w):
            yield from self._close([(doc, start, ids[start : start + w], total)])
        size = total - full
        if not size:
            return
        piece, n = (doc, full, ids[full:], total), self.levels
        change = 2 * (n[size : w + 1] - n[: w + 1 - size]) + 2  # level h to h + size, for h = 0 .. w - size
        change[-1] -= 2 * n[w] + 1  # a full window leaves the sum
        change[0] = 2 * n[size] + 1  # a new window
        usable = n[: w + 1 - size] > 0
        usable[0] = True
        level = int(np.where(usable, change, np.iinfo(np.int64).max).argmin())
        pieces = self.open[level].pop() if level else []
        n[level] -= level > 0
        pieces.append(piece)
        if level + size == w:
            self.n_open -= level > 0
            yield from self._close(pieces)
        else:
            self.n_open += level == 0
            self.open[level + size].append(pieces)
            n[level + size] += 1
        if self.n_open > MAX_OPEN:
            yield from self.finish()

    def finish(self):
        """Cut all partially filled windows again."""
        left = [p for level in reversed(self.open) for pieces in level for p in pieces]
        total = sum(len(p[2]) for p in left)
        self.open = [[] for _ in range(self.window)]
        self.levels[:] = 0
        self.n_open = 0
        goal, filled, pieces = self._goal(total), 0, []
        for doc, start, ids, whole in left:
            while len(ids):
                n = min(goal - filled, len(ids))
                pieces.append((doc, start, ids[:n], whole))
                start, ids, filled = start + n, ids[n:], filled + n
                if filled == goal:
                    yield from self._close(pieces)
                    total -= goal
                    goal, filled, pieces = self._goal(total), 0, []

    def _goal(self, left: int) -> int:
        return self.window if left >= self.window else 1 << max(0, left.bit_length() - 1)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def pack(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece. sequence_id: task number times 2**33 plus a count."""

    def run(batches):
        from pyspark import TaskContext

        packer, rows = Packer(window, TaskContext.get().partitionId() << 33), []
        tokenizer = tokenizer_for(tokenizer_path)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)

        for batch in batches:
            for doc, tokens in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1))):
                rows += packer.place(doc, np.append(tokens, np.uint32(END_ID)))
            if rows:
                yield batch_of(rows)
                rows = []
        rows = list(packer.finish())
        if rows:
            yield batch_of(rows)

    return df.select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, PIECES)
