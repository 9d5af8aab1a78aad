"""Benchmark decontamination: word pairs as seeds, counted, then Smith-Waterman alignment of words.

Words are runs of letters, digits and marks after lower-casing, so case and
punctuation don't matter.  Alignment: match +2, mismatch -1, gap -1, local.  A score of
at least `threshold` of a whole copy's is a leak.

Seeds are pairs of words next to each other or one apart.  They miss no leak: an
alignment of m matches to an item of n words costs at most 2m - 2tn, and each of its
m - 1 steps from a match to the next that is longer than a seed costs 2 or more, so at
least tn - 1 steps are seeds, and they lie within (3 - 2t)n words of the document.  Only
where so many places of a document fall so close is it aligned with the item.  An item's
pairs that many items share may be left out, and then count as if found.

The benchmark is handled in slices of at most MAX_SLICE_BYTES, each broadcast after its
size is known; every slice reads the documents again.

Defined results: null and empty documents match nothing; items of fewer than MIN_WORDS
words are too short to tell from chance and match nothing.  Ties between items: each
(document, item) pair has its own row.  Repeated documents give repeated rows, repeated
items too; documents that share an id or have none are judged each by its own text.
Whole texts are read, in slices: a text stands in one slice and takes about 50 bytes of
memory a byte.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix, pieces, slices, string_buffers, word_spans

MIN_WORDS, THRESHOLD = 6, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
MAX_SLICE_BYTES = 32 << 20
RARE_TIMES, RARE_PLUS = 4, 8
SEED_STEPS = (1, 2)
MAX_PLACES = 400_000

_BETWEEN_WORDS = r"[^\p{L}\p{N}\p{M}]+"


_FIRST, _SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)


def plain_words(column: pa.Array):
    """(word hashes, first word of each text with the total last) of slices of the texts."""
    offsets, data = string_buffers(pc.replace_substring_regex(pc.utf8_lower(column), _BETWEEN_WORDS, " "))
    for i, j in slices(offsets):
        part = offsets[i : j + 1] - offsets[i]
        words, _, _, at = word_spans(part, data[offsets[i] : offsets[j]])
        yield words, at


def seeds(words: np.ndarray, step: int) -> np.ndarray:
    """Hash of each word with the one `step` on, the same for all steps; across texts too."""
    return mix(words[:-step] * _FIRST + words[step:] * _SECOND)


@dataclass
class Items:
    """Test items of one slice: words, their seeds with the items that hold each, and what a leak must reach."""

    ids: list[int]
    words: list[np.ndarray]
    keys: np.ndarray  # sorted distinct
    at: np.ndarray  # first place of each key, and the end
    item: np.ndarray  # by place
    needed: np.ndarray  # by item: places of a leak in a document
    reach: np.ndarray  # by item: words that they lie within
    table: np.ndarray  # whether any key starts with these bits

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None], threshold: float = THRESHOLD) -> Items:
        words = [w[a:b] for w, at in plain_words(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:])]
        kept = [k for k, w in enumerate(words) if len(w) >= MIN_WORDS]
        words = [words[k] for k in kept]
        found = [np.unique(np.concatenate([seeds(w, d) for d in SEED_STEPS]), return_counts=True) for w in words]
        needed = np.array([math.ceil(threshold * len(w) - 1 - 1e-9) for w in words], np.int64)
        reach = np.array([math.ceil((3 - 2 * threshold) * len(w)) for w in words], np.int64)
        _, held, shared = np.unique(np.concatenate([np.zeros(0, np.uint64), *(f for f, _ in found)]), return_inverse=True, return_counts=True)
        ends = np.cumsum([0, *(len(f) for f, _ in found)])
        for k, (keys, times) in enumerate(found):
            by_item = shared[held[ends[k] : ends[k + 1]]]
            hot = np.flatnonzero(by_item > RARE_TIMES * np.median(by_item) + RARE_PLUS)
            hot = hot[np.argsort(-by_item[hot], kind="stable")]
            hot = hot[np.cumsum(times[hot]) <= needed[k] // 2]
            needed[k] -= times[hot].sum()
            found[k] = np.delete(keys, hot), None
        item = np.repeat(np.arange(len(words)), [len(f) for f, _ in found])
        keys = np.concatenate([np.zeros(0, np.uint64), *(f for f, _ in found)])
        order = np.lexsort((item, keys))
        distinct, first = np.unique(keys[order], return_index=True)
        table = np.zeros(1 << 22, bool)
        table[distinct >> np.uint64(42)] = True
        return cls([ids[k] for k in kept], words, distinct, np.append(first, len(keys)), item[order], needed, reach, table)


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices into keys, indices into sorted_keys) of those present."""
    if not len(sorted_keys) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[at] == keys)
    return hit, at[hit]


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smith-Waterman scores of (item words, passage words), many at once."""
    scores = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    while order:
        rows, width = len(pairs[order[0]][0]), 0
        take: list[int] = []
        for k in order:
            width = max(width, len(pairs[k][1]))
            rows = max(rows, len(pairs[k][0]))
            if take and (len(take) + 1) * width > 200_000:
                break
            take.append(k)
        order = order[len(take) :]
        rows = max(len(pairs[k][0]) for k in take)
        width = max(len(pairs[k][1]) for k in take)
        items, passages = np.zeros((len(take), rows), np.uint64), np.ones((len(take), width), np.uint64)
        for r, k in enumerate(take):
            items[r, : len(pairs[k][0])], passages[r, : len(pairs[k][1])] = pairs[k]
        slope = np.arange(width, dtype=np.int32) * -GAP
        last, best = np.zeros((len(take), width + 1), np.int32), np.zeros(len(take), np.int32)
        for i in range(rows):
            step = np.where(items[:, i : i + 1] == passages, np.int32(MATCH), np.int32(MISMATCH))
            now = np.maximum(np.maximum(last[:, :-1] + step, last[:, 1:] + GAP), 0)
            now = np.maximum.accumulate(now + slope, axis=1) - slope
            last[:, 1:] = now
            np.maximum(best, now.max(axis=1), out=best)
        scores[take] = best
    return scores


def passages(words: np.ndarray, at: np.ndarray, items: Items):
    """(text, item, first word, end) of each region of a text where enough seeds of an item fall."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    places, keys = [], []
    for step in SEED_STEPS:
        hashes = seeds(words, step)
        near = np.flatnonzero(items.table[hashes >> np.uint64(42)])
        near = near[text[near] == text[near + step]]
        hit, key = lookup(items.keys, hashes[near])
        places.append(near[hit])
        keys.append(key)
    place, key = np.concatenate(places), np.concatenate(keys)
    order = np.argsort(place, kind="stable")
    place, key = place[order], key[order]
    upto = np.append(0, np.cumsum(items.at[key + 1] - items.at[key]))
    a = 0
    while a < len(place):
        # whole texts, of about MAX_PLACES places
        b = int(np.searchsorted(upto, upto[a] + MAX_PLACES, side="right")) - 1
        if b < len(place):
            b = int(np.searchsorted(place, at[text[place[b]]]))
            b = b if b > a else int(np.searchsorted(place, at[text[place[a]] + 1]))
        yield from _regions(place[a:b], key[a:b], text, at, items)
        a = b


def _regions(place: np.ndarray, key: np.ndarray, text: np.ndarray, at: np.ndarray, items: Items):
    counts = items.at[key + 1] - items.at[key]
    item = items.item[np.repeat(items.at[key] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
    # places ascend with texts, so a stable sort by item leaves each text's places together and in order
    order = np.argsort(item, kind="stable")
    item, place = item[order], np.repeat(place, counts)[order]
    new = np.append(True, (item[1:] != item[:-1]) | (place[1:] != place[:-1]))
    item, place = item[new], place[new]
    last = np.arange(len(place)) + items.needed[item] - 1
    first = np.flatnonzero(last < len(place))
    last = last[first]
    good = (item[first] == item[last]) & (text[place[first]] == text[place[last]]) & (place[last] - place[first] <= items.reach[item[first]])
    first, last = first[good], last[good]
    if not len(first):
        return
    owner, which = text[place[first]], item[first]
    start = np.maximum(at[owner], place[last] - items.reach[which])
    end = np.minimum(at[owner + 1], place[first] + items.reach[which] + 3)
    cut = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])))
    for i, j in zip(cut, np.append(cut[1:], len(first))):
        yield int(owner[i]), int(which[i]), int(start[i]), int(end[j - 1])


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, id_type: str = "bigint") -> DataFrame:
    """doc_id, item_id, score (share of a whole copy's), first_word, end_word of the best passage: one row per document and item that it leaks.

    With `id_type` string, documents may be named by what tells their texts apart.
    """
    if threshold * MIN_WORDS <= 1:
        raise ValueError("a leak of this threshold may be a single word")
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast(id_type).alias("doc_id"), F.col(text).alias("text"))
    tests = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = int(-(-size // (MAX_SLICE_BYTES // 2))) or 1
    out = None
    for k in range(n_slices):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == k).orderBy("item_id", "text").toArrow()
        if rows.nbytes > 2 * MAX_SLICE_BYTES:
            raise ValueError(f"test items of one slice take {rows.nbytes} bytes")
        found = _leaks_of(spark, texts, Items.of(rows["item_id"].to_pylist(), rows["text"].to_pylist(), threshold), threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _leaks_of(spark, texts: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared = spark.sparkContext.broadcast(items)

    def search(batches):
        items = shared.value
        for batch in (p for b in batches for p in pieces(b, 1)):
            ids = batch.column(0).to_pylist()
            waiting, pairs = [], []
            best: dict[tuple, tuple] = {}

            def aligned():
                for (doc, item, a, b), score in zip(waiting, align(pairs)):
                    share = float(score) / (MATCH * len(items.words[item]))
                    if share >= threshold and (-share, a) < best.get((doc, item), (0.0, 0))[:2]:
                        best[doc, item] = (-share, a, b)
                waiting.clear()
                pairs.clear()

            before = 0
            for words, at in plain_words(batch.column(1)):
                for d, item, a, b in passages(words, at, items):
                    waiting.append((before + d, item, a - int(at[d]), b - int(at[d])))
                    pairs.append((items.words[item], words[a:b]))
                    if len(pairs) >= 512:
                        aligned()
                before += len(at) - 1
            aligned()
            rows = [(ids[d], items.ids[k], -s, a, b) for (d, k), (s, a, b) in sorted(best.items())]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (batch.column(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return texts.mapInArrow(search, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, item_id bigint, score double, first_word bigint, end_word bigint")
