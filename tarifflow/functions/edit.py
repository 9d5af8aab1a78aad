"""Edit similarities of many pairs of names at once, in numpy.

The longest common subsequence goes by bit vectors: a pattern's characters are bits, in
as many 64-bit words as it needs, and one step takes the next character of every text.
A run of the pattern is a mask over its bits, so windows of either side need no new
table.  Values equal those of the definitions in `similarity`, to the last bit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Pairs, or windows of pairs, that go through the bit vectors together.
ENTRIES = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place among its own) for each of counts[i] things of every i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


@dataclass
class Texts:
    """Code points of many texts, one after the other."""

    codes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Texts:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls(codes, np.cumsum(sizes) - sizes, sizes)

    @cached_property
    def alphabet(self) -> np.ndarray:
        return np.unique(self.codes)

    @cached_property
    def letters(self) -> np.ndarray:
        """Places in the alphabet from 1 on; 0 at last, for what follows the end of a text."""
        return np.append(np.searchsorted(self.alphabet, self.codes) + 1, 0)

    @cached_property
    def backward(self) -> Texts:
        owner, place = _spread(self.sizes)
        return Texts(self.codes[self.starts[owner] + self.sizes[owner] - 1 - place], np.cumsum(self.sizes) - self.sizes, self.sizes)

    def take(self, rows: np.ndarray) -> Texts:
        sizes = self.sizes[rows]
        owner, place = _spread(sizes)
        return Texts(self.codes[self.starts[rows][owner] + place], np.cumsum(sizes) - sizes, sizes)


class Matcher:
    """Bit tables of `patterns`, run over runs of `texts`."""

    def __init__(self, patterns: Texts, texts: Texts):
        self.letters = texts.letters
        self.width = len(texts.alphabet) + 1
        self.words = max(1, -(-int(patterns.sizes.max(initial=0)) // 64))
        self.table = np.zeros((self.words, len(patterns.sizes) * self.width), np.uint64)
        owner, at = _spread(patterns.sizes)
        letter = np.searchsorted(texts.alphabet, patterns.codes)
        known = np.flatnonzero(texts.alphabet[np.minimum(letter, self.width - 2)] == patterns.codes) if self.width > 1 else np.zeros(0, np.int64)
        at = at[known]
        np.bitwise_or.at(self.table, (at // 64, owner[known] * self.width + letter[known] + 1), np.uint64(1) << (at % 64).astype(np.uint64))

    def mask(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """By word, the bits of runs of a pattern."""
        out = np.empty((self.words, len(first)), np.uint64)
        for w in range(self.words):
            low, high = np.clip(first - 64 * w, 0, 64), np.clip(first + size - 64 * w, 0, 64)
            below = lambda n: np.where(n >= 64, ALL, (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1))
            out[w] = below(high) & ~below(low)
        return out

    def states(self, pattern, first, size, start, length):
        """After each character of all texts' runs (start, length): the step, and the bits of the pattern's run not yet in the subsequence."""
        window = self.mask(first, size)
        state, row, end = window.copy(), pattern * self.width, len(self.letters) - 1
        for j in range(int(length.max(initial=0))):
            code = row + self.letters[np.where(j < length, start + j, end)]
            carry = np.zeros(len(pattern), bool)
            for w in range(self.words):
                hit = self.table[w][code] & window[w]
                one = state[w]
                total = one + (one & hit)
                over = total < one
                if self.words > 1:
                    more = total + carry
                    over |= more < total
                    total = more
                state[w] = (total | (one & ~hit)) & window[w]
                carry = over
            yield j, state

    def common(self, pattern, first, size, start, length) -> np.ndarray:
        """Lengths of the longest common subsequences of runs of patterns with runs of texts."""
        out = np.zeros(len(pattern), np.int64)
        for a in range(0, len(pattern), ENTRIES):
            part = slice(a, a + ENTRIES)
            state = self.mask(first[part], size[part])
            for _, state in self.states(*(x[part] for x in (pattern, first, size, start, length))):
                pass
            out[part] = size[part] - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
        return out


def ratio(common: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """2 common / (one + two); two empty texts are equal."""
    total = one + two
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


class Names:
    """Names with what the similarities compare: the text, its words in order, its distinct words in order."""

    def __init__(self, names: list[str]):
        self.names = names
        split = [n.split() for n in names]
        self.words = [sorted(set(w)) for w in split]
        self.text = Texts.of(names)
        self.sorted = Texts.of([" ".join(sorted(w)) for w in split])
        self.distinct = Texts.of([" ".join(w) for w in self.words])
        # a bit for each word: without a common bit there is no common word
        self.marks = np.fromiter((sum({1 << (hash(w) & 63) for w in ws}) for ws in self.words), np.uint64, len(names))

    def take(self, rows: np.ndarray) -> Names:
        out = object.__new__(Names)
        out.names, out.words = [self.names[r] for r in rows], [self.words[r] for r in rows]
        out.text, out.sorted, out.distinct, out.marks = self.text.take(rows), self.sorted.take(rows), self.distinct.take(rows), self.marks[rows]
        return out


def whole(left: Texts, right: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common subsequence of left[i] with right[j]."""
    return Matcher(left, right).common(i, np.zeros(len(i), np.int64), left.sizes[i], right.starts[j], right.sizes[j])


def token_set(left: Names, right: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    sizes = left.distinct.sizes[i], right.distinct.sizes[j]
    out = np.zeros(len(i))
    shared = np.flatnonzero(left.marks[i] & right.marks[j])
    common = [set(left.words[i[p]]) & set(right.words[j[p]]) for p in shared]
    shared, common = shared[[bool(c) for c in common]], [c for c in common if c]
    apart = np.ones(len(i), bool)
    apart[shared] = False
    apart &= (sizes[0] > 0) & (sizes[1] > 0)
    out[apart] = ratio(whole(left.distinct, right.distinct, i[apart], j[apart]), sizes[0][apart], sizes[1][apart])
    if len(shared):
        both = np.array([sum(map(len, c)) + len(c) - 1 for c in common])
        one = [" ".join(w for w in left.words[i[p]] if w not in c) for p, c in zip(shared, common)]
        two = [" ".join(w for w in right.words[j[p]] if w not in c) for p, c in zip(shared, common)]
        rest, each = (Texts.of(one), Texts.of(two)), np.arange(len(shared))
        # common words stand first on both sides, with a space after them
        best = ratio(both + 1 + whole(*rest, each, each), sizes[0][shared], sizes[1][shared])
        for size in sizes:
            best = np.maximum(best, ratio(both, both, size[shared]))
        out[shared] = np.where((rest[0].sizes == 0) | (rest[1].sizes == 0), 1.0, best)
    return out


def ends(left: Texts, right: Texts, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest common subsequence, best ratio of the shorter text with a shorter window at an end of the longer one)."""
    common, best = np.zeros(len(i), np.int64), np.zeros(len(i))
    for backward in (False, True):
        x, y = (left.backward, right.backward) if backward else (left, right)
        matcher = Matcher(x, y)
        for a in range(0, len(i), ENTRIES):
            part = slice(a, a + ENTRIES)
            p, q = i[part], j[part]
            m, n = x.sizes[p], y.sizes[q]
            short = np.minimum(m, n)
            none = np.zeros(len(p), np.int64)
            top, state = np.zeros(len(p)), matcher.mask(none, m)
            reads = np.where(m <= n, short - 1, 0)
            steps = int(reads.max(initial=0))
            for k, state in matcher.states(p, none, m, y.starts[q], n):
                # windows of the text: what has been read
                if k < steps:
                    held = m - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
                    np.maximum(top, np.where(k < reads, 2 * held / (short + (k + 1)), 0.0), out=top)
            common[part] = m - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
            # windows of the pattern: its first bits
            for k in range(1, int(np.where(n < m, short, 0).max(initial=0))):
                held = k - np.bitwise_count(state & matcher.mask(none, none + k)).sum(axis=0, dtype=np.int64)
                top = np.maximum(top, np.where((n < m) & (k < short), ratio(held, short, np.full(len(p), k)), 0.0))
            best[part] = np.maximum(best[part], top)
    return common, best


def windows(left: Texts, right: Texts, i: np.ndarray, j: np.ndarray, step: np.ndarray | None = None) -> np.ndarray:
    """Best ratio of the shorter text with a window of its length in the longer one.

    With `step`, the most that it can be: runs hold so many windows each.
    """
    matcher, out = Matcher(left, right), np.zeros(len(i))
    m, n = left.sizes[i], right.sizes[j]
    step = np.ones(len(i), np.int64) if step is None else step
    short, long = np.minimum(m, n), np.maximum(m, n)
    count = (long - short) // step + 1
    cuts, upto, a = [0], np.cumsum(count), 0
    while a < len(i):
        a = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + ENTRIES, side="right")))
        cuts.append(a)
    for a, b in zip(cuts[:-1], cuts[1:]):
        owner, shift = _spread(count[a:b])
        owner += a
        shift *= step[owner]
        size = np.minimum(short[owner] + step[owner] - 1, long[owner] - shift)
        of_text = n[owner] > m[owner]
        runs = (np.where(of_text, 0, shift), np.where(of_text, m[owner], size)), (np.where(of_text, shift, 0), np.where(of_text, size, n[owner]))
        held = matcher.common(i[owner], *runs[0], right.starts[j[owner]] + runs[1][0], runs[1][1])
        np.maximum.at(out, owner, ratio(held, short[owner], short[owner]))
    return out


def partial(left: Texts, right: Texts, i: np.ndarray, j: np.ndarray, at_ends: np.ndarray | None = None) -> np.ndarray:
    """The best window of the longer text, of the shorter one's length or less at its ends."""
    m, n = left.sizes[i], right.sizes[j]
    at_ends = ends(left, right, i, j)[1] if at_ends is None else at_ends
    return np.where((m > 0) & (n > 0), np.maximum(windows(left, right, i, j), at_ends), np.where((m == 0) & (n == 0), 1.0, 0.0))


def weighted(indel: np.ndarray, sets: np.ndarray, sort: np.ndarray, part: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best of the ratios; see `similarity.weighted_of`."""
    longer = np.maximum(m, n) / np.maximum(np.minimum(m, n), 1)
    best = np.maximum(indel, 0.95 * np.maximum(sort, sets))
    best = np.where(longer < 1.5, best, np.maximum(best, np.where(longer <= 8, 0.9, 0.6) * part))
    return np.where((m == 0) | (n == 0), 0.0, best)


def in_classes(left: Names, right: Names, i: np.ndarray, j: np.ndarray, use, width: int) -> np.ndarray:
    """use(left, right, i, j) by pair: pairs of about the same sizes go together, so that a long name doesn't lengthen the steps of all."""
    out = np.zeros((len(i), width))
    kind = _magnitude(left.text.sizes)[i] * 64 + _magnitude(right.text.sizes)[j]
    for k in np.unique(kind):
        pairs = np.flatnonzero(kind == k)
        rows, p = np.unique(i[pairs], return_inverse=True)
        out[pairs] = use(left.take(rows), right, p, j[pairs])
    return out


def scores(left: Names, right: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """weighted, token_set, token_sort, partial of left[i] with right[j], by pair."""
    return in_classes(left, right, i, j, _scores, 4)


def subsequences(left: Names, right: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common subsequences of left[i] with right[j]."""
    return in_classes(left, right, i, j, lambda a, b, p, q: whole(a.text, b.text, p, q)[:, None], 1)[:, 0].astype(np.int64)


def ratios(left: Names, right: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What needs no windows: the ratio, that of the sorted words, and the most that `partial` can be."""
    return in_classes(left, right, i, j, _ratios, 3)


def _magnitude(sizes: np.ndarray) -> np.ndarray:
    """0 up to 16 characters, then one more for each doubling."""
    return np.ceil(np.log2(np.maximum(sizes, 16) / 16)).astype(np.int64)


def _scores(left: Names, right: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    common, at_ends = ends(left.text, right.text, i, j)
    m, n = left.text.sizes[i], right.text.sizes[j]
    sets = token_set(left, right, i, j)
    sort = ratio(whole(left.sorted, right.sorted, i, j), left.sorted.sizes[i], right.sorted.sizes[j])
    part = partial(left.text, right.text, i, j, at_ends)
    return np.stack((weighted(ratio(common, m, n), sets, sort, part, m, n), sets, sort, part), axis=1)


def _ratios(left: Names, right: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    m, n = left.text.sizes[i], right.text.sizes[j]
    common, at_ends = ends(left.text, right.text, i, j)
    short = np.minimum(m, n)
    inner = windows(left.text, right.text, i, j, np.maximum(short // 8, 1))
    most = np.where(short > 0, np.maximum(inner, at_ends), (m == n).astype(float))
    return np.stack((ratio(common, m, n), ratio(whole(left.sorted, right.sorted, i, j), left.sorted.sizes[i], right.sorted.sizes[j]), most), axis=1)
