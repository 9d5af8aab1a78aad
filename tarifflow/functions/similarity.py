"""Name similarities as Column expressions, in [0, 1] and symmetric unless said otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import edit
from .text import let

#: Words that say little about a service, and the weights of the combined score.
LOW_VALUE_TOKENS = (
    "услуга", "услуги", "медицинский", "медицинская", "платный", "платная", "прочий", "прочая", "другой", "другая",
    "уточненный", "уточненная", "локализация", "цель", "случай", "введение", "проведение", "выполнение", "исследование", "процедура",
)
WEIGHTS = {"fuzzy": 0.20, "token_set": 0.20, "token_sort": 0.15, "partial": 0.15, "jaccard": 0.10, "coverage": 0.15, "trigram": 0.05}


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def _sets(left: Column, right: Column, use) -> Column:
    return let(F.struct(left.alias("a"), right.alias("b")), lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), 0.0).otherwise(use(s["a"], s["b"])))


def token_jaccard(left: Column, right: Column) -> Column:
    return _sets(tokens(left), tokens(right), lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_coverage(left: Column, right: Column, low_value=LOW_VALUE_TOKENS) -> Column:
    """Mean of precision and recall over tokens that say something."""
    telling = lambda x: F.filter(tokens(x), lambda t: ~t.isin(*low_value))
    return _sets(telling(left), telling(right), lambda a, b: let(F.size(F.array_intersect(a, b)), lambda n: (n / F.size(a) + n / F.size(b)) / 2))


def grams(text: Column, n: int = 3, before: str = " ", after: str = " ") -> Column:
    """All n-grams of the padded text, repeats included."""
    text = F.concat(F.lit(before), text, F.lit(after))
    last = F.length(text) - (n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))


def _count(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda x: x == item))


def trigram_cosine(left: Column, right: Column, n: int = 3) -> Column:
    """Cosine of n-gram counts, one space of padding on each side."""
    square = lambda x: F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, g: s + F.pow(_count(x, g), F.lit(2)))
    dot = lambda a, b: F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, g: s + _count(a, g) * _count(b, g))
    return _sets(grams(left, n), grams(right, n), lambda a, b: dot(a, b) / (F.sqrt(square(a)) * F.sqrt(square(b))))


def search_trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-cased words, two spaces before and one after each."""
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: grams(w, 3, "  ", " "))))


def search_similarity(left: Column, right: Column) -> Column:
    return _sets(search_trigrams(left), search_trigrams(right), lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


# -- edit similarities: the definitions, for one pair; `edit` has them for many at once


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        matched = state & place.get(c, 0)
        state = (state + matched | state - matched) & full
    return len(a) - state.bit_count()


def indel(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|); two empty texts are equal."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_of(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    """The best of: common words, common with one's others, common with the other's others. 0 if a side has no word."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not left or not right):
        return 1.0
    both = " ".join(common)
    one, two = " ".join(common + left), " ".join(common + right)
    return max(indel(one, two), indel(both, one) if common else 0.0, indel(both, two) if common else 0.0)


def partial_of(a: str, b: str) -> float:
    """The best window of the longer text, of the shorter one's length or less at its ends."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    best = max(indel(short, long[i : i + n]) for i in range(len(long) - n + 1))
    for k in range(n - 1, 0, -1):
        if 2 * k / (n + k) <= best:  # no shorter window can do better
            break
        best = max(best, indel(short, long[:k]), indel(short, long[-k:]))
    return best


def weighted_of(a: str, b: str, token_set: float | None = None, token_sort: float | None = None, partial: float | None = None) -> float:
    """The best of the ratios; those that ignore order or length count a little less, partial ones less still the more the lengths differ."""
    if not a or not b:
        return 0.0
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    whole = max(indel(a, b), 0.95 * max(token_sort_of(a, b) if token_sort is None else token_sort, token_set_of(a, b) if token_set is None else token_set))
    return whole if ratio < 1.5 else max(whole, (0.9 if ratio <= 8 else 0.6) * (partial_of(a, b) if partial is None else partial))


SCORERS = ("weighted", "token_set", "token_sort", "partial")


def scores_of(a: str, b: str) -> tuple[float, float, float, float]:
    """All of SCORERS."""
    rest = token_set_of(a, b), token_sort_of(a, b), partial_of(a, b)
    return weighted_of(a, b, *rest), *rest


def _pairs(left: pd.Series, right: pd.Series, use) -> np.ndarray:
    """use(left names, right names, i, j) of a batch, each name prepared once."""
    (i, one), (j, two) = (pd.factorize(x.fillna(""), use_na_sentinel=False) for x in (left, right))
    return use(edit.Names(list(one)), edit.Names(list(two)), i, j)


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in SCORERS]))
def edit_scores(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_pairs(left, right, edit.scores), columns=SCORERS)


@F.pandas_udf(T.DoubleType())
def indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(_pairs(left, right, lambda a, b, i, j: edit.ratio(edit.subsequences(a, b, i, j), a.text.sizes[i], b.text.sizes[j])))


@F.pandas_udf(T.StringType())
def three_places(scores: pd.Series) -> pd.Series:
    """Rounded by the exact value of the double; the JVM rounds its shortest decimal form, so 0.5375 would be 0.538 instead of 0.537."""
    return scores.map("{:.3f}".format)


def combined_score(left: Column, right: Column, scores: Column, fuzzy: Column) -> Column:
    """The weighted score of a candidate, 4 places; `scores` has the edit similarities."""
    parts = {"fuzzy": fuzzy, "token_set": scores["token_set"], "token_sort": scores["token_sort"], "partial": scores["partial"]}
    parts |= {"jaccard": token_jaccard(left, right), "coverage": token_coverage(left, right), "trigram": trigram_cosine(left, right)}
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + parts[name] * weight
    return F.round(total, 4)
