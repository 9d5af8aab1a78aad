"""Lemmas of forms that the table doesn't have."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tarifflow.operators import lemmas, matching

#: Endings of regular nouns and adjectives by case and number; the first is the lemma's.
PARADIGMS = {
    "ия": ["ия", "ии", "ию", "ией", "ий", "иям", "иями", "иях"],
    "ка": ["ка", "ки", "ке", "ку", "кой", "кам", "ками", "ках"],
    "ный": ["ный", "ного", "ному", "ным", "ном", "ная", "ной", "ную", "ное", "ные", "ных", "ными"],
    "ние": ["ние", "ния", "нию", "нием", "нии", "ний", "ниям", "ниями", "ниях"],
    "тор": ["тор", "тора", "тору", "тором", "торе", "торы", "торов", "торам", "торами", "торах"],
}
PAIR = "token string, lemma string"


def forms(rng, n):
    """(token, lemma) of invented words."""
    stem = lambda: "".join(rng.choice("бвгдзлмпрсф") + rng.choice("аеиоу") for _ in range(rng.randrange(1, 4))) + rng.choice("длмрсч")
    out = []
    for _ in range(n):
        s, endings = stem(), rng.choice(list(PARADIGMS.values()))
        out += [(s + e, s + endings[0]) for e in endings]
    return out


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def by_hand(pairs, tokens):
    """The rules in dictionaries."""
    counts = {}
    for token, lemma in {t: min(m for u, m in pairs if u == t) for t, _ in pairs}.items():
        k = common(token, lemma)
        if k >= lemmas.STEM:
            for size in range(max(len(token) - k, 1), min(lemmas.LONGEST, len(token) - lemmas.STEM) + 1):
                counts.setdefault(token[-size:], Counter())[len(token) - k, lemma[k:]] += 1
    rules = {e: max(c, key=lambda r: (c[r], -r[0], r[1])) for e, c in counts.items()}
    rules = {e: r for e, r in rules.items() if counts[e][r] >= lemmas.LEAST_HELD}
    found = {}
    for token in tokens:
        fits = [e for e in rules if token.endswith(e) and len(e) <= len(token) - lemmas.STEM and len(token) - rules[e][0] >= lemmas.STEM]
        if fits:
            cut, put = rules[max(fits, key=len)]
            found[token] = token[: len(token) - cut] + put
    return found


def test_rules_as_by_hand(spark):
    rng = random.Random(1)
    pairs, tokens = forms(rng, 40), {t for t, _ in forms(rng, 40)} | {"ab", "щ", "ъъъъ"}
    got = {r["token"]: r["lemma"] for r in lemmas.apply(spark.createDataFrame([(t,) for t in tokens], "token string"), lemmas.learn(spark.createDataFrame(pairs, PAIR))).collect()}
    assert got == by_hand(pairs, tokens)


def test_forms_of_unseen_words(spark):
    """Words of the same declensions that the table has no form of: all right when this was written, as these endings decide."""
    rng = random.Random(2)
    taught, asked = forms(rng, 400), forms(rng, 200)
    known = {t for t, _ in taught}
    new = {t: m for t, m in asked if t not in known and sum(t == u for u, _ in asked) == 1}
    found = lemmas.apply(spark.createDataFrame([(t,) for t in new], "token string"), lemmas.learn(spark.createDataFrame(taught, PAIR))).collect()
    right = sum(new[r["token"]] == r["lemma"] for r in found) / len(new)
    assert right >= 0.9, right


def test_known_forms_come_first(spark):
    table = spark.createDataFrame([("печени", "печень"), ("почки", "почка"), ("точки", "точка"), ("дети", "ребенок"), (None, "x"), ("", "x"), ("1е", None)], PAIR)
    tokens = spark.createDataFrame([(t,) for t in ("печени", "бочки", "дети", "сеть", "12", "я", None)], "token string")
    assert {r["token"]: r["lemma"] for r in lemmas.complete(tokens.where("token IS NOT NULL"), table).collect()} == {"печени": "печень", "дети": "ребенок", "бочки": "бочка"}
    assert lemmas.learn(table.limit(0)).count() == lemmas.apply(tokens, lemmas.learn(table.limit(0))).count() == 0


def test_matching_by_unseen_forms(spark):
    table = spark.createDataFrame([("почки", "почка"), ("точки", "точка"), ("бочки", "бочка")], PAIR)
    services = spark.createDataFrame([("1", "Осмотр ручки", "x", "a", 1)], "service_id string, service_name string, category string, code string, ordinal int")
    items = spark.createDataFrame([("осмотр ручка", None)], "service_name_raw string, service_code_source string")
    found = matching.match(items, services, lemmas=table).select("service_id", "method", F.col("normalized_name")).first()
    assert tuple(found) == ("1", "exact", "осмотр ручка")
