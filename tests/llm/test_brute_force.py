"""Decisions that SQL can't express, against plain versions: packing levels, secret spans, languages."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarifflow.llm import hd_language, packing, secret_scan


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(2, 13))
def test_each_piece_goes_to_the_level_with_the_least_squares(sizes, window):
    packer, levels = packing.Packer(window, 0), Counter()
    for k, total in enumerate(sizes):
        list(packer.place(k, np.zeros(total, np.uint32)))
        size = total % window
        if size:
            options = []
            for level in [0, *sorted(h for h in levels if levels[h])]:
                if level + size <= window:
                    after = levels.copy()
                    after[level] -= 1
                    after[level + size] += 1
                    options.append((sum(n * n for h, n in after.items() if 0 < h < window), level, after))
            # of equal sums the emptiest window
            levels = min(options, key=lambda o: o[:2])[2]
            levels = Counter({h: n for h, n in levels.items() if 0 < h < window and n})
        assert {h: int(n) for h, n in enumerate(packer.levels) if n} == levels
        assert {h: len(w) for h, w in enumerate(packer.open) if w} == levels


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def plain_spans(text):
    """Every window on its own, every character marked."""
    found = []
    for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text):
        found += [("assign", *m.span())] if len(m[2]) >= 8 else []
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) < 16:
            continue
        for at, part in secret_scan.parts(m[0]):
            if len(part) < 16 or not secret_scan.mixed(part):
                continue
            for kind, (members, sizes) in secret_scan.CLASSES.items():
                windows = [(i, i + w) for w, bits in sizes.items() for i in range(len(part) - w + 1) if set(part[i : i + w]) <= members and round(entropy(part[i : i + w]), 9) >= bits]
                joined = []
                for a, b in sorted(windows):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                found += [(kind, m.start() + at + a, m.start() + at + b) for a, b in joined if secret_scan.mixed(part[a:b])]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex", "entropy_hex", "entropy_base64").index(s[0]), s[2]))


def test_spans_as_from_every_window():
    rng = random.Random(4)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789", "aA1b", "ABCDEF0123456789"]
    words = ["the", "tokens", "password", "secret: ", "token = \"", "api_key:", "APIKEY='", "AKIA", "https://host.example/", "=", "/", "-", "é", " ", "\n", "example_", "aaaaaaaa", "Translation"]
    seen = Counter()
    for _ in range(3000):
        text = "".join(rng.choice(words) if rng.random() < 0.6 else "".join(rng.choice(a) for _ in range(rng.randrange(1, 50))) for a in rng.choices(alphabets, k=rng.randrange(1, 9)))
        got = secret_scan.spans_of(text)
        assert got == plain_spans(text), text
        seen.update(k for k, _, _ in got)
    assert set(seen) == set(secret_scan.KINDS) and min(seen.values()) > 20


def plain_bundle(text, d):
    """Sum over the trigrams of letters, words apart, of the letters' vectors turned by their place and multiplied."""
    out = np.zeros(d, np.int64)
    vector = lambda c: np.zeros(d, np.int64) + hd_language._letter_vector(0 if c == " " else ord(c), d)
    said = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    said = re.sub(" +", " ", said)
    for a, b, c in zip(said, said[1:], said[2:]):
        if b != " " or (a != " " and c != " "):
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_languages_as_from_whole_vectors(spark, seed):
    rng, d = random.Random(seed), 64
    words = {"en": "the cat and dogs are here with you", "de": "der Hund und die Katze für uns Ärger", "xx": "жил был кот"}
    say = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    known = [(say(lang, rng.randrange(1, 9)), lang) for lang in words for _ in range(6)] + [(None, "en"), ("the", None), ("12", "de")]
    asked = [say(rng.choice(list(words)), rng.randrange(1, 5)) for _ in range(40)] + [None, "", "12 !?", "q", "Σß", "the cat", "the cat"]
    prototypes = hd_language.train(spark.createDataFrame(known, "text string, lang string").repartition(3), dimensions=d)
    want = {lang: sum(plain_bundle(t, d) for t, m in known if m == lang and t is not None) for lang in words}
    assert {k: v.astype(np.int64).tolist() for k, v in prototypes.items()} == {k: v.tolist() for k, v in want.items()}
    got = hd_language.predict(spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "k int, text string"), prototypes).collect()
    for row in got:
        own = plain_bundle(asked[row["k"]], d)
        if not any(c.isalpha() for c in asked[row["k"]] or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        cosine = {lang: float(own @ v) / max(np.linalg.norm(own) * np.linalg.norm(v), 1e-12) for lang, v in want.items()}
        assert row["score"] == pytest.approx(max(0.0, max(cosine.values())), abs=1e-5)
        assert cosine[row["lang_pred"]] == pytest.approx(max(cosine.values()), abs=1e-5)
    assert len(got) == len(asked)


def test_equal_cosines_go_to_the_first_language(spark):
    prototypes = hd_language.train(spark.createDataFrame([("the cat", "b"), ("the cat", "a"), ("the cat", "c")], "text string, lang string"))
    assert hd_language.predict(spark.createDataFrame([("a cat",)], "text string"), prototypes).first()["lang_pred"] == "a"
