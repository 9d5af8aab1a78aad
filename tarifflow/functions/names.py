"""Normalisation of service names as Column expressions.

Words are replaced one dictionary entry after the other, as the results of one may be
the input of the next.  Lemmas come from an optional table (`lemmatize`); without one,
words stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
TYPOS = {
    "иньекция": "инъекция",
    "коньюктива": "конъюнктива",
    "коньюктиву": "конъюнктива",
    "коньюнктива": "конъюнктива",
    "бронхоскопия": "бронхоскопия",
}
ABBREVIATIONS = {
    "оак": "общий анализ крови",
    "оам": "общий анализ мочи",
    "экг": "электрокардиография",
    "узи": "ультразвуковое исследование",
    "мрт": "магнитно резонансная томография",
    "кт": "компьютерная томография",
    "бца": "брахиоцефальные артерии",
    "фгдс": "фиброгастродуоденоскопия",
    "фкс": "фиброколоноскопия",
    "трузи": "трансректальное ультразвуковое исследование",
    "рча": "радиочастотная абляция",
    "хм": "холтеровское мониторирование",
    "чсс": "частота сердечных сокращений",
    "чдд": "частота дыхательных движений",
}
REWRITES = {
    "консультация": "прием",
    "консультативный": "прием",
    "конс": "прием",
    "приём": "прием",
    "врач": "",
    "врача": "",
    "доктор": "",
    "доктора": "",
    "специалист": "",
    "специалиста": "",
    "рентгенография": "рентген",
    "рентгенограмма": "рентген",
    "ультразвук": "ультразвуковое исследование",
}
SYNONYMS = {
    "прием": "прием",
    "приём": "прием",
    "консультация": "прием",
    "консультативный": "прием",
    "конс": "прием",
    "врача": "",
    "врач": "",
    "доктора": "",
    "доктор": "",
    "специалиста": "",
    "специалист": "",
    "первичный": "",
    "повторный": "",
    "узи": "ультразвуковое исследование",
    "ультразвуковое": "ультразвуковое",
    "ультразвук": "ультразвуковое исследование",
    "мрт": "магнитно резонансная томография",
    "кт": "компьютерная томография",
    "рентгенография": "рентген",
    "рентгенограмма": "рентген",
    "оак": "общий анализ крови",
    "оам": "общий анализ мочи",
    "экг": "электрокардиография",
}
NOISE_WORDS = (
    "усл", "услуга", "услуги", "глаз", "глаза", "левый", "левая", "левое", "левого", "правый", "правая", "правое", "правого",
    "первичный", "первичная", "первичное", "повторный", "повторная", "повторное", "однократно", "двукратно",
)
COUNTED_UNITS = r"\d+\s*(усл|услуга|глаз|глаза)"
SYMBOLS = r"[,.;:|/\\_\-+*]+"


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def remove_brackets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), "(?U)" + COUNTED_UNITS, " ")


def clean_symbols(text: Column) -> Column:
    return _collapse(F.regexp_replace(F.regexp_replace(text, "№", " "), SYMBOLS, " "))


def replace_words(text: Column, words: dict[str, str]) -> Column:
    """Whole words only, one entry after the other."""
    for old, new in words.items():  # literal patterns are compiled once
        text = F.regexp_replace(text, rf"(?U)\b{re.escape(old)}\b", f" {new} ")
    return _collapse(text)


def expand_synonyms(text: Column) -> Column:
    return replace_words(text, SYNONYMS)


def keep_token(token: Column) -> Column:
    return (F.length(token) > 1) & ~token.rlike(r"^(?U)\d+$") & ~token.isin(*NOISE_WORDS)


def name_tokens(text: Column) -> Column:
    """Tokens of a name after all replacements and before lemmas."""
    text = F.replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("ё"), F.lit("е"))
    text = clean_symbols(remove_brackets(text))
    for words in (TYPOS, ABBREVIATIONS, REWRITES):
        text = replace_words(text, words)
    return F.regexp_extract_all(text, F.lit("[a-zа-яё0-9]+"), F.lit(0))


def normalize_name(text: Column) -> Column:
    return F.array_join(F.filter(name_tokens(text), keep_token), " ")


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_name(text), " "), lambda t: t != ""))


def lemmatize(names: DataFrame, lemmas: DataFrame, name: str, result: str = "normalized") -> DataFrame:
    """`names` with its distinct names normalised through a (token, lemma) table."""
    distinct = names.select(F.col(name).alias("_lemma_of")).distinct()
    tokens = distinct.select("_lemma_of", F.posexplode_outer(name_tokens(F.col("_lemma_of"))).alias("_at", "token"))
    tokens = tokens.join(lemmas.select("token", "lemma").dropDuplicates(["token"]), "token", "left").withColumn("token", F.coalesce("lemma", "token"))
    kept = F.when(keep_token(F.col("token")), F.struct("_at", "token"))
    found = tokens.groupBy("_lemma_of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda t: t["token"]), " ").alias(result))
    return names.join(found, F.col(name).eqNullSafe(F.col("_lemma_of")), "left").drop("_lemma_of")
