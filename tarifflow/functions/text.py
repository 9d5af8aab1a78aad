"""Text cleaning and line predicates as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefixes of section titles and of noise lines, on the normalized key.
SECTION_PREFIXES = ("раздел", "подраздел", "блок", "стационар", "прием врача")
NOISE_PREFIXES = ("приложение", "утверждаю", "председатель", "прейскурант", "цены на", "стоимость", "код наименование")
NOISE_YEAR = "^20[0-9]{2}( год| года)?$"


#: ASCII and Russian letters, which NFKC leaves as they are.
STABLE = "^[\\x{00}-\\x{7f}\\x{410}-\\x{44f}\\x{401}\\x{451}]*$"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def spaces(text: Column) -> Column:
    """White space of any kind, once and not at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def clean_text(text: Column, compatibility: bool = True) -> Column:
    """Null becomes empty; NFKC and single spaces. Texts that NFKC can't change go through Python as nulls, all rows do so; with `compatibility` off none does."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if compatibility:
        text = F.coalesce(_nfkc(F.when(~text.rlike(STABLE), text)), text)
    return spaces(text)


def key_of_clean(text: Column) -> Column:
    """The key of text that is already clean."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "ё", "е"), "[^0-9a-zа-яё]+", " "))


def normalize_key(text: Column, compatibility: bool = True) -> Column:
    return key_of_clean(clean_text(text, compatibility))


def _begins(prefixes) -> str:
    """A pattern of texts that begin with any of these; one that none does if there are none."""
    return "^(?:" + ("|".join(map(re.escape, prefixes)) or "(?!)") + ")"


def contains_any(key: Column, words) -> Column:
    return key.rlike("|".join(map(re.escape, words)) or "(?!)")


# one pattern each, as a filter computes its key anew wherever it stands


def is_section(key: Column, prefixes=SECTION_PREFIXES) -> Column:
    return key.rlike(_begins(prefixes))


def is_noise(key: Column) -> Column:
    return key.rlike("|".join(("^$", _begins(NOISE_PREFIXES), NOISE_YEAR)))


def is_skipped(clean: Column, sections=SECTION_PREFIXES) -> Column:
    """Lines and names that hold no item: empty, noise, or a section title."""
    return key_of_clean(clean).rlike("|".join(("^$", _begins(NOISE_PREFIXES), NOISE_YEAR, _begins(sections))))
