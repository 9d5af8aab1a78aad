"""Cases derived by hand from the behaviour to match."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarifflow.functions import files, money, names, similarity, text


def values(spark, cases, column):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    return [r["r"] for r in rows.select("i", column(F.col("v")).alias("r")).orderBy("i").collect()]


MONEY = {
    "1 500": 1500, "1,500": Decimal("1.5"), "1,500,000": 1500000, "1,234.50": Decimal("1234.5"), "1.500.000": None, "1500-2000": None, "-500": None, "0": None, "-": None, "": None,
    "15OO": 1500, "от 500": 500, "False": 1, "None": None, "5.": 5, ".5": Decimal("0.5"), "1e3": 13, "0.004": Decimal("0.004"), None: None,
}


def test_money(spark):
    assert values(spark, list(MONEY), money.parse_money) == list(MONEY.values())


def test_strict_money(spark):
    assert values(spark, ["1,500", "1,5"], lambda c: money.parse_money(c, strict=True)) == [1500, Decimal("1.5")]


TRAILING = {
    "Общий анализ крови 3500 4200": ("Общий анализ крови", [3500, 4200]),
    "Приём 5 000 6 000": ("Приём", [5000, 6000]),
    "МРТ 15 000 150 000": ("МРТ", [15000150000]),
    "Услуга 100 200 300 400": ("Услуга", [100200300400]),
    "Услуга 1500 2500 3500 4500": ("Услуга", [2500, 3500, 4500]),
    "Анализ 123 крови 5000": ("Анализ", [123, 5000]),
    "123 Общий анализ крови развернутый 5000": ("123 Общий анализ крови развернутый", [123, 5000]),
    "B02 Осмотр 1500": ("B02 Осмотр", [1500]),
    "Name without price": ("Name without price", []),
    "": ("", []),
}


def test_trailing_prices(spark):
    got = values(spark, list(TRAILING), money.split_trailing_prices)
    assert [(g["name"], g["prices"]) for g in got] == list(TRAILING.values())


def test_clean_text(spark):
    cases = ["a  b\n c ", "ﬁ №5", None, "", "\tx\x1cy"]
    assert values(spark, cases, text.clean_text) == ["a b c", "fi No5", "", "", "x y"]


def test_keys(spark):
    cases = ["  Ёлка-2 (ёж)", "РАЗДЕЛ 1. Анализы", "Блокада нерва", "2024 год", "2024", "Прием врача", "кровь"]
    assert values(spark, cases, text.normalize_key)[:2] == ["елка 2 еж", "раздел 1 анализы"]
    key = lambda c: text.normalize_key(c)
    assert values(spark, cases, lambda c: text.is_section(key(c))) == [False, True, True, False, False, True, False]
    assert values(spark, cases, lambda c: text.is_noise(key(c))) == [False, False, False, True, True, False, False]


FILES = {
    "Клиника 8 2026.xlsx": ("Клиника 8", dt.date(2026, 1, 1)),
    "samal_2025.xlsx": ("samal 2025", None),
    "Прайс Самал 2025 год.xlsx": ("Самал", dt.date(2025, 1, 1)),
    "2025.xlsx": ("2025", dt.date(2025, 1, 1)),
}


def test_file_names(spark):
    assert values(spark, list(FILES), files.guess_partner_name) == [p for p, _ in FILES.values()]
    assert values(spark, list(FILES), files.guess_effective_date) == [d for _, d in FILES.values()]
    assert values(spark, ["a/b.PDF", "x.zip", "y.docx", ".xlsx"], files.is_supported) == [True, False, True, False]


def test_name_based_ids(spark):
    import uuid

    cases = ["Общий анализ крови|A1|None", "x|None|None", "", "a"]
    assert values(spark, cases, files.uuid5_dns) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, c)) for c in cases]


def test_names(spark):
    cases = ["ОАК (клинический)", "Консультация врача, первичный", "УЗИ 3 усл. левый глаз", None, "приём №5 экг"]
    assert values(spark, cases, names.normalize_name) == ["общий анализ крови", "прием", "ультразвуковое исследование", "", "прием электрокардиография"]
    assert values(spark, ["консультация врача узи"], names.expand_synonyms) == ["прием ультразвуковое исследование"]
    assert values(spark, ["а анализ анализ 12"], names.token_set) == [["анализ"]]


def test_lemmas(spark):
    rows = spark.createDataFrame([(1, "анализы крови"), (2, None), (3, "анализы крови")], "id int, raw string")
    lemmas = spark.createDataFrame([("анализы", "анализ"), ("крови", "кровь")], "token string, lemma string")
    got = {r["id"]: r["normalized"] for r in names.lemmatize(rows, lemmas, "raw").collect()}
    assert got == {1: "анализ кровь", 2: "", 3: "анализ кровь"}


def test_similarities(spark):
    rows = spark.createDataFrame([("a b", "b c"), ("", "a"), ("анализ крови", "анализ крови"), ("услуга a", "a"), ("ab", "ba")], "l string, r string")
    left, right = F.col("l"), F.col("r")
    got = rows.select(similarity.token_jaccard(left, right), similarity.token_coverage(left, right), similarity.trigram_cosine(left, right), similarity.trigram_cosine(right, left)).collect()
    assert [r[0] for r in got] == pytest.approx([1 / 3, 0, 1, 0.5, 0])
    assert [r[1] for r in got] == pytest.approx([0.5, 0, 1, 1, 0])
    assert all(r[2] == pytest.approx(r[3]) and -1e-9 <= r[2] <= 1 + 1e-9 for r in got)


@pytest.mark.parametrize(("a", "b", "length"), [("kitten", "sitting", 4), ("", "a", 0), ("abc", "abc", 3), ("xaybzc", "abc", 3)])
def test_common_subsequence(a, b, length):
    assert similarity.lcs_length(a, b) == length == similarity.lcs_length(b, a)


def test_ratios():
    assert similarity.token_sort_of("b a", "a b") == 1
    assert similarity.token_set_of("a b c", "a b") == 1
    assert similarity.partial_of("bc", "abcd") == 1
    assert 0 < similarity.weighted_of("анализ крови", "анализ мочи") < 1
