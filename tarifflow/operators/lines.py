"""Items from text lines: names may run over lines until one with a price.

The fold is gaps and islands: a line that is skipped or priced closes an island, so an
island's number is the count of closing lines before it, and an island gives an item iff
its last line is priced.  Lines need a true number within their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X

#: Fixed value: a code at the start of a line, then the name.
CODE = r"^([A-Za-zА-Яа-я]\d[\w.\-/]*|[A-ZА-Я]{1,4}\d[\w.\-/]*|\d{1,4})\s+(.+)$"
MIN_NAME = 3
RAW_LINES = 3000


def split_code(text: Column) -> Column:
    """struct(code, name); the code is null where there is none."""
    pattern = "(?U)" + CODE
    has = text.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 1)).alias("code"), F.trim(F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text)).alias("name"))


def islands(lines: DataFrame, document: str, number: str, closes: Column) -> DataFrame:
    """`lines` with the island of each: the count of closing lines before it."""
    before = W.partitionBy(document).orderBy(number).rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("island", F.coalesce(F.sum(closes.cast("int")).over(before), F.lit(0)))


def fold(lines: DataFrame, document: str, number: str, skip: Column, part: Column, prices: Column) -> DataFrame:
    """(document, source_row, name, prices) of each island that ends in a priced line.

    `part` is what a line gives to the name; skipped lines give nothing.
    """
    marked = lines.select(document, number, skip.alias("skip"), part.alias("part"), prices.alias("prices"))
    priced = ~F.col("skip") & (F.size("prices") > 0)
    held = islands(marked.withColumn("priced", priced), document, number, F.col("skip") | F.col("priced"))
    pieces = F.collect_list(F.when(~F.col("skip") & (F.col("part") != ""), F.struct(number, "part")))
    last = F.max(F.struct(number, "priced", "prices"))
    found = held.groupBy(document, "island").agg(F.trim(F.array_join(F.transform(F.array_sort(pieces), lambda p: p["part"]), " ")).alias("name"), last.alias("last"))
    return found.where("last.priced").select(document, F.col(f"last.{number}").alias("source_row"), "name", F.col("last.prices").alias("prices"))


def items_of_lines(lines: DataFrame, document: str = "doc_id", number: str = "line_no", text: str = "text", sections=X.SECTION_PREFIXES, compatibility: bool = True) -> DataFrame:
    """Items with code, name and prices: resident is the first price, nonresident the last of several."""
    clean = lines.select(document, number, X.clean_text(F.col(text), compatibility).alias("_line"))
    split = clean.withColumn("_split", M.split_trailing_prices(F.col("_line")))
    folded = fold(split, document, number, X.is_skipped(F.col("_line"), sections), F.col("_split.name"), F.col("_split.prices"))
    coded = folded.withColumn("_code", split_code(F.col("name"))).where(F.length("_code.name") >= MIN_NAME)
    first = F.element_at("prices", 1).try_cast(M.STORED)
    last = F.when(F.size("prices") > 1, F.element_at("prices", -1).try_cast(M.STORED))
    return coded.select(
        document,
        F.col("_code.name").alias("service_name_raw"),
        F.col("_code.code").alias("service_code_source"),
        first.alias("price_resident_kzt"),
        last.alias("price_nonresident_kzt"),
        first.alias("price_original"),
        F.lit("KZT").alias("currency_original"),
        "source_row",
    )


def raw_content(lines: DataFrame, document: str = "doc_id", number: str = "line_no", text: str = "text", most: int = RAW_LINES) -> DataFrame:
    """The first lines of each document as one text."""
    kept = lines.where(F.col(number) <= most).groupBy(document).agg(F.array_sort(F.collect_list(F.struct(number, F.coalesce(text, F.lit("")).alias("t")))).alias("l"))
    return kept.select(document, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("raw_content"))


def has_enough_text(lines: DataFrame, document: str = "doc_id", page: str = "page", text: str = "text", pages: int = 2, characters: int = 80) -> DataFrame:
    """(document, enough): whether the first pages hold text, so no scan needs reading."""
    size = F.length(F.trim(F.array_join(F.collect_list(F.when(F.col(page) <= pages, F.trim(text))), " ")))
    return lines.groupBy(document).agg((F.coalesce(size, F.lit(0)) >= characters).alias("enough"))
