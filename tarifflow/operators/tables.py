"""Items from tables of cells: header by score, columns by title, prices by column.

Input rows are (document, sheet, row_pos from 0, cells array<string>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X

#: Words of headers, and needles of each column in order of priority.
HEADER_STEMS = ("наименование", "услуг", "цена", "стоимость", "код", "тариф")
NAME_NEEDLES = ("наименование", "услуга", "название")
CODE_NEEDLES = ("код", "тарификатор", "мкб")
RESIDENT_NEEDLES = ("резидент", "республики казахстан", "рк", "страхов")
NONRESIDENT_NEEDLES = ("нерезидент", "снг", "дальнего", "зарубежья")
ORIGINAL_NEEDLES = ("цена", "стоимость", "тариф")
PRICE_WORDS = ("цена", "стоимость", "тариф", "тенге")
HEADER_ROWS, HEADER_SCAN, HEADER_SCORE = 3, 80, 2

TABLE = ("doc_id", "sheet")


def header_score(cells: Column, stems=HEADER_STEMS, compatibility: bool = True) -> Column:
    key = X.normalize_key(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " "), compatibility)
    score = F.lit(0)
    for stem in stems:
        score = score + key.contains(stem).cast("int")
    return score


def pick_headers(rows: DataFrame, keys=TABLE, stems=HEADER_STEMS, scan: int = HEADER_SCAN, least: int = HEADER_SCORE, compatibility: bool = True) -> DataFrame:
    """(keys, header): the best row of the first ones, the latest of equals; tables without one go."""
    best = rows.where(F.col("row_pos") < scan).groupBy(*keys).agg(F.max(F.struct(header_score(F.col("cells"), stems, compatibility).alias("score"), "row_pos")).alias("b"))
    return best.where(F.col("b.score") >= least).select(*keys, F.col("b.row_pos").alias("header"))


def merged_headers(rows: DataFrame, headers: DataFrame, keys=TABLE, compatibility: bool = True) -> DataFrame:
    """(keys, col, title): titles joined over the header row and the two after it."""
    near = rows.join(headers, list(keys)).where((F.col("row_pos") >= F.col("header")) & (F.col("row_pos") < F.col("header") + HEADER_ROWS))
    cells = near.select(*keys, "row_pos", F.posexplode("cells").alias("col", "cell")).withColumn("cell", X.clean_text(F.col("cell"), compatibility))
    parts = F.array_sort(F.collect_list(F.when(F.col("cell") != "", F.struct("row_pos", "cell"))))
    return cells.groupBy(*keys, "col").agg(F.array_join(F.transform(parts, lambda p: p["cell"]), " ").alias("title"))


def _first(key: Column, needles) -> Column:
    return F.min(F.when(X.contains_any(key, needles), F.col("col")))


def _price(key: Column, needles, words) -> Column:
    """The first price column of the first needle that any holds, else the first price column."""
    rank = F.lit(None).cast("int")
    for k, needle in reversed(list(enumerate(needles))):
        rank = F.when(key.contains(needle), k).otherwise(rank)
    # a column counts for each needle that it holds; the least is the best
    wanted = F.when(X.contains_any(key, words) & rank.isNotNull(), F.struct(rank.alias("rank"), F.col("col").alias("col")))
    return F.coalesce(F.min(wanted)["col"], F.min(F.when(X.contains_any(key, words), F.col("col"))))


def column_map(titles: DataFrame, keys=TABLE, name=NAME_NEEDLES, code=CODE_NEEDLES, resident=RESIDENT_NEEDLES, nonresident=NONRESIDENT_NEEDLES, original=ORIGINAL_NEEDLES, words=PRICE_WORDS) -> DataFrame:
    """(keys, name_col, code_col, resident_col, nonresident_col, original_col); null where not found."""
    key = F.col("_key")
    return (
        titles.withColumn("_key", X.key_of_clean(F.col("title")))
        .groupBy(*keys)
        .agg(
            _first(key, name).alias("name_col"),
            _first(key, code).alias("code_col"),
            _price(key, resident, words).alias("resident_col"),
            _price(key, nonresident, words).alias("nonresident_col"),
            _price(key, original, words).alias("original_col"),
        )
    )


#: Cells of a row are cleaned at once, kept apart by a character that cleaning leaves alone.
_APART = "\ue000"


def _joined(cells: Column, compatibility: bool = True) -> Column:
    return X.clean_text(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), _APART), compatibility)


def _position(keys: Column, use) -> Column:
    """Place from 0 of the first key for which `use` holds, null if for none."""
    return F.nullif(F.array_position(F.transform(keys, use), F.lit(True)), F.lit(0)).cast("int") - 1


def headers_and_columns(rows: DataFrame, keys=TABLE, compatibility: bool = True, stems=HEADER_STEMS, scan: int = HEADER_SCAN, least: int = HEADER_SCORE) -> DataFrame:
    """(keys, header, name_col, …): `pick_headers` and `column_map` of the merged headers at once, from the first rows of each table."""
    first = rows.where(F.col("row_pos") < scan + HEADER_ROWS - 1).select(*keys, "row_pos", _joined(F.col("cells"), compatibility).alias("line"))
    key = X.key_of_clean(F.replace(F.col("line"), F.lit(_APART), F.lit(" ")))
    score = sum((key.contains(stem).cast("int") for stem in stems), F.lit(0))
    listed = first.select(*keys, "row_pos", "line", score.alias("score"))
    best = F.max(F.when(F.col("row_pos") < scan, F.struct("score", "row_pos"))).alias("b")
    # at most scan + 2 rows a table
    found = listed.groupBy(*keys).agg(best, F.collect_list(F.struct("row_pos", "line")).alias("rows")).where(F.col("b.score") >= least)
    near = F.filter("rows", lambda r: (r["row_pos"] >= F.col("b.row_pos")) & (r["row_pos"] < F.col("b.row_pos") + HEADER_ROWS))
    split = F.transform(F.array_sort(near), lambda r: F.transform(F.split(r["line"], _APART), lambda c: F.trim(c)))
    found = found.select(*keys, F.col("b.row_pos").alias("header"), split.alias("near"))
    width = F.array_max(F.transform("near", lambda r: F.size(r)))
    said = lambda c: F.filter(F.transform("near", lambda r: F.get(r, c)), lambda t: t.isNotNull() & (t != ""))
    found = found.withColumn("titles", F.transform(F.sequence(F.lit(0), width - 1), lambda c: X.key_of_clean(F.array_join(said(c), " "))))
    price = lambda k: X.contains_any(k, PRICE_WORDS)
    of = lambda needles: _position(F.col("titles"), lambda k: X.contains_any(k, needles))
    one = lambda needle: _position(F.col("titles"), lambda k: price(k) & k.contains(needle))
    priced = lambda needles: F.coalesce(*map(one, needles), _position(F.col("titles"), price))
    return found.select(
        *keys,
        "header",
        of(NAME_NEEDLES).alias("name_col"),
        of(CODE_NEEDLES).alias("code_col"),
        priced(RESIDENT_NEEDLES).alias("resident_col"),
        priced(NONRESIDENT_NEEDLES).alias("nonresident_col"),
        priced(ORIGINAL_NEEDLES).alias("original_col"),
    )


def cell(cells: Column, at: Column, compatibility: bool = True) -> Column:
    """A cleaned cell; empty where the column is unknown or beyond the row."""
    return X.clean_text(F.when(at.isNotNull(), F.try_element_at(cells, at + 1)), compatibility)


def money_at(cells: Column, at: Column) -> Column:
    return F.when(at.isNotNull(), M.parse_money(F.try_element_at(cells, at + 1)))


def rows_to_items(rows: DataFrame, headers: DataFrame, columns: DataFrame | None = None, keys=TABLE, sections=X.SECTION_PREFIXES, compatibility: bool = True) -> DataFrame:
    """Items of the rows below each header: named, not skipped, with a price; source_row counts from 1. `headers` may have the columns too."""
    cells = F.col("cells")
    found = rows.join(headers, list(keys)).where("row_pos > header")
    found = found if columns is None else found.join(columns, list(keys))
    # generated, not selected, so that filters on a value don't compute it again
    values = F.struct(
        cell(cells, F.col("name_col"), compatibility).alias("service_name_raw"),
        F.nullif(cell(cells, F.col("code_col"), compatibility), F.lit("")).alias("service_code_source"),
        *(money_at(cells, F.col(f"{c}_col")).alias(c) for c in ("resident", "nonresident", "original")),
    )
    found = found.select(*keys, (F.col("row_pos") + 1).cast("int").alias("source_row"), F.inline(F.array(values)))
    found = found.where(~X.is_skipped(F.col("service_name_raw"), sections)).where("coalesce(resident, nonresident, original) IS NOT NULL")
    resident = F.coalesce("resident", "original")
    return found.select(
        *keys,
        "source_row",
        "service_name_raw",
        "service_code_source",
        resident.try_cast(M.STORED).alias("price_resident_kzt"),
        F.col("nonresident").try_cast(M.STORED).alias("price_nonresident_kzt"),
        F.coalesce("original", resident, "nonresident").try_cast(M.STORED).alias("price_original"),
        F.lit("KZT").alias("currency_original"),
    )


def items_of_tables(rows: DataFrame, keys=TABLE, sections=X.SECTION_PREFIXES, compatibility: bool = True) -> DataFrame:
    return rows_to_items(rows, headers_and_columns(rows, keys, compatibility), None, keys, sections, compatibility)


def raw_content(rows: DataFrame, document: str = "doc_id", per_sheet: int = 30) -> DataFrame:
    """The first rows of each sheet as text, under its title; sheets by `sheet_no` if there is one, else by title."""
    number = F.col("sheet_no") if "sheet_no" in rows.columns else F.lit(0)
    kept = rows.where(F.col("row_pos") < per_sheet).select(document, number.alias("sheet_no"), "sheet", "row_pos", _joined(F.col("cells")).alias("line"))
    line = F.array_join(F.filter(F.transform(F.split("line", _APART), lambda c: F.trim(c)), lambda c: c != ""), " | ")
    sheets = kept.groupBy(document, "sheet_no", "sheet").agg(F.array_sort(F.collect_list(F.struct("row_pos", line.alias("t")))).alias("l"))
    text = F.concat(F.lit("# "), F.coalesce("sheet", F.lit("")), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    return sheets.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", "sheet", text.alias("t")))), lambda x: x["t"]), "\n").alias("raw_content"))


def document_content(paragraphs: DataFrame, rows: DataFrame, document: str = "doc_id", most: int = 500) -> DataFrame:
    """All paragraphs of each word-processor document, then the first rows of its tables, as one text."""
    said = paragraphs.select(document, F.lit(0).alias("part"), F.lit(0).alias("table"), F.col("line_no").alias("place"), X.clean_text(F.col("text")).alias("t")).where("t != ''")
    number = F.regexp_extract("sheet", "[0-9]+$", 0).cast("int")
    listed = rows.select(document, F.lit(1).alias("part"), number.alias("table"), F.col("row_pos").alias("place"), F.regexp_replace(_joined(F.col("cells")), f" ?{_APART} ?", " | ").alias("t"))
    nth = F.row_number().over(W.partitionBy(document).orderBy("table", "place"))
    listed = listed.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    lines = said.unionByName(listed).groupBy(document).agg(F.array_sort(F.collect_list(F.struct("part", "table", "place", "t"))).alias("l"))
    return lines.select(document, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("raw_content"))
