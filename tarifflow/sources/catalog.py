"""The service catalogue: columns under any of their titles, ids that stay the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import uuid5_dns

#: Titles of each column, in order of preference.
TITLES = {
    "service_name": ("service_name", "Name_ru", "name", "Название"),
    "category": ("category", "Специальность", "Категория"),
    "code": ("Code", "code", "service_code"),
    "tarificator_code": ("TarificatrCode", "tarificator_code", "Тарификатор"),
    "service_id": ("service_id", "uuid", "ID"),
    "synonyms": ("synonyms", "Синонимы", "aliases"),
}


def pick(columns: list[str], titles: tuple[str, ...]) -> Column:
    """The first value that isn't blank, of the columns that are there."""
    found = [F.nullif(F.trim(F.col(f"`{t}`").cast("string")), F.lit("")) for t in titles if t in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def split_synonyms(value: Column) -> Column:
    text = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^[\[\]]+|[\[\]]+$", "")
    parts = F.filter(F.split(text, r"[;,\n|]+"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), '^"+|"+$', ""), "^'+|'+$", ""))


def services(rows: DataFrame, order: str | None = None) -> DataFrame:
    """(service_id, service_name, category, code, tarificator_code, synonyms, ordinal) of rows that have a name."""
    picked = {name: pick(rows.columns, titles) for name, titles in TITLES.items()}
    text = lambda c: F.coalesce(c, F.lit("None"))
    named = uuid5_dns(F.concat(picked["service_name"], F.lit("|"), text(picked["code"]), F.lit("|"), text(picked["tarificator_code"])))
    out = rows.select(
        F.coalesce(picked["service_id"], named).alias("service_id"),
        *(picked[c].alias(c) for c in ("service_name", "category", "code", "tarificator_code")),
        split_synonyms(picked["synonyms"]).alias("synonyms"),
        (F.col(order) if order else F.monotonically_increasing_id()).alias("ordinal"),
    )
    return out.where("service_name IS NOT NULL")


def from_cells(cells: DataFrame) -> DataFrame:
    """Rows of one sheet of cells under the titles of its first row, with row_pos: the titles are the only thing read ahead."""
    first = cells.where("row_pos = 0").select("cells").first()
    titles = [t for t in (first[0] if first else []) if t]
    places = {t: first[0].index(t) for t in dict.fromkeys(titles)} if first else {}
    return cells.where("row_pos > 0").select("row_pos", *(F.try_element_at("cells", F.lit(k + 1)).alias(t) for t, k in places.items()))
