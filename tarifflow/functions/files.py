"""What file names tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SUPPORTED = ("pdf", "docx", "xlsx", "xls")
NAME_STOP_WORDS = ("прайс", "price", "год", "года", r"20\d{2}")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\.]\.([^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*SUPPORTED)


def guess_year(name: Column) -> Column:
    return F.regexp_extract(name, r"(?U)\b(20\d{2})\b", 1).try_cast("int")


def guess_effective_date(name: Column) -> Column:
    return F.make_date(guess_year(name), F.lit(1), F.lit(1))


def guess_partner_name(name: Column) -> Column:
    kept = F.regexp_replace(stem(name), rf"(?iuU)\b({'|'.join(NAME_STOP_WORDS)})\b", " ")
    kept = F.trim(F.regexp_replace(F.regexp_replace(kept, "[_-]+", " "), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(kept, F.lit("")), stem(name))


def stable_id(*parts: Column) -> Column:
    """An id that stays the same when a task runs again."""
    digest = F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    return F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def uuid5_dns(name: Column) -> Column:
    """Name-based UUID, version 5, in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))
