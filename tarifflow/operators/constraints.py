"""Constraints of stored tables: rows that break one go to a table of rejects, with the names of the rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CURRENCIES, DEFAULT_CURRENCY, FILE_FORMATS, PARSE_STATUSES


@dataclass(frozen=True)
class Rules:
    key: str
    required: tuple[str, ...] = ()
    #: values of columns that are null or missing, as SQL
    defaults: dict[str, str] = field(default_factory=dict)
    accepted: dict[str, tuple[str, ...]] = field(default_factory=dict)
    longest: dict[str, int] = field(default_factory=dict)
    #: column -> table whose key it has to be
    parents: dict[str, str] = field(default_factory=dict)
    #: columns that no two rows with `where` may share; nulls never do
    once: tuple[str, ...] = ()
    where: str = "true"


#: The rules of the relational schema.
RULES = {
    "service": Rules("service_id", ("service_name",), {"service_id": "uuid()", "synonyms": "array()", "is_active": "true"}),
    "partner": Rules("partner_id", ("name",), {"partner_id": "uuid()", "is_active": "true", "created_at": "current_timestamp()", "updated_at": "current_timestamp()"}, longest={"bin": 12}),
    "price_document": Rules(
        "doc_id",
        ("file_name",),
        {"doc_id": "uuid()", "parse_status": "'pending'", "created_at": "current_timestamp()"},
        {"file_format": FILE_FORMATS, "parse_status": PARSE_STATUSES},
        parents={"partner_id": "partner"},
    ),
    "price_item": Rules(
        "item_id",
        ("service_name_raw",),
        {"item_id": "uuid()", "currency_original": f"'{DEFAULT_CURRENCY}'", "is_verified": "false", "is_active": "true", "created_at": "current_timestamp()"},
        {"currency_original": CURRENCIES},
        parents={"doc_id": "price_document", "partner_id": "partner", "service_id": "service"},
        once=("partner_id", "service_name_raw", "effective_date"),
        where="is_active",
    ),
}


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split(" ", 1)) for f in schema.split(", ")]


def filled(rows: DataFrame, schema: str, rules: Rules) -> DataFrame:
    """The columns of `schema` with defaults for missing values, and `violations` of values that a column can't hold."""
    out, wrong = [], []
    for name, kind in _fields(schema):
        given = F.col(name) if name in rows.columns else F.lit(None).cast(kind)
        value = given.try_cast(kind)
        wrong.append(F.when(given.isNotNull() & value.isNull(), f"type of {name}"))
        out.append((F.coalesce(value, F.expr(rules.defaults[name]).cast(kind)) if name in rules.defaults else value).alias(name))
    return rows.select(*out, F.array_compact(F.array(*wrong)).alias("violations"))


def _own(rules: Rules) -> list[Column]:
    """Rules that a row breaks by itself."""
    found = [F.when(F.col(c).isNull(), f"{c} is null") for c in rules.required]
    found += [F.when(~F.col(c).isin(*values), f"value of {c}") for c, values in rules.accepted.items()]
    return found + [F.when(F.length(c) > n, f"length of {c}") for c, n in rules.longest.items()]


def _first_of(rows: DataFrame, columns: tuple[str, ...], key: str, binding: Column, there: DataFrame) -> DataFrame:
    """`rows` with _again: whether a row that binds shares `columns` with one that is there or comes before it by `key`."""
    by = [F.col(c) for c in columns]
    counts = rows.where(binding).groupBy(*by).agg(F.min(key).alias("_first"))
    taken = there.select(*by).distinct().withColumn("_taken", F.lit(True))
    found = rows.join(counts.join(taken, list(columns), "left"), list(columns), "left")
    return found.withColumn("_again", binding & (F.coalesce("_taken", F.lit(False)) | (F.col(key) != F.col("_first")))).drop("_first", "_taken")


def checked(rows: DataFrame, rules: Rules, parents: dict[str, DataFrame], keys: DataFrame, active: DataFrame | None, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Filled rows with `violations`, empty for those that may be stored; `ordinal` tells equal rows apart.

    keys: what is stored of `rules.key`; active: of `rules.once`, where that binds. Only rows
    without another violation bind; of those that share something, the first by key does.

    Values without a parent and hashes that occur more than once are found first, from those
    columns alone, and stored by `written`. Where they are few, whole rows aren't dealt out,
    but for those that may share something.
    """
    rows = rows.withColumn("violations", F.concat("violations", F.array_compact(F.array(*_own(rules), F.lit(None).cast("string")))))
    nulls = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in rules.once), F.lit(True))
    unique = [((rules.key,), F.lit(True), keys, f"{rules.key} again")]
    if rules.once:
        unique.append((rules.once, F.coalesce(F.expr(rules.where), F.lit(False)) & nulls, active, f"{', '.join(rules.once)} again"))
    marked = rows
    for column, parent in parents.items():
        there = parent.select(F.col(parent.columns[0]).alias(column))
        lost = written(rows.select(column).where(F.col(column).isNotNull()).distinct().join(there, column, "left_anti"))
        missing = F.when(F.col("_lost"), f"{column} without a row")
        marked = marked.join(lost.withColumn("_lost", F.lit(True)), column, "left").withColumn("violations", F.array_compact(F.concat("violations", F.array(missing)))).drop("_lost")
    marked = marked.withColumn("_shares", F.lit(False))
    for columns, binding, there, _ in unique:
        value = F.xxhash64(*columns).alias("_hash")
        both = rows.where(binding).select(value).unionByName(there.select(value))
        again = written(both.groupBy("_hash").count().where("count > 1").select("_hash", F.lit(True).alias("_held")))
        marked = marked.withColumn("_hash", F.when(binding, value)).join(again, "_hash", "left").withColumn("_shares", F.col("_shares") | F.coalesce("_held", F.lit(False))).drop("_hash", "_held")
    # all rows that share something with one of these are among them
    some = marked.where("_shares").drop("_shares")
    # rows that repeat a key: the other columns decide which is the first
    some = some.withColumn("_row", F.struct(rules.key, F.xxhash64(*[c for c in rows.columns if c not in ("violations", "ordinal")]).alias("rest"), "ordinal"))
    fine = F.size("violations") == 0
    for columns, binding, there, name in unique:
        some = _first_of(some, columns, "_row", fine & binding, there)
        some = some.withColumn("violations", F.when(F.col("_again"), F.array_append("violations", F.lit(name))).otherwise(F.col("violations"))).drop("_again")
    some = written(some.drop("_row", "ordinal"))
    return marked.where("NOT _shares").drop("_shares", "ordinal").unionByName(some)
