"""Prices in noisy text as Column expressions.

Letters that scans confuse with digits count as digits.  One comma and no dot is a
decimal comma; any other commas are dropped.  `strict` reads three digits after a single
comma as thousands instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Letters read as 0 and as 1, and the pattern of a price.
ZERO_LETTERS = "OОоCСс"
ONE_LETTERS = "IІl"
PRICE_TOKEN = r"(?U)(?<![A-Za-zА-Яа-я])(?:[0-9IІlOОСC]{1,3}(?:[\s.,][0-9OОСC]{3})+|[0-9IІlOОСC]{3,})(?:[.,][0-9]{1,2})?(?![A-Za-zА-Яа-я])"
LOOK_BACK = 15
TRAILING = 3

AMOUNT = "decimal(38,10)"
STORED = "decimal(14,2)"


def normalize_money_text(value: Column, strict: bool = False) -> Column:
    text = F.translate(value.cast("string"), ZERO_LETTERS + ONE_LETTERS, "0" * len(ZERO_LETTERS) + "1" * len(ONE_LETTERS))
    text = F.regexp_replace(text, "[^0-9,.-]", "")
    text = F.regexp_replace(text, "^([^,.]*),(?![0-9]{3}$)([^,.]*)$" if strict else "^([^,.]*),([^,.]*)$", "$1.$2")
    return F.replace(text, F.lit(","), F.lit(""))


def parse_money(value: Column, strict: bool = False) -> Column:
    """A positive amount, or null. Positive before any rounding to cents."""
    return F.regexp_extract(normalize_money_text(value, strict), "^(?=.*[1-9])([0-9]+[.]?[0-9]*|[.][0-9]+)$", 1).try_cast(AMOUNT)


def extract_prices(text: Column) -> Column:
    """All amounts in order."""
    tokens = F.regexp_extract_all(text, F.lit(PRICE_TOKEN), F.lit(0))
    return F.filter(F.transform(tokens, lambda t: parse_money(t)), lambda p: p.isNotNull())


def last_prices(prices: Column, n: int = TRAILING) -> Column:
    return F.slice(prices, F.greatest(F.size(prices) - (n - 1), F.lit(1)), F.lit(n))


def name_before_prices(text: Column) -> Column:
    """Text without its trailing prices: cut before the last token, then before the one before it, for as long as the end of what is left holds a token."""

    def step(state: Column, start: Column) -> Column:
        return F.when(state["done"], state).otherwise(
            let(
                F.rtrim(F.substring(state["cut"], F.lit(1), start)),
                lambda cut: F.struct(cut.alias("cut"), ((cut != "") & ~F.right(cut, F.lit(LOOK_BACK)).rlike(PRICE_TOKEN)).alias("done")),
            )
        )

    def cut(parts: Column) -> Column:
        # where each token begins: the lengths of all that stands before it
        sizes = F.transform(F.sequence(F.lit(1), F.size(parts["tokens"])), lambda i: F.struct(F.length(F.get(parts["between"], i - 1)).alias("text"), F.length(F.get(parts["tokens"], i - 1)).alias("token")))
        starts = F.aggregate(
            sizes,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda s, n: F.struct((s["at"] + n["text"] + n["token"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + n["text"])).alias("starts")),
            lambda s: s["starts"],
        )
        first = F.struct(text.alias("cut"), F.lit(False).alias("done"))
        return F.when(F.size(parts["tokens"]) == 0, text).otherwise(F.aggregate(F.reverse(starts), first, step)["cut"])

    tokens = F.regexp_extract_all(text, F.lit(PRICE_TOKEN), F.lit(0))
    return let(F.struct(tokens.alias("tokens"), F.split(text, PRICE_TOKEN, -1).alias("between")), cut)


def split_trailing_prices(clean: Column) -> Column:
    """struct(name, prices) of a cleaned line."""
    return let(
        extract_prices(clean),
        lambda prices: F.struct(F.trim(F.when(F.size(prices) == 0, clean).otherwise(name_before_prices(clean))).alias("name"), last_prices(prices).alias("prices")),
    )
