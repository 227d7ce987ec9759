"""Money as Column expressions; strings keep their scale, sums are decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.spans import let


def _bare(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.translate(F.regexp_replace(x, r"(?U)\s+", ""), ",", ".")


def strict_money(c: Column | str) -> Column:
    """Digits with one or two decimals at most, the scale kept; else null."""
    return let(_bare(c), lambda x: F.when(x.rlike(r"^[0-9]+(?:\.[0-9]{1,2})?$"), x))


def parse_decimal(c: Column | str, first_number: bool = False, scale: int = 6) -> Column:
    """A decimal, optionally of the first signed number in the text; else null."""
    x = _bare(c)
    if first_number:
        x = F.regexp_extract(x, r"[+-]?[0-9]+(?:\.[0-9]+)?", 0)
    return x.try_cast(f"decimal(38,{scale})")


def format_decimal(c: Column, places: int) -> Column:
    """A decimal with a fixed number of places, halves to even."""
    if places < 0:
        raise ValueError("places must not be negative")
    return F.bround(c, places).cast(f"decimal(38,{places})").cast("string")


def last_three_amounts(text: Column) -> Column:
    """Net, tax and gross: the last three amounts with two decimals of a text."""
    found = F.regexp_extract_all(text, F.lit(r"((?<![0-9,.])[0-9]{1,3}(?:[  ]?[0-9]{3})*,[0-9]{2}(?![0-9]))"), F.lit(1))
    amounts = F.filter(F.transform(found, strict_money), lambda x: x.isNotNull())
    at = lambda x, k: F.when(F.size(x) >= 3, F.try_element_at(x, F.lit(k)))
    return let(amounts, lambda x: F.struct(at(x, -3).alias("net"), at(x, -2).alias("tax"), at(x, -1).alias("gross")))


def two_decimals(c: Column | str) -> Column:
    """A money string with exactly two decimals."""
    return _bare(c).try_cast("decimal(38,2)").cast("string")


def rounded_money(c: Column | str) -> Column:
    """Anything but digits, signs and separators dropped; two places, halves to even."""
    x = F.regexp_replace(F.translate(F.col(c) if isinstance(c, str) else c, ",", "."), r"[^0-9.\-]", "")
    return F.bround(x.try_cast("decimal(38,10)"), 2).cast("decimal(38,2)")


def labelled_totals(text: Column, label: str) -> Column:
    """Three numbers behind a label, each within 80 characters without digits."""
    number = r"([0-9][0-9  ]*[.,][0-9]{2})"
    pattern = rf"(?iu){label}[^0-9]{{0,80}}{number}[^0-9]{{1,80}}{number}[^0-9]{{1,80}}{number}"
    g = lambda k: rounded_money(F.regexp_extract(text, pattern, k)).cast("string")
    return F.struct(g(1).alias("net"), g(2).alias("tax"), g(3).alias("total"))
