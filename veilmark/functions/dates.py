"""Date normalisation to ``DD-MM-YYYY`` as Column expressions.

The policies differ on purpose: which form wins, and whether ranges are checked,
belongs to each document type.  Day 31 is accepted for every month.  One known quirk
is not kept: the year abbreviation is removed after a year only, so that a textual
date in August is read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.spans import let

#: Russian months in the genitive (fixed values).
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
#: Fragments that still name a month after bad recognition, tried in order (fixed values).
MONTH_FRAGMENTS = [("янв", 1), ("фев", 2), ("март", 3), ("мар", 3), ("апр", 4), ("мая", 5), ("май", 5), ("июн", 6), ("июл", 7), ("авг", 8), ("сен", 9), ("окт", 10), ("ноя", 11), ("дек", 12)]
_NUMERIC = r"([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{2,4})"
_TEXTUAL = r"([0-9]{1,2})\s+([а-яё]{3,20})\s+([0-9]{4})"


def _clean(c: Column, drop_marker: bool) -> Column:
    x = F.lower(F.trim(c))
    if drop_marker:
        x = F.regexp_replace(x, r"(?<=[0-9]{2})\s*г(?:\.|ода)?(?![а-яё])", "")
    return F.regexp_replace(F.regexp_replace(x, "[,—–]", " "), r"(?U)\s+", " ")


def month_number(name: Column) -> Column:
    """The number of a month in the genitive, or null."""
    return let(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int"), lambda k: F.when(k > 0, k))


def noisy_month(name: Column) -> Column:
    """As :func:`month_number`, else by the first fragment found in the word."""

    def named(x: Column) -> Column:
        out = F.lit(None).cast("int")
        for fragment, number in reversed(MONTH_FRAGMENTS):
            out = F.when(x.contains(fragment), number).otherwise(out)
        return F.coalesce(month_number(x), out)

    return let(name, named)


def _put(day: Column, month: Column, year: Column, years: tuple[int, int] | None) -> Column:
    full = let(year, lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).cast("int"))

    def show(x: Column) -> Column:
        text = F.concat_ws("-", F.lpad(x["d"].cast("string"), 2, "0"), F.lpad(x["m"].cast("string"), 2, "0"), x["y"].cast("string"))
        return text if years is None else F.when(x["d"].between(1, 31) & x["m"].between(1, 12) & x["y"].between(*years), text)

    return let(F.struct(day.cast("int").alias("d"), month.cast("int").alias("m"), full.alias("y")), show)


def _group(x: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(x, pattern, k)


def strict_date(c: Column | str, years: tuple[int, int] = (2020, 2035)) -> Column:
    """The first numeric date, valid or not, decides; without one a textual date."""
    return let(_clean(F.col(c) if isinstance(c, str) else c, True), lambda x: _strict(x, years))


def _strict(x: Column, years: tuple[int, int]) -> Column:
    g = lambda p, k: _group(x, p, k)
    numeric = _put(g(_NUMERIC, 1), g(_NUMERIC, 2), g(_NUMERIC, 3), years)
    textual = _put(g(_TEXTUAL, 1), month_number(g(_TEXTUAL, 2)), g(_TEXTUAL, 3), years)
    return F.when(x.rlike(_NUMERIC), numeric).when(x.rlike(_TEXTUAL), textual)


def invoice_date(c: Column | str, years: tuple[int, int] = (2020, 2035)) -> Column:
    """:func:`strict_date`, else a day, a misread month and a year."""
    loose = r"([0-9]{1,2})[^0-9а-яёa-z]{0,5}([а-яёa-z0-9]{3,20}?)[^0-9]{0,5}([0-9]{4})"

    def read(x: Column) -> Column:
        noisy = _put(_group(x, loose, 1), noisy_month(_group(x, loose, 2)), _group(x, loose, 3), years)
        return F.coalesce(_strict(x, years), F.when(x.rlike(loose), noisy))

    return let(_clean(F.col(c) if isinstance(c, str) else c, True), read)


def mixed_text_date(c: Column | str, years: tuple[int, int] = (2020, 2035)) -> Column:
    """:func:`invoice_date`, else parts gathered from anywhere in the text.

    The year is the first of this century in the window, the month the first word
    that names one, the day the first short number of a line, from 10 if any.
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(invoice_date(col, years), let(F.lower(col), lambda low: _gathered(low, years)))


def _gathered(low: Column, years: tuple[int, int]) -> Column:
    year = F.get(F.filter(F.regexp_extract_all(low, F.lit(r"(20[0-9]{2})"), F.lit(1)), lambda y: y.cast("int").between(*years)), 0)
    words = F.regexp_extract_all(low, F.lit(r"([а-яё]{3,20})"), F.lit(1))
    month = F.coalesce(F.get(F.filter(F.transform(words, noisy_month), lambda m: m.isNotNull()), 0), noisy_month(low))
    days = F.filter(
        F.transform(F.split(low, "\n"), lambda line: F.regexp_extract(line, r"(?<![0-9])([0-9]{1,2})(?![0-9])", 1).try_cast("int")),
        lambda d: d.between(1, 31),
    )
    day = let(days, lambda x: F.coalesce(F.array_max(F.filter(x, lambda d: d >= 10)), F.array_max(x)))
    parts = F.struct(day.alias("d"), month.alias("m"), year.alias("y"))
    return let(parts, lambda p: F.when(p["y"].isNotNull() & p["m"].isNotNull() & p["d"].isNotNull(), _put(p["d"].cast("string"), p["m"], p["y"], years)))


def template_date(value: Column, text: Column, fixed: str, markers: list[str]) -> Column:
    """Whether a date is the one of the printed form and not of the document."""
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.lower(text).contains(m)
    return F.coalesce(value == fixed, F.lit(False)) & marked


def padded_date(c: Column | str) -> Column:
    """Numeric parts padded, years completed, no range checks."""
    parts = F.split(F.col(c) if isinstance(c, str) else c, r"[./-]")
    return let(parts, lambda p: F.when(F.size(p) == 3, _put(F.get(p, 0), F.get(p, 1), F.get(p, 2), None)))


def purchase_date(c: Column | str, years: tuple[int, int] = (2020, 2035)) -> Column:
    """Numeric dates within ranges, textual ones as they are."""

    def read(x: Column) -> Column:
        numeric = _put(_group(x, _NUMERIC, 1), _group(x, _NUMERIC, 2), _group(x, _NUMERIC, 3), years)
        textual = _put(_group(x, _TEXTUAL, 1), month_number(_group(x, _TEXTUAL, 2)), _group(x, _TEXTUAL, 3), None)
        known = month_number(_group(x, _TEXTUAL, 2)).isNotNull()
        return F.when(x.rlike(_NUMERIC), numeric).when(x.rlike(_TEXTUAL) & known, textual)

    return let(_clean(F.col(c) if isinstance(c, str) else c, False), read)
