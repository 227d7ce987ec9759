"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.spans import let

#: Latin letters that look like Cyrillic ones, and those (fixed values).
LOOK_ALIKE_LATIN = "abcehkmoptxy"
LOOK_ALIKE_CYRILLIC = "авсенкмортху"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def inline_whitespace(c: Column | str) -> Column:
    """Every run of white space (no-break spaces too) becomes one space; trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def multiline_whitespace(c: Column | str) -> Column:
    """Blanks collapse within lines, and around line ends to one line end."""
    blanks = F.regexp_replace(F.translate(_col(c), " ", " "), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(blanks, r"(?U)\s*\n\s*", "\n"), r"(?U)^\s+|\s+$", "")


def line_whitespace(c: Column | str) -> Column:
    """Blanks collapse and edges are trimmed in each line; blank lines stay."""
    lines = F.split(F.regexp_replace(_col(c), r"\r\n?", "\n"), "\n")
    return F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t ]+", " "))), "\n")


def cell(c: Column | str) -> Column:
    """A table cell: null becomes empty, white space collapses."""
    return inline_whitespace(F.coalesce(_col(c), F.lit("")))


def table_header(c: Column | str) -> Column:
    """A header cell as lower-case words without parenthesised parts."""
    return bare_header(cell(c))


def bare_header(x: Column) -> Column:
    """:func:`table_header` of a text that is a cell already."""
    bare = F.regexp_replace(F.translate(F.lower(x), "ё", "е"), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def token(c: Column | str) -> Column:
    """A word reduced to its lower-case letters and digits."""
    return F.regexp_replace(F.translate(F.lower(_col(c)), "ё", "е"), r"[^\p{L}\p{N}]", "")


def look_alike(c: Column | str) -> Column:
    """A token whose look-alike Latin letters are Cyrillic."""
    return F.translate(token(c), LOOK_ALIKE_LATIN, LOOK_ALIKE_CYRILLIC)


def safe_filename(c: Column | str, fallback: str = "document") -> Column:
    """A name without characters that file systems refuse; never empty."""

    def clean(x: Column) -> Column:
        x = F.regexp_replace(x, r'(?U)[<>:"/\\|?*\x00-\x1f]|\s+', "_")
        return F.regexp_replace(F.regexp_replace(x, "_+", "_"), r"^[_.]+|[_.]+$", "")

    empty_to_null = lambda x: F.when(x != "", x)
    out = F.coalesce(empty_to_null(clean(F.coalesce(_col(c), F.lit("")))), empty_to_null(clean(F.lit(fallback))))
    return F.when(out.isNull(), F.raise_error(F.lit("the fallback name is unusable")).cast("string")).otherwise(out)


def natural_sort_key(c: Column | str, width: int = 20) -> Column:
    """A string that sorts runs of digits by value and the rest by lower case."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, width, "0")).otherwise(r)), ""
    )


def digits(c: Column | str) -> Column:
    """The digits of a text, or null without any."""
    d = F.regexp_replace(_col(c), "[^0-9]+", "")
    return F.when(d != "", d)


def inn(c: Column | str) -> Column:
    """A taxpayer number of 10 or 12 digits, else null."""
    d = digits(c)
    return F.when(F.length(d).isin(10, 12), d)


def receipt_number(c: Column | str, stop_words: list[str]) -> Column:
    """A receipt's number without blanks and edge punctuation, if it looks like one."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), r"(?U)\s+", ""), r"^[\p{Punct}№]+|[\p{Punct}№]+$", "")
    good = lambda x: (F.length(x) >= 3) & x.rlike("[0-9]") & ~F.lower(x).isin(*stop_words)
    return let(bare, lambda x: F.when(good(x), x))


def unit(c: Column | str) -> Column:
    """A unit of measure: codes and empty brackets dropped, at least a letter left."""
    x = cell(c)
    bare = F.regexp_replace(x, r"(?<![\p{L}\p{N}])[0-9]{2,4}(?![\p{L}\p{N}])", "")
    bare = inline_whitespace(F.regexp_replace(bare, r"\(\s*\)", ""))
    marker = F.lower(x).rlike(r"^[0-9]{1,2}[аa-bб]?$") | x.rlike(r"^[0-9.,]+$")
    return F.when(~marker & bare.rlike(r"\p{L}"), bare)


def preview(c: Column | str, collapse: bool = True, size: int = 500) -> Column:
    """The beginning of a text on one line."""
    x = inline_whitespace(c) if collapse else F.translate(_col(c), "\n", " ")
    return F.substring(x, 1, size)
