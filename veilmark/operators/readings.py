"""Choosing among several readings of the same digits on a scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.text import digits


def digit_score(c: Column) -> Column:
    """struct(value, score): plausible lengths of a document number score best."""
    d = digits(c)
    n = F.length(d)
    score = F.when(n == 1, 10).when(n.between(2, 4), 100 + n).when(n == 5, 95).when(n > 5, 20)
    return F.struct(F.substring(d, 1, 6).alias("value"), score.alias("score"))


def prefer_shorter(candidates: Column) -> Column:
    """The value of an array of readings that neighbours' digits least spoilt.

    A value of 3 or 4 digits that begins a longer one; else 3 or 4 digits before 5,
    shorter ones first; else the first.
    """
    unique = F.array_distinct(F.filter(F.transform(candidates, digits), lambda d: d.isNotNull()))
    short = F.filter(unique, lambda d: F.length(d).between(3, 4))
    begins = F.filter(short, lambda d: F.exists(unique, lambda e: (F.length(e) > F.length(d)) & e.startswith(d)))
    ranked = F.array_sort(
        F.transform(
            F.filter(unique, lambda d: F.length(d).between(3, 5)),
            lambda d, i: F.struct((F.length(d) == 5).alias("long"), F.length(d).alias("n"), i.alias("i"), d.alias("d")),
        )
    )
    return F.coalesce(F.get(begins, 0), F.get(ranked, 0)["d"], F.get(unique, 0))


def crop_number(first: Column, others: Column) -> Column:
    """The first crop's number if it has 3 to 5 digits, else the best of all crops."""
    own = prefer_shorter(first)
    return F.when(F.length(own).between(3, 5), own).otherwise(prefer_shorter(F.concat(first, others)))


def status_vote(tight: Column, wide: Column, frames: Column, text: Column) -> Column:
    """Status 1 or 2 from readings of crops (arrays of texts) and the page's text.

    A 1 in any tight crop decides; then a single digit in the wide crop, then in
    the frames, then behind a label; a 2 seen anywhere comes last.
    """
    found = lambda a: F.array_distinct(F.flatten(F.transform(a, lambda x: F.regexp_extract_all(x, F.lit("([12])"), F.lit(1)))))
    alone = lambda a: F.when(F.size(found(a)) == 1, F.get(found(a), 0))
    labelled = F.nullif(F.regexp_extract(text, r"(?iuU)статус\s*[:№]?\s*([12])\b", 1), F.lit(""))
    two = F.when(F.array_contains(found(F.concat(tight, wide, frames)), "2"), "2")
    return F.coalesce(F.when(F.array_contains(found(tight), "1"), F.lit("1")), alone(wide), alone(frames), labelled, two)


def receipt_text(full: Column, sparse: Column) -> Column:
    """The page's text, with a sparse reading added if it is long enough to tell more."""
    return F.when(F.length(sparse) > F.length(full) * 0.75, F.concat_ws("\n", full, sparse)).otherwise(full)
