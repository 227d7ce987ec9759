"""Readings that are made only where they are needed.

A provider's readings are dear, so they are asked for by turns: what one turn settles is
left out of the next.  The best reading of a page is a maximum of an ordered struct, which
combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.operators.ordered import CONTINUATION, OTHER, continue_runs
from veilmark.sources.shared import stash

Reader = Callable[[DataFrame, int], DataFrame]
#: Angles in the order in which they are tried (fixed values).
ANGLES = [0, 90, 270, 180]
#: Points of a receipt's reading beside its confidence (fixed values).
RECEIPT_POINTS = {"is_recognized": 1000, "issuer_inn": 120, "issuer_name": 100, "total_amount": 40, "document_date": 30}


def receipt_reading_score() -> Column:
    """The score of a receipt's reading: its confidence and points for what it holds."""
    out = F.coalesce("confidence", F.lit(0))
    for name, points in RECEIPT_POINTS.items():
        given = F.coalesce(F.col(name).cast("string"), F.lit("")).isin("", "false")
        out = out + F.when(given, 0).otherwise(points)
    return out


def settle(pages: DataFrame, key: list[str], turns: list[int], read: Reader, complete: Column, score: Column) -> DataFrame:
    """The best reading of each page, with its ``turn`` and the number of ``readings`` made.

    ``read(pages, turn)`` gives rows (key, ...) of the pages still open; pages for which it
    gives none stay open.  The first ``complete`` reading settles a page and is its best; else
    the highest ``score`` wins, the earlier turn on ties.  Null scores are lowest, a null
    ``complete`` is false.  A page without any reading has no row.  Keys must not be null
    and are unique in ``pages``.
    """
    open_, made = pages, None
    for n, turn in enumerate(turns):
        got = read(open_, turn)
        fields = [c for c in got.columns if c not in key]
        rank = F.struct(F.coalesce(complete, F.lit(False)).alias("complete"), score.alias("score"), F.lit(-n).alias("order"), F.lit(turn).alias("turn"), F.struct(*fields).alias("reading"))
        got = stash(got.select(*key, rank.alias("rank")), "readings")
        made = got if made is None else made.unionByName(got)
        if turn != turns[-1]:
            open_ = stash(open_.join(got.where("rank.complete").select(*key), key, "left_anti"), "open-pages")
    order = F.struct("rank.complete", "rank.score", "rank.order")
    best = made.groupBy(*key).agg(F.max_by("rank", order).alias("rank"), F.count(F.lit(1)).alias("readings"))
    return best.select(*key, F.col("rank.turn").alias("turn"), "readings", F.col("rank.complete").alias("complete"), "rank.reading.*")


def reread_continuations(
    pages: DataFrame, key: list[str], run: list[str], order: list[str], read: Callable[[DataFrame], DataFrame], fields: list[str] = (),
    extra: str | None = None, parts: int | None = None,
) -> DataFrame:
    """Unrecognised pages behind an open run are read again, then continuations are attached.

    ``read(pages)`` gives (key, is_continuation) for the pages it gets: those that could continue
    a run if all unrecognised pages before them in a row did, which needs no more than one
    round.  One that is a continuation by the second reading, and whose predecessors are,
    too, is attached; any other page stays as it was.  Adds ``re_read`` (whether the second
    reading was asked for) and what :func:`continue_runs` adds; ``kind`` is the final one.
    """
    kind = F.coalesce("kind", F.lit(OTHER))
    held = stash(pages, "pages")
    trial = continue_runs(held.withColumn("kind", F.when(kind == OTHER, CONTINUATION).otherwise(F.col("kind"))), run, order, parts=parts)
    reached = trial.where("attached").select(*key).join(held.where(kind == OTHER), key)
    reached = stash(reached.select(*held.columns), "unsure-pages")
    again = read(reached).select(*key, F.col("is_continuation").alias("_turned"))
    second = held.join(reached.select(*key, F.lit(True).alias("re_read")), key, "left").join(again, key, "left")
    second = second.withColumns({"re_read": F.coalesce("re_read", F.lit(False)), "_first": F.col("kind")})
    turned = F.col("re_read") & F.coalesce("_turned", F.lit(False))
    second = second.withColumn("kind", F.when(turned, CONTINUATION).otherwise(F.col("kind"))).drop("_turned")
    tried = continue_runs(second, run, order, parts=parts)
    back = F.when(F.col("re_read") & ~F.col("attached"), F.col("_first")).otherwise(F.col("kind"))
    tried = tried.withColumn("kind", back).drop("_first", "run_no", "attached", "page_number")
    return continue_runs(tried, run, order, fields, extra, parts=parts)
