"""Operators on the natural order of pages: continuations and what they inherit.

The order is total over a folder.  A folder may hold all pages there are, so its order is
scanned in ranges (see :mod:`veilmark.operators.scans`): what goes from range to range is the last
page that opens a run, with its place and the values that continuations take from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.operators import scans

PRIMARY, CONTINUATION, OTHER, ERROR = "primary", "continuation", "unrecognized", "error"
#: What a continuation takes from its primary page where its own value is missing (fixed values).
INHERITED = ["document_type", "status", "document_number", "document_date", "issuer_name", "issuer_inn", "issuer_kpp", "recipient_name", "recipient_inn", "recipient_kpp", "amount_without_tax", "tax_amount", "total_amount", "currency", "description", "document_datetime"]


def continue_runs(
    pages: DataFrame, run: list[str], order: list[str], fields: list[str] = (), extra: str | None = None, kind: str = "kind",
    parts: int | None = None,
) -> DataFrame:
    """Adds ``run_no``, ``page_number`` and ``attached``; attached pages inherit.

    Each page that is no continuation opens a new run; a run is open if a primary
    page heads it.  Its continuations are pages 2, 3, ...; one without an open run
    stays alone.  Attached continuations take missing ``fields`` (those that ``pages`` has)
    from their primary page.  Keys of the ``extra`` map: the primary's, then the page's
    own, which win even when null.  A null kind neither opens a run nor is attached.
    Pages that tie in the order come in any order; null folders are one folder.  No
    task gets a whole folder.  Columns that begin with ``_`` are reserved.
    """
    fields = [c for c in fields if c in pages.columns]
    held = scans.ranged(pages, run, order, parts)
    opens = F.coalesce(F.col(kind) != CONTINUATION, F.lit(False))
    upto = scans.within(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.struct(F.col("_place").alias("place"), F.col(kind).alias("kind"), *[F.col(c).alias(f"f{k}") for k, c in enumerate(fields)], *([F.col(extra).alias("extra")] if extra else []))
    local = held.withColumn("_place", F.row_number().over(upto).cast("long"))
    local = local.withColumns({"_opened": F.sum(opens.cast("long")).over(upto), "_head": F.last(F.when(opens, head), ignorenulls=True).over(upto)})
    ends = local.groupBy(*run, scans.PART).agg(F.max("_place").alias("rows"), F.max("_opened").alias("opened"), F.max_by("_head", "_place").alias("last"))
    before = scans.earlier(run)
    ends = ends.withColumn("_rows", F.sum("rows").over(before))
    moved = F.when(F.col("last").isNotNull(), F.col("last").withField("place", F.col("last.place") + F.coalesce("_rows", F.lit(0))))
    carried = ends.withColumn("last", moved).select(
        *run, scans.PART, "_rows", F.sum("opened").over(before).alias("_runs"), F.last("last", ignorenulls=True).over(before).alias("_carried")
    )
    found = scans.bring(local, carried.where("_rows is not null"), run)
    rows = F.coalesce("_rows", F.lit(0))
    own = F.when(F.col("_head").isNotNull(), F.col("_head").withField("place", F.col("_head.place") + rows))
    found = found.withColumns({"_head": F.coalesce(own, "_carried"), "_place": F.col("_place") + rows})
    attached = F.coalesce((F.col(kind) == CONTINUATION) & (F.col("_head.kind") == PRIMARY), F.lit(False))
    number = (F.col("_place") - F.col("_head.place") + 1).cast("int")
    changes: dict[str, Column] = {
        "run_no": F.coalesce("_opened", F.lit(0)) + F.coalesce("_runs", F.lit(0)), "attached": attached,
        "page_number": F.when(attached, number).when(F.col(kind) == PRIMARY, F.lit(1)),
    }
    for k, c in enumerate(fields):
        changes[c] = F.when(attached, F.coalesce(F.col(c), F.col(f"_head.f{k}"))).otherwise(F.col(c))
    if extra:
        none = F.create_map().cast(pages.schema[extra].dataType)
        mine = F.coalesce(F.col(extra), none)
        kept = F.map_filter(F.coalesce(F.col("_head.extra"), none), lambda k, v: ~F.map_contains_key(mine, k))
        changes[extra] = F.when(attached, F.map_concat(kept, mine)).otherwise(F.col(extra))
    return found.withColumns(changes).drop("_place", "_opened", "_head", "_rows", "_runs", "_carried", scans.PART)


def attach_continuations(pages: DataFrame, run: list[str], order: list[str], kind: str = "kind", parts: int | None = None) -> DataFrame:
    """:func:`continue_runs` without inheritance."""
    return continue_runs(pages, run, order, kind=kind, parts=parts)


def later_flag(pages: DataFrame, file: str, page: str, hit: str, name: str = "after_hit") -> DataFrame:
    """Whether an earlier page of the file had a hit."""
    w = Window.partitionBy(file).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn(name, F.coalesce(F.max(F.col(hit).cast("int")).over(w) == 1, F.lit(False)))
