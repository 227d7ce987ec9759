"""Names and places of outputs, planned as DataFrames before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.text import safe_filename
from veilmark.operators import scans
from veilmark.sources.shared import stash

#: Namespace of URLs in name-based identifiers (fixed value).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def task_id(rel_path: Column, content: Column) -> Column:
    """A name-based identifier (version 5) of a path and its content's hash."""
    return hashed_task_id(rel_path, F.sha2(content.cast("binary"), 256))


def hashed_task_id(rel_path: Column, content_hash: Column) -> Column:
    """:func:`task_id` where the SHA-256 of the content is known already."""
    name = F.concat_ws(":", rel_path, content_hash)
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


#: Words of file names where a value is missing (fixed values).
MISSING = {"number": "без_номера", "date": "без_даты", "amount": "без_суммы", "name": "без_фио"}


def generic_stem(kind: Column, number: Column, date: Column, page: Column) -> Column:
    """type_number_date of a copy, with a page suffix from the second page on."""
    given = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    base = F.concat_ws("_", given(kind, "document"), given(number, "without_number"), F.nullif(date, F.lit("")))
    return F.when(page > 1, F.concat(base, F.lit("_page_"), page.cast("string"))).otherwise(base)


def invoice_stem(number: Column, date: Column, page: Column) -> Column:
    """The name of an invoice's page: its number and date, then the page's number from the second on."""
    base = F.concat(F.lit("УПД_"), F.coalesce(F.nullif(number, F.lit("")), F.lit(MISSING["number"])))
    dated = F.when(F.coalesce(date, F.lit("")) != "", F.concat(base, F.lit("_от_"), date)).otherwise(base)
    return F.when(page > 1, F.concat(dated, F.lit("_"), page.cast("string"), F.lit("_страница"))).otherwise(dated)


def receipt_stem(date: Column, amount: Column, name: Column, number: Column) -> Column:
    """date_amount_name_number, each made a safe name; the name has no blanks or underscores."""
    given = lambda c, key: safe_filename(F.coalesce(F.nullif(c, F.lit("")), F.lit(MISSING[key])))
    return F.concat_ws("_", given(date, "date"), given(amount, "amount"), F.replace(given(name, "name"), F.lit("_"), F.lit("")), given(number, "number"))


def _split(name: Column) -> tuple[Column, Column]:
    return F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)


def _numbered(low: str) -> tuple[Column, Column]:
    """The name that a number was put on and the number, or nulls; ``low``: a column of names.

    Only what the numbering itself writes counts: ``_2``, ``_3``, ... before the suffix.
    """
    stem, suffix = _split(F.col(low))
    number = F.regexp_extract(stem, r"_([2-9]|[1-9][0-9]{1,8})$", 1)
    base = F.concat(F.regexp_replace(stem, r"_[0-9]+$", ""), suffix)
    return F.when(number != "", base), F.when(number != "", number.cast("long"))


def _skips(planted: DataFrame, requests: DataFrame, folder: str, parts: int | None) -> DataFrame:
    """Adds ``skip`` and ``displaced`` to planted names; a table.

    ``planted``: folder, low, base, k, at (first request), lost (the base's first request got no
    plain name); ``requests``: folder, low, rank, at.  The base's numbering comes to k with
    its (k - 1 - skipped numbers below)-th numbered request.  If that is later than the first
    request of the planted name itself, the number is taken and skipped; if it is earlier,
    the planted name's first request is displaced.  What is skipped below is a running sum; it is
    repeated until nothing changes, which settles the numbers in rising order.
    """
    turn = requests.select(F.col(folder).alias("_folder"), F.col("low").alias("_low"), F.col("rank").alias("_rank"), F.col("at").alias("_when"))
    now, mark = planted.withColumns({"skip": F.lit(False), "displaced": F.lit(False)}), None
    while True:
        below = scans.running_sum(now, [folder, "base"], ["k"], F.col("skip").cast("int"), "below", parts)
        place = F.col("k") - 1 - (F.col("below") - F.col("skip").cast("int")) + F.when(F.col("lost"), 0).otherwise(1)
        met = below.join(turn, F.col(folder).eqNullSafe(F.col("_folder")) & (F.col("base") == F.col("_low")) & (place == F.col("_rank")), "left")
        met = met.withColumns({"skip": F.coalesce(F.col("at") < F.col("_when"), F.lit(False)), "displaced": F.coalesce(F.col("at") > F.col("_when"), F.lit(False))})
        now = stash(met.select(*planted.columns, "skip", "displaced"), "planted")
        then = now.agg(F.count_if("skip"), F.sum(F.when(F.col("skip"), F.xxhash64(folder, "low")).cast("decimal(38,0)"))).first()
        if tuple(then) == mark:
            return now
        mark = tuple(then)


def number_collisions(files: DataFrame, folder: str, name: str, order: str, out: str = "destination", parts: int | None = None) -> DataFrame:
    """The first of a name keeps it, the next are ``_2``, ``_3``, ... until one is free.

    Names are given out in ``order`` (no ties), whatever their case.  A name's rank among its
    equals in a folder tells its number: the rank and how many numbers below were taken
    before, both by running sums over ranges of rows, so one name on all rows is worked on by
    all tasks.  Names that carry such a number themselves are settled level by level: those
    of ``a_2`` after ``a``, those of ``a_2_3`` after ``a_2``.  Null names stay null, null folders
    are one folder.  Columns that begin with ``_``, ``low``, ``rank`` and ``at`` are reserved.
    """
    every = files.withColumns({"low": F.lower(name), "at": F.col(order)})
    named, unnamed = every.where(F.col(name).isNotNull()), files.where(F.col(name).isNull())
    ranked = stash(scans.running_sum(named, [folder, "low"], [order], F.lit(1), "rank", parts), "ranked-names")
    first = ranked.where("rank = 1").select(folder, "low", "at")
    base, k = _numbered("low")
    child = first.withColumns({"base": base, "k": k}).where("base is not null")
    parent = first.select(F.col(folder).alias("_folder"), F.col("low").alias("_low"))
    same = lambda left: F.col(folder).eqNullSafe(F.col("_folder")) & (F.col(left) == F.col("_low"))
    planted = child.join(parent, same("base"), "left_semi")
    lost, skipped = None, None
    if not planted.isEmpty():
        planted, todo = stash(planted, "planted-names"), None
        todo = planted.withColumns({"lost": F.lit(False)})
        roots = todo.join(planted.select(F.col(folder).alias("_folder"), F.col("low").alias("_low")), same("base"), "left_anti")
        while not roots.isEmpty():  # a level of names, as deep as numbers follow each other
            done = _skips(roots, ranked, folder, parts)
            own = done.where("displaced").select(F.col(folder).alias("_folder"), F.col("low").alias("_low"))
            taken = done.where("skip").select(folder, "base", "k")
            lost, skipped = (own if lost is None else lost.union(own)), (taken if skipped is None else skipped.union(taken))
            level = done.select(F.col(folder).alias("_folder"), F.col("low").alias("_low"), F.col("displaced").alias("_lost"))
            roots = stash(planted.join(level, same("base")).select(*planted.columns, F.col("_lost").alias("lost")), "level")
    if lost is None:
        return ranked.withColumn(out, _with_number(F.col(name), F.col("rank"))).select(*files.columns, out).unionByName(_nulls(unnamed, out))
    found = ranked.join(lost.withColumn("_displaced", F.lit(True)), same("low"), "left").drop("_folder", "_low")
    found = found.withColumn("_turn", F.when(F.col("_displaced"), F.col("rank")).otherwise(F.col("rank") - 1))
    # The number of skipped numbers that come before the turn-th number given out: these
    # stand between the turns k - 1 - (skipped ones up to k) and the next.
    nth = scans.running_sum(skipped.withColumnRenamed("base", "low"), [folder, "low"], ["k"], F.lit(1), "_nth", parts)
    marks = nth.select(folder, "low", (F.col("k") - 1 - F.col("_nth")).alias("_turn"), F.lit(1).alias("_skip"))
    holds = marks.select(F.col(folder).alias("_folder"), F.col("low").alias("_low")).distinct()
    plain = found.join(holds, same("low"), "left_anti").withColumn("_number", F.col("_turn") + 1)
    gaps = found.join(holds, same("low"), "left_semi").withColumn("_skip", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    gaps = gaps.withColumn("_slot", F.col("_turn") * 2 + F.col("_skip"))
    gaps = scans.running_sum(gaps, [folder, "low"], ["_slot"], F.col("_skip"), "_over", parts).where("_skip = 0")
    gaps = gaps.withColumn("_number", F.col("_turn") + 1 + F.col("_over"))
    made = plain.select(*files.columns, "_turn", "_number").union(gaps.select(*files.columns, "_turn", "_number"))
    made = made.withColumn(out, F.when(F.col("_turn") == 0, F.col(name)).otherwise(_with_number(F.col(name), F.col("_number"))))
    return made.select(*files.columns, out).unionByName(_nulls(unnamed, out))


def _nulls(files: DataFrame, out: str) -> DataFrame:
    return files.withColumn(out, F.lit(None).cast("string"))


def _with_number(name: Column, number: Column) -> Column:
    stem, suffix = _split(name)
    return F.when(number > 1, F.concat(stem, F.lit("_"), number.cast("string"), suffix)).otherwise(name)


def docx_destinations(files: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Names of converted files; clashing ones carry the source's suffix."""
    stem, suffix = _split(F.col(name))
    plain = F.concat(stem, F.lit(".docx"))
    planned = files.withColumn("_plain", plain)
    many = F.count(F.lit(1)).over(Window.partitionBy(folder, F.lower("_plain"))) > 1
    marked = F.when(many, F.concat(stem, F.lit("__"), F.substring(suffix, 2, 20), F.lit(".docx"))).otherwise(F.col("_plain"))
    return number_collisions(planned.withColumn("_name", marked), folder, "_name", order).drop("_plain", "_name")


def mirrored(rel_path: Column, target: str) -> Column:
    """The folder under ``target`` that mirrors a file's own."""
    parent = F.regexp_extract(rel_path, r"^(.*)/[^/]*$", 1)
    return F.concat_ws("/", F.lit(target), F.nullif(parent, F.lit("")))


def contains_path(parent: Column | str, path: Column) -> Column:
    """Whether a path is the parent or below it."""
    p = F.rtrim(F.lit(parent) if isinstance(parent, str) else parent, F.lit("/"))
    return (path == p) | path.startswith(F.concat(p, F.lit("/")))


def dual_outputs(files: DataFrame) -> DataFrame:
    """Jobs of a file (its own format and DOCX) and whether all of them succeeded.

    Any failed job fails the file; its entities are the most that a job found.
    """
    return files.groupBy("rel_path").agg(
        F.bool_and(F.col("error").isNull()).alias("succeeded"), F.max("entity_count").alias("entity_count"), F.count(F.lit(1)).alias("jobs")
    )
