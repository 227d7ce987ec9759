"""Running values in the order of rows, without gathering a group in one task.

Rows are dealt over ranges of (keys, order).  A window in each range gives running values
within it; a summary row a range and key is combined over the ranges before (a
window over as many rows as a key has ranges), and what it carries in is joined back. A
key that holds all rows is worked on by all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.sources.shared import stash

PART = "_part"


def ranged(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows as a table in ranges of (keys, order), numbered by ``_part``.

    Rows with equal keys and order lie in one range.  ``parts``: their number; as
    many as a shuffle has, or fewer if these would be small, where it isn't given.
    """
    given = [] if parts is None else [parts]
    return stash(rows.repartitionByRange(*given, *keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def within(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, PART)


def earlier(keys: list[str]) -> Window:
    """The ranges of a key before one."""
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def bring(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Joins what is carried into a range to its rows; null keys equal each other.

    ``carried`` holds ranges that continue a key only, at most one a range, so it
    is small and Spark broadcasts it by its measured size.
    """
    other = carried.select(*[F.col(c).alias(f"_of{k}") for k, c in enumerate([*keys, PART])], *[c for c in carried.columns if c not in (*keys, PART)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{k}")) for k, c in enumerate([*keys, PART])])
    return rows.join(other, same, "left").drop(*[f"_of{k}" for k in range(len(keys) + 1)])


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows of the same keys up to each row.

    Null values count as 0.  Rows that tie in the order come in any order, but each
    counts once.  Columns named ``_part``, ``_value`` or ``_before`` are reserved.
    """
    held = ranged(rows.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))), keys, order, parts)
    upto = F.sum("_value").over(within(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = held.groupBy(*keys, PART).agg(F.sum("_value").alias("_value"))
    carried = sums.select(*keys, PART, F.sum("_value").over(earlier(keys)).alias("_before")).where("_before is not null")
    found = bring(held.withColumn(out, upto), carried, keys)
    return found.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_value", "_before", PART)
