"""Mixing sources to target weights, with built-in functions only.

A budget of tokens goes down a tree of domain, language and source by weight.  A
child can take no more than its documents give in ``epochs`` passes; what it can't
take goes to its siblings by their weights, and only what they can't take either is
missing at the parent, whose own siblings take it.  At each level that is a filling to a
common level: children fall short in order of capacity over weight, so a running sum
in that order finds the level without iteration.

A leaf takes whole passes over its documents while its budget lasts, and then the
token-prefix of one more pass.  A pass orders documents by a hash of the seed, its
number and the document.  Sums by leaf and hash range find the range where the budget
ends, and only the documents of that range are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.llm.shared import stash, table

LEVELS = ["domain", "language", "source"]
SEED = "mix-1"
#: Hex digits of the hash that make a range: 16 ** RANGE_DIGITS ranges a leaf.
RANGE_DIGITS = 3
#: Weights by level; what isn't named has weight 1.
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0},
    "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
}


def count_words(text: Column) -> Column:
    """Words between ASCII blanks, the tokens of a budget; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``share``: each child's part of its parent's ``budget``.

    Columns: the parent's keys, ``name``, weight, capacity, budget.
    """
    order = Window.partitionBy(*parent).orderBy(
        F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))), name
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / (
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    steps = children.withColumn("level", F.when(F.col("weight") > 0, level))
    open_ = (F.col("weight") > 0) & (F.col("capacity") > F.col("level") * F.col("weight"))
    steps = steps.withColumn("line", F.max(F.when(open_, F.col("level"))).over(whole))
    # without a line every child falls short (least and greatest would skip the null)
    held = F.least(F.col("capacity"), F.greatest(F.col("line"), F.lit(0.0)) * F.col("weight"))
    share = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("line").isNull(), F.col("capacity")).otherwise(held)
    return steps.withColumn("share", share).drop("level", "line")


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: float, weights: dict[str, dict[str, float]], levels: list[str]) -> DataFrame:
    """Adds ``budget`` (whole tokens) to ``leaves`` (levels..., tokens).

    Parents fill their children from the top; every child's capacity is the
    sum of the leaves below, so a shortage meets siblings before ancestors.
    """
    nodes = leaves.withColumn("capacity", F.col("tokens") * F.lit(float(epochs)))
    filled = None
    for depth, name in enumerate(levels):
        parent = levels[:depth]
        here = nodes.groupBy(*parent, name).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(name, weights))
        if filled is None:
            here = here.withColumn("budget", budget)
        else:
            here = here.join(filled, parent)
        filled = _fill(here, parent, name).select(*parent, name, F.col("share").alias("budget"))
    return leaves.join(filled, levels).withColumn("budget", F.floor("budget").cast("long"))


def mix(
    docs: DataFrame, levels: list[str], share: float, epochs: int = 1, weights: dict[str, dict[str, float]] | None = None,
    seed: str = SEED,
) -> DataFrame:
    """Selects from ``docs`` (doc_id, levels..., tokens) ``share`` of all tokens.

    Rows: doc_id, levels, epoch, tokens and taken, the tokens of the document that
    lie within the prefix (all but for the last of a leaf).  A document that
    is taken in several passes has several rows.  Null levels are a group named
    "null".  Documents without tokens are never taken.  Rows that repeat a doc_id
    are documents of their own.  ``docs`` is read several times: give a table.
    """
    named = [F.coalesce(F.col(c), F.lit("null")).alias(c) for c in levels]
    used = docs.select("doc_id", *named, "tokens").where("tokens > 0")
    leaves = stash(used.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    limits = stash(
        leaf_budgets(leaves, F.lit(float(int(total * share))), epochs, weights or {}, levels).select(
            *levels,
            F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("passes"),
            (F.col("budget") % F.col("tokens")).alias("rest"),
        ),
        "leaf-limits",
    )
    ranked = used.join(limits, levels).withColumn(
        "draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("passes"), F.col("doc_id")).cast("binary"))
    ).withColumn("range", F.substring("draw", 1, RANGE_DIGITS))
    sums = ranked.groupBy(*levels, "range").agg(F.sum("tokens").alias("held"))
    place = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("before", F.coalesce(F.sum("held").over(place), F.lit(0)))
    ended = limits.where("rest > 0").join(ranges, levels).where("before < rest")
    last = ended.where("before + held >= rest").select(*levels, F.col("range").alias("edge"), "before")
    # One row a leaf: the range where its budget ends (none: nothing of a further pass).
    edges = stash(limits.join(last, levels, "left"), "leaf-edges")
    placed = ranked.drop("passes", "rest").join(edges, levels)
    columns = ["doc_id", *levels, "epoch", "tokens", "taken"]
    whole = placed.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    whole = whole.withColumn("taken", F.col("tokens"))
    inside = placed.where("edge is not null and range < edge").withColumns({"epoch": F.col("passes"), "taken": F.col("tokens")})
    upto = Window.partitionBy(*levels, "range").orderBy("draw", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("tokens").over(upto), F.lit(0))
    crossing = placed.where("range = edge").withColumn("at", at).where("at < rest").withColumns(
        {"epoch": F.col("passes"), "taken": F.least(F.col("tokens"), F.col("rest") - F.col("at"))}
    )
    return whole.select(*columns).union(inside.select(*columns)).union(crossing.select(*columns))


def document_tree(docs: DataFrame) -> DataFrame:
    number = F.coalesce(F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0))
    return docs.select(
        "doc_id", F.concat(F.lit("d"), (number % 4).cast("int").cast("string")).alias("domain"),
        F.col("lang").alias("language"), "source", count_words(F.col("text")).alias("tokens"),
    )


#: The query takes so much of all words, in so many passes.
SHARE, EPOCHS = 0.7, 2


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are the sources' numbers modulo 4."""
    tree = stash(document_tree(table(spark, sf_dir, "documents")), "mix-documents")
    return mix(tree, LEVELS, SHARE, EPOCHS, WEIGHTS)


def _fill_sql(parent: list[str], name: str, weights: dict[str, float]) -> str:
    keys = ", ".join([*parent, name])
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    cases = "".join(f" WHEN '{k}' THEN {v}" for k, v in sorted(weights.items()))
    weight = f"CASE {name}{cases} ELSE 1.0 END" if cases else "1.0"
    source = f"JOIN f_{parent[-1]} USING ({', '.join(parent)})" if parent else "CROSS JOIN total"
    return f"""
n_{name} AS (
  SELECT {keys}, sum(capacity) AS capacity, CAST({weight} AS DOUBLE) AS weight FROM caps GROUP BY {keys}
), l_{name} AS (
  SELECT n.*, budget, (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM n_{name} n {source} WINDOW w AS ({part} ORDER BY capacity / weight, {name})
), t_{name} AS (
  SELECT *, max(level) FILTER (capacity > level * weight) OVER ({part}) AS line FROM l_{name}
), f_{name} AS (
  SELECT {keys}, CASE WHEN line IS NULL THEN capacity ELSE least(capacity, greatest(line, 0) * weight) END AS budget FROM t_{name}
)"""


OP8_SQL = rf"""
WITH docs AS (
  SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 4) AS domain,
    coalesce(lang, 'null') AS language, coalesce(source, 'null') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')), 0) AS BIGINT) AS tokens
  FROM documents
), used AS (SELECT * FROM docs WHERE tokens > 0
), leaves AS (SELECT domain, language, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM used GROUP BY ALL
), caps AS (SELECT *, CAST(tokens AS DOUBLE) * {float(EPOCHS)} AS capacity FROM leaves
), total AS (SELECT CAST(floor(sum(tokens) * CAST({SHARE} AS DOUBLE)) AS DOUBLE) AS budget FROM leaves
),{",".join(_fill_sql(LEVELS[:k], x, WEIGHTS.get(x, {})) for k, x in enumerate(LEVELS))}
, limits AS (
  SELECT domain, language, source, CAST(floor(floor(budget) / tokens) AS INTEGER) AS passes,
    CAST(floor(budget) AS BIGINT) % tokens AS rest
  FROM leaves JOIN f_source USING (domain, language, source)
), drawn AS (
  SELECT u.*, passes, rest, coalesce(sum(tokens) OVER (PARTITION BY domain, language, source
    ORDER BY md5('{SEED}:' || passes || ':' || doc_id), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM used u JOIN limits USING (domain, language, source)
)
SELECT doc_id, domain, language, source, CAST(e AS INTEGER) AS epoch, tokens, tokens AS taken
FROM (SELECT *, unnest(range(passes)) AS e FROM drawn)
UNION ALL
SELECT doc_id, domain, language, source, passes, tokens, CAST(least(tokens, rest - place) AS BIGINT) FROM drawn WHERE place < rest
"""
