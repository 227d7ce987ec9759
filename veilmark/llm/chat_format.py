"""Preference formatting of pairs of conversations, with built-in functions only.

A chosen and a rejected conversation share their first turns.  The longest common
prefix of turns (equal role and text) is rendered once, as the prompt; what follows
on either side is a completion.  Of a completion only the words of the assistant
count for training, and a mask gives their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.shared import table

OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"
TRAINED_ROLE = "assistant"


def _escaped(turns: Column) -> Column:
    """Roles and texts in which no marker opens: between ``<`` and ``|`` stands one backslash more.

    Taking one away gives the text back.
    """
    safe = lambda c: F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")
    return F.transform(turns, lambda t: F.struct(safe(t["role"]).alias("role"), safe(t["text"]).alias("text"), t["role"].alias("said_by")))


def _rendered(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), ""
    )


def _mask(turns: Column, role: str) -> Column:
    """Spans [start, stop) of the trained words and their end mark, in characters."""
    span = "struct<start:int,stop:int>"
    head = lambda t: F.length(t["role"]) + F.lit(len(OPEN) + len(CLOSE))
    body = lambda t: F.length(t["text"]) + F.lit(len(END))
    return F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + head(t) + body(t)).alias("at"),
            F.when(
                t["said_by"] == role,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + head(t)).alias("start"),
                            (acc["at"] + head(t) + body(t)).alias("stop"),
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def format_preferences(
    turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text",
    trained_role: str = TRAINED_ROLE,
) -> DataFrame:
    """Rows (pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask).

    ``pair`` names the pair of a turn, ``chosen`` (boolean) its side.  Turns are
    ordered by ``turn``, then role and text; a repeated row is a turn of its
    own.  A null role or text counts as empty, a null turn comes first; rows with a
    null pair are no conversation and are left out, a null side is rejected.  With
    one side missing the prompt is empty and that side null.  If one conversation
    continues the other, the shorter side's completion is empty.  Other columns are
    ignored.  A turn can't forge another: ``<|`` in a role or text is written ``<\\|``, and
    any backslashes that stand there become one more.  One shuffle, by pair; a pair's turns meet in one row, as the result is
    one row a pair.
    """
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    side = F.coalesce(chosen, F.lit(False))
    sides = turns.select(pair.alias("pair_id"), side.alias("side"), one.alias("t")).where("pair_id is not null")
    both = sides.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("r"),
    )
    shorter = F.least(F.size("c"), F.size("r"))
    differs = F.filter(
        F.sequence(F.lit(1), shorter),
        lambda i: (F.element_at("c", i)["role"] != F.element_at("r", i)["role"])
        | (F.element_at("c", i)["text"] != F.element_at("r", i)["text"]),
    )
    common = F.when(shorter == 0, F.lit(0)).otherwise(F.coalesce(F.get(differs, 0) - 1, shorter))
    cut = both.withColumn("prompt_turns", common)

    def tail(a: str) -> Column:
        return F.when(F.size(a) > 0, F.slice(a, F.col("prompt_turns") + 1, F.size(a)))

    prompt = F.slice("c", F.lit(1), F.col("prompt_turns"))
    cut = cut.select("pair_id", "prompt_turns", *[_escaped(t).alias(n) for n, t in (("p", prompt), ("c", tail("c")), ("r", tail("r")))])
    return cut.select(
        "pair_id", "prompt_turns", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"), _mask(F.col("c"), trained_role).alias("chosen_mask"),
        _mask(F.col("r"), trained_role).alias("rejected_mask"),
    )


def _spans_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair; masks as text."""
    turns = table(spark, sf_dir, "conversations")
    made = format_preferences(turns, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 0)
    return made.withColumns({c: _spans_text(c) for c in ("chosen_mask", "rejected_mask")})


OP2_SQL = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY 1
), d AS (
  SELECT c.pair_id, min(c.pos) AS pos FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.pos = r.pos
  WHERE c.side = 0 AND r.side = 1 AND (c.role <> r.role OR c.text <> r.text) GROUP BY 1
), p AS (
  SELECT n.*, CAST(coalesce(d.pos - 1, least(nc, nr)) AS INTEGER) AS prompt_turns FROM n LEFT JOIN d USING (pair_id)
), x AS (
  SELECT t.*, p.prompt_turns, '<|' || safe_role || '|>' || chr(10) || safe_text || '<|end|>' || chr(10) AS shown,
    length(safe_role) + 5 AS head
  FROM (SELECT *, regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS safe_role,
    regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS safe_text FROM t) t JOIN p USING (pair_id)
), y AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM x WHERE pos > prompt_turns
), z AS (
  SELECT pair_id,
    string_agg(shown, '' ORDER BY pos) FILTER (side = 0) AS chosen,
    string_agg(shown, '' ORDER BY pos) FILTER (side = 1) AS rejected,
    string_agg(CAST(place + head AS BIGINT) || '-' || CAST(place + length(shown) AS BIGINT), ',' ORDER BY pos)
      FILTER (side = 0 AND role = 'assistant') AS chosen_mask,
    string_agg(CAST(place + head AS BIGINT) || '-' || CAST(place + length(shown) AS BIGINT), ',' ORDER BY pos)
      FILTER (side = 1 AND role = 'assistant') AS rejected_mask
  FROM y GROUP BY 1
), q AS (
  SELECT pair_id, string_agg(shown, '' ORDER BY pos) AS prompt FROM x WHERE side = 0 AND pos <= prompt_turns GROUP BY 1
)
SELECT p.pair_id, prompt_turns, coalesce(prompt, '') AS prompt,
  CASE WHEN nc > 0 THEN coalesce(chosen, '') END AS chosen, CASE WHEN nr > 0 THEN coalesce(rejected, '') END AS rejected,
  CASE WHEN nc > 0 THEN coalesce(chosen_mask, '') END AS chosen_mask,
  CASE WHEN nr > 0 THEN coalesce(rejected_mask, '') END AS rejected_mask
FROM p LEFT JOIN z USING (pair_id) LEFT JOIN q USING (pair_id)
"""
