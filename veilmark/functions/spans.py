"""Spans of text: finding, merging, subtracting, masking.

A span is a struct (start, end, entity_type, score, replacement) with 0-based
character offsets, the end excluded.  All functions are Column expressions; spans of a
text stay in an array beside it, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,entity_type:string,score:double,replacement:string>"
SPANS = f"array<{SPAN}>"
BLOCK = "█"
_MARK = "\x01"
#: Items that a fold takes together.
RUN = 64
_LAST = 2**31 - 1


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, kind: str | Column, score: float | Column, replacement: Column | str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), lit(kind).alias("entity_type"),
        lit(score).cast("double").alias("score"), lit(replacement).cast("string").alias("replacement"),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not wherever the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What a fold puts out: ``step(state, item)`` gives the next state and an array of outputs.

    A fold that appends to one array copies it each time, which takes the square of its
    length.  Here runs of ``RUN`` items are folded into an array each, so a step copies
    no more than a run's outputs, and the runs' arrays are joined at the end.
    """
    none = F.slice(step(start, F.element_at(items, 1))[1], 1, 0)

    def run(done: Column, k: Column) -> Column:
        part = F.slice(items, k * RUN + 1, F.lit(RUN))
        inner = F.aggregate(
            part,
            F.struct(F.element_at(done, -1)["state"].alias("state"), none.alias("out")),
            lambda acc, x: F.struct(step(acc["state"], x)[0].alias("state"), F.concat(acc["out"], step(acc["state"], x)[1]).alias("out")),
        )
        return F.concat(done, F.array(inner))

    runs = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int"))
    folded = F.aggregate(runs, F.array(F.struct(start.alias("state"), none.alias("out"))), run)
    return F.when(F.size(items) > 0, F.flatten(F.transform(folded, lambda r: r["out"]))).otherwise(none)


def find(text: Column, pattern: str, kind: str | Column, score: float, replacement: str | None = None, group: int = 0) -> Column:
    """Spans of all matches of a pattern (of a group of it, with nothing else marked).

    Matches are fenced with a control character, the text is split there, and
    lengths of the pieces before give offsets; the character itself is blanked in the
    text first, which keeps offsets.
    """
    clean = F.translate(text, _MARK, " ")
    if group == 0:
        fenced = F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}")
    else:  # groups 1..3 are before, the span, behind
        fenced = F.regexp_replace(clean, pattern, f"$1{_MARK}$2{_MARK}$3")
    sizes = F.transform(F.split(fenced, _MARK), lambda p, i: F.struct(F.length(p).alias("n"), (i % 2 == 1).alias("inside")))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        found = F.array(span(at, at + p["n"], kind, score, replacement)).cast(SPANS)
        return at + p["n"], F.when(p["inside"] & (p["n"] > 0), found).otherwise(no_spans())

    return F.when(text.rlike(pattern), let(sizes, lambda x: fold(x, F.lit(0), step))).otherwise(no_spans())


def ordered(spans: Column) -> Column:
    """Sorted by start and end; equal ones keep their order."""
    numbered = lambda x: F.transform(x, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i")))
    return let(spans, lambda x: F.transform(F.sort_array(numbered(x)), lambda k: F.element_at(x, k["i"] + 1)))


def merge(spans: Column, size: Column) -> Column:
    """Strictly overlapping spans become one; touching ones stay apart.

    Spans are clamped to the text and empty ones dropped.  A merged span has the
    type of the highest score, the earlier one on ties.  Its replacement survives
    only between identical spans, where the later one's wins if it has one.  One sweep over
    the sorted spans: what overlaps the open span joins it, any other closes it.
    """
    clamped = let(size, lambda n: F.transform(
        spans,
        lambda s: span(F.greatest(s["start"], F.lit(0)), F.least(s["end"], n), s["entity_type"], s["score"], s["replacement"]),
    ))
    solid = ordered(F.filter(clamped, lambda s: s["end"] > s["start"]))
    end = F.array(span(F.lit(_LAST), F.lit(_LAST), "", 0.0)).cast(SPANS)  # closes the last one

    def step(last: Column, s: Column) -> tuple[Column, Column]:
        same = (last["start"] == s["start"]) & (last["end"] == s["end"])
        first_wins = last["score"] >= s["score"]
        joined = span(
            last["start"], F.greatest(last["end"], s["end"]),
            F.when(first_wins, last["entity_type"]).otherwise(s["entity_type"]), F.greatest(last["score"], s["score"]),
            F.when(same, F.coalesce(s["replacement"], last["replacement"])),
        )
        meets = s["start"] < last["end"]
        closed = F.when(meets | (last["end"] == 0), no_spans()).otherwise(F.array(last).cast(SPANS))
        return F.when(meets, joined).otherwise(s).cast(SPAN), closed

    start = span(F.lit(0), F.lit(0), "", 0.0).cast(SPAN)
    return let(F.concat(solid, end), lambda x: fold(x, start, step))


def subtract(spans: Column, cuts: Column) -> Column:
    """The parts of ``spans`` outside all of ``cuts``; attributes stay.

    Spans that are sorted and don't overlap (merged ones) are cut in one sweep over all
    starts; others one by one.
    """
    apart = lambda x: F.forall(
        F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))),
        lambda i: F.coalesce(F.get(x, i - 1)["end"] <= F.get(x, i)["start"], F.lit(True)) & (F.get(x, i - 1)["end"] >= F.get(x, i - 1)["start"]),
    )
    return let(spans, lambda x: F.when((F.size(x) == 0) | (F.size(cuts) == 0), x.cast(SPANS)).when(apart(x), _sweep(x, cuts)).otherwise(_cut_each(x, cuts)))


def _sweep(spans: Column, cuts: Column) -> Column:
    item = lambda s, cut: F.struct(s["start"].alias("a"), F.lit(cut).alias("b"), s["end"].alias("end"), s.cast(SPAN).alias("s"))
    held = lambda at, s, cut: F.struct(at.alias("at"), s.alias("s"), cut.alias("cut"))
    solid = F.filter(cuts, lambda c: c["end"] > c["start"])
    items = F.sort_array(F.concat(F.transform(solid, lambda c: item(c, 0)), F.transform(spans, lambda s: item(s, 1))))
    end = F.array(item(span(F.lit(_LAST), F.lit(_LAST), "", 0.0), 1))
    part = lambda s, a, b: F.when(a < b, F.array(span(a, b, s["entity_type"], s["score"], s["replacement"])).cast(SPANS)).otherwise(no_spans())

    def step(now: Column, x: Column) -> tuple[Column, Column]:
        cut, s = x["b"] == 0, now["s"]
        upto = F.when(cut, F.least(x["a"], s["end"])).otherwise(s["end"])
        far = F.greatest(now["cut"], F.when(cut, x["end"]))  # nulls don't count
        begin = F.when(cut, F.greatest(now["at"], F.when(x["a"] < s["end"], x["end"]))).otherwise(F.greatest(x["a"], far))
        out = F.when(~cut | (x["a"] < s["end"]), part(s, now["at"], upto)).otherwise(no_spans())
        return held(begin, F.when(cut, s).otherwise(x["s"]).cast(SPAN), far), out

    first = F.lit(-_LAST)
    start = held(first, span(first, first, "", 0.0).cast(SPAN), first)
    return let(F.concat(items, end), lambda x: fold(x, start, step))


def _cut_each(spans: Column, cuts: Column) -> Column:
    def cut_all(s: Column) -> Column:
        near = F.filter(cuts, lambda c: (c["start"] < s["end"]) & (c["end"] > s["start"]))
        return F.when(F.size(near) == 0, F.array(s).cast(SPANS)).otherwise(_sweep(F.array(s).cast(SPANS), near))

    return F.flatten(F.transform(spans, cut_all)).cast(SPANS)


def mask(fragment: Column) -> Column:
    """Every character but white space becomes a block."""
    return F.regexp_replace(fragment, r"(?U)\S", BLOCK)


def transform_text(text: Column, spans: Column) -> Column:
    """The text with each (merged, sorted) span replaced or masked.

    Runs of spans get their part of the text first, so each span looks into a short
    string; the pieces are joined once.
    """
    piece = lambda x, a, b: F.substring(x, a + 1, b - a)

    def run(every: Column, k: Column) -> Column:
        ends = lambda i: F.coalesce(F.get(every, i)["end"], F.lit(0))
        base = F.when(k == 0, F.lit(0)).otherwise(ends(k * RUN - 1))
        part = F.slice(every, k * RUN + 1, F.lit(RUN))
        own = F.struct(base.alias("base"), part.alias("spans"), piece(text, base, F.element_at(part, -1)["end"]).alias("text"))

        def show(x: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                before = F.when(i == 0, x["base"]).otherwise(F.get(x["spans"], i - 1)["end"])
                kept = piece(x["text"], before - x["base"], s["start"] - x["base"])
                return F.concat(kept, F.coalesce(s["replacement"], mask(piece(x["text"], s["start"] - x["base"], s["end"] - x["base"]))))

            return F.array_join(F.transform(x["spans"], one), "")

        return let(own, show)

    def whole(every: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / RUN).cast("int"))
        changed = F.array_join(F.transform(runs, lambda k: run(every, k)), "")
        return F.concat(changed, F.substring(text, F.element_at(every, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(spans, whole)).otherwise(F.when(spans.isNotNull(), text))


def transform_runs(runs: Column, spans: Column) -> Column:
    """Runs of one paragraph with spans of their joined text applied.

    Masks stay in their run; a replacement goes to the first run it touches.
    """
    bounds = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r)).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), (acc["at"] + F.length(r)).alias("b")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )

    def one(run: Column, bound: Column) -> Column:
        inside = F.filter(spans, lambda s: (s["start"] < bound["b"]) & (s["end"] > bound["a"]))
        local = F.transform(
            inside,
            lambda s: span(
                F.greatest(s["start"] - bound["a"], F.lit(0)), F.least(s["end"], bound["b"]) - bound["a"], s["entity_type"], s["score"],
                F.when(s["replacement"].isNotNull(), F.when(s["start"] >= bound["a"], s["replacement"]).otherwise("")),
            ),
        )
        return transform_text(run, local)

    return F.zip_with(runs, bounds, one)


def texts(text: Column, spans: Column) -> Column:
    """The covered texts of spans."""
    return F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))


def has_entities(spans: Column) -> Column:
    return F.size(spans) > 0
