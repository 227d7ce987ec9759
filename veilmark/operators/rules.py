"""Configured rules: literals to mask, keep or replace, exactly or with errors.

Rules are a small list given by a person, so they are literals of the plan.
"""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import spans
from veilmark.functions.text import look_alike, token

MODES = ("automatic", "configured", "combined", "disabled")
#: Section and keys of a settings file (fixed values).
SECTION = "anonymization"
KEYS = ["entityDetectionMode", "excluded", "included", "includedAndReplaced", "includedParagraphs", "includedFuzzy", "includedFuzzyMaxErrors"]
MAX_ERRORS = 3
#: Scores of configured spans, above those of recognizers (fixed values).
MASK_SCORE, REPLACE_SCORE = 1.0, 1.1
#: Shorter targets are matched exactly only (fixed value).
FUZZY_LENGTH = 5


@dataclass(frozen=True)
class Rules:
    """What a run masks (``included``), keeps (``excluded``) and replaces."""

    mode: str | None = None
    excluded: tuple[str, ...] = ()
    included: tuple[str, ...] = ()
    replacements: tuple[tuple[str, str], ...] = ()
    headings: tuple[str, ...] = field(default=())
    fuzzy: bool = False
    max_errors: int = 1
    #: Headings also in spite of reading errors; runs Python on every text.
    fuzzy_headings: bool = False

    def __post_init__(self) -> None:
        if self.mode is not None and self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if not 0 <= self.max_errors <= MAX_ERRORS:
            raise ValueError(f"errors must be 0 to {MAX_ERRORS}")

    @property
    def effective_mode(self) -> str:
        return self.mode or ("configured" if self.included or self.replacements else "automatic")


def parse_list(raw: str) -> tuple[str, ...]:
    """Items between commas or line ends, the first of each spelling kept."""
    seen: dict[str, str] = {}
    for item in re.split(r"[,\n]", raw):
        if item.strip():
            seen.setdefault(item.strip().casefold(), item.strip())
    return tuple(seen.values())


def parse_replacements(raw: str) -> tuple[tuple[str, str], ...]:
    """Lines ``source -> target``; contradictions and half lines are errors."""
    found: dict[str, tuple[str, str]] = {}
    for line in filter(None, map(str.strip, raw.splitlines())):
        source, arrow, target = map(str.strip, line.partition("->"))
        if not (source and arrow and target):
            raise ValueError(f"not a replacement: {line!r}")
        before = found.setdefault(source.casefold(), (source, target))
        if before[1] != target:
            raise ValueError(f"{source!r} has two replacements")
    return tuple(found.values())


def parse_rules(text: str) -> Rules:
    """Rules from the text of a settings file; unknown sections and keys fail."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string(text.removeprefix("﻿"))
    if parser.sections() != [SECTION]:
        raise ValueError(f"one section [{SECTION}] is needed")
    own = parser[SECTION]
    if extra := set(own) - {k.lower() for k in KEYS}:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    return Rules(
        mode=own.get("entitydetectionmode", "").strip().lower() or None,
        excluded=parse_list(own.get("excluded", "")),
        included=parse_list(own.get("included", "")),
        replacements=parse_replacements(own.get("includedandreplaced", "")),
        headings=parse_list(own.get("includedparagraphs", "")),
        fuzzy=own.getboolean("includedfuzzy", fallback=False),
        max_errors=own.getint("includedfuzzymaxerrors", fallback=1),
    )


def literal_pattern(source: str) -> str:
    """Case-insensitive, any white space between words, no word boundaries."""
    words = [re.sub(r"([^\w\s])", r"\\\1", w) for w in source.split()]
    return "(?iuU)" + r"\s+".join(words)


def literal_spans(text: Column, source: str, kind: str, score: float, replacement: str | None = None) -> Column:
    return spans.find(text, literal_pattern(source), kind, score, replacement)


def token_spans(text: Column) -> Column:
    """Words of letters and digits as spans, in order."""
    return spans.find(text, r"[\p{L}\p{N}]+", "TOKEN", 0.0)


def fuzzy_spans(text: Column, source: str, errors: int, kind: str, score: float, replacement: str | None = None) -> Column:
    """Exact matches, and windows of as many words within ``errors`` edits.

    Words are folded (case, look-alike letters) and joined before they are compared;
    an edit distance that exceeds the bound is cut short.
    """
    exact = literal_spans(text, source, kind, score, replacement)
    words = re.findall(r"[^\W_]+", source)
    target = "".join(words)
    if errors == 0 or len(target) < FUZZY_LENGTH or not words:
        return exact
    n = len(words)
    folded = look_alike(F.lit(target))

    def windows(all_tokens: Column) -> Column:
        starts = F.when(F.size(all_tokens) >= n, F.sequence(F.lit(1), F.size(all_tokens) - n + 1)).otherwise(F.array().cast("array<int>"))

        def near(i: Column) -> Column:
            part = F.slice(all_tokens, i, F.lit(n))
            joined = look_alike(F.array_join(spans.texts(text, part), ""))
            return F.struct(i.alias("i"), F.levenshtein(joined, folded, errors).alias("d"))

        hits = F.filter(F.transform(starts, near), lambda w: w["d"] >= 0)
        return F.transform(
            hits,
            lambda w: spans.span(
                F.element_at(all_tokens, w["i"])["start"], F.element_at(all_tokens, w["i"] + n - 1)["end"],
                f"{kind}_FUZZY", score, replacement,
            ),
        )

    fuzzy = F.filter(
        windows(token_spans(text)), lambda f: ~F.exists(exact, lambda e: (e["start"] == f["start"]) & (e["end"] == f["end"]))
    )
    return F.concat(exact, fuzzy)


def _concat(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts) if parts else spans.no_spans()


def configured_spans(text: Column, rules: Rules, is_ocr: Column | None = None) -> Column:
    """Spans of the rules; a mask of exactly a replacement's span gives way."""

    def found(source: str, kind: str, score: float, replacement: str | None = None) -> Column:
        exact = literal_spans(text, source, kind, score, replacement)
        if not rules.fuzzy or is_ocr is None:
            return exact
        return F.when(is_ocr, fuzzy_spans(text, source, rules.max_errors, kind, score, replacement)).otherwise(exact)

    replaced = _concat([found(s, "CONFIGURED_REPLACEMENT", REPLACE_SCORE, t) for s, t in rules.replacements])
    masked = _concat([found(s, "CONFIGURED", MASK_SCORE) for s in rules.included])
    left = F.filter(masked, lambda m: ~F.exists(replaced, lambda r: (r["start"] == m["start"]) & (r["end"] == m["end"])))
    return spans.ordered(F.concat(replaced, left))


def compose(units: DataFrame, text: str, rules: Rules, automatic: str, out: str, is_ocr: str | None = None) -> DataFrame:
    """Adds ``out``, the sorted spans of a mode; ``automatic`` names the recognised ones.

    Combined: what is recognised, less excluded and configured parts, and the
    configured spans.  Exclusions match exactly and never cancel configured spans.  The steps
    are columns of their own, which Spark analyses one after the other.
    """
    mode, t = rules.effective_mode, F.col(text)
    if mode == "disabled":
        return units.withColumn(out, spans.no_spans())
    if mode == "automatic":
        return units.withColumn(out, F.col(automatic))
    found = units.withColumn("_configured", configured_spans(t, rules, F.col(is_ocr) if is_ocr else None))
    if mode == "configured":
        return found.withColumnRenamed("_configured", out)
    kept = found.withColumn("_kept", _concat([literal_spans(t, s, "EXCLUDED", 0.0) for s in rules.excluded]))
    left = kept.withColumn("_left", spans.subtract(F.col(automatic), F.col("_kept")))
    left = left.withColumn("_left", spans.subtract(F.col("_left"), F.col("_configured")))
    return left.withColumn(out, spans.ordered(F.concat("_left", "_configured"))).drop("_configured", "_kept", "_left")


def heading_pattern(heading: str) -> str | None:
    """The heading's words as whole words, whatever stands between them."""
    words = re.findall(r"[^\W_]+", heading.lower().replace("ё", "е"))
    body = r"[^\p{L}\p{N}]+".join(w.replace("е", "[её]") for w in words)
    return rf"(?iu)(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])" if words else None


def heading_end(text: Column, headings: tuple[str, ...]) -> Column:
    """End of the earliest heading found as whole words (the longer of two), or null."""
    hits = []
    for p in filter(None, map(heading_pattern, headings)):
        start = F.regexp_instr(text, F.lit(p)) - 1
        end = start + F.length(F.regexp_extract(text, p, 0))
        # ends are negative, so that the longer of two with one start sorts first
        hits.append(F.when(start >= 0, F.struct(start.alias("a"), (-end).alias("b"))))
    return -F.array_min(F.array_compact(F.array(*hits)))["b"] if hits else F.lit(None).cast("int")


def mask_after_heading(text: Column, changed: Column, headings: tuple[str, ...], end: Column | None = None) -> Column:
    """Everything behind a heading masked in the changed text.

    The heading is looked for in the original (or its ``end`` there is given); the cut
    is where it stands in the changed text, or else where it stood.
    """
    end = heading_end(text, headings) if end is None else end
    cut = F.coalesce(heading_end(changed, headings), F.least(F.length(changed), end))
    masked = F.concat(F.substring(changed, 1, cut), spans.mask(F.substring(changed, cut + 1, F.length(changed))))
    return F.when(end.isNotNull(), masked).otherwise(changed)
