"""Anonymisation of text units: recognise, compose, merge, transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions import spans
from veilmark.functions.recognizers import recognize
from veilmark.operators.headings import fuzzy_heading_end
from veilmark.operators.rules import Rules, compose, heading_end, mask_after_heading

#: Labels, names and titles on boarding passes (fixed values).
PASSENGER_LABEL = r"(?iu:(?:passenger(?:\s+name)?|name\s+of\s+passenger|travell?er(?:\s+name)?|pax|фамилия\s+пассажира))\s*[:#.-]?\s*"
PASSENGER_PART = r"[A-Z][A-Za-z'’\-]{1,30}"
PASSENGER_TITLE = r"(?:MR|MRS|MS|MISS|MSTR|DR)"


def passenger_names(text: Column) -> Column:
    """Names on boarding passes: after a label, or SURNAME/GIVEN with a title."""
    part, title = PASSENGER_PART, PASSENGER_TITLE
    labelled = spans.find(text, rf"({PASSENGER_LABEL})({part}(?:\s*/\s*|\s+){part}(?:\s*{title})?)()", "PERSON", 0.92, group=2)
    slash = spans.find(text, rf"{part}\s*/\s*{part}\s*{title}\b", "PERSON", 0.92)
    fresh = F.filter(slash, lambda s: ~F.exists(labelled, lambda t: (t["start"] == s["start"]) & (t["end"] == s["end"])))
    return F.concat(labelled, fresh)


def precise_persons(text: Column, found: Column) -> Column:
    """Drops persons of an external recognizer with fewer than two name words."""
    return F.filter(
        found,
        lambda s: (s["entity_type"] != "PERSON")
        | (F.size(F.regexp_extract_all(F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit(r"(\p{L}[\p{L}'-]+)"), F.lit(1))) >= 2),
    )


def automatic_spans(text: Column, external: Column | None = None, kinds: list[str] | None = None) -> Column:
    """Merged spans of all recognizers and, where given, of an external one."""
    parts = [recognize(text, kinds)]
    if kinds is None:
        parts.append(passenger_names(text))
    if external is not None:
        parts.append(precise_persons(text, F.coalesce(external.cast(spans.SPANS), spans.no_spans())))
    return spans.merge(F.concat(*parts), F.length(text))


def anonymize_text(
    units: DataFrame, rules: Rules | None = None, text: str = "text", external: str | None = None, is_ocr: str | None = None,
    kinds: list[str] | None = None,
) -> DataFrame:
    """Adds ``entities`` (merged), ``masked`` and ``entity_count`` to text units.

    One narrow projection: nothing is shuffled.  A null text has no entities and a
    null result.  A heading that is found counts as an entity.
    """
    rules = rules or Rules()
    t = F.col(text)
    auto = automatic_spans(t, F.col(external) if external else None, kinds) if rules.effective_mode in ("automatic", "combined") else spans.no_spans()
    out = compose(units.withColumn("_automatic", auto), text, rules, "_automatic", "_chosen", is_ocr)
    # The mode "automatic" gives merged spans already.
    merged = F.col("_chosen") if rules.effective_mode == "automatic" else spans.merge(F.col("_chosen"), F.length(t))
    out = out.withColumn("entities", merged).drop("_automatic", "_chosen")
    changed = spans.transform_text(t, F.col("entities"))
    hit = F.lit(0)
    if rules.headings:
        end = heading_end(t, rules.headings)
        if rules.fuzzy_headings:
            out = out.withColumn("_heading_end", fuzzy_heading_end(t, rules.headings))
            end = F.col("_heading_end")
        hit = end.isNotNull().cast("int")
        changed = mask_after_heading(t, changed, rules.headings, end)
        done = out.withColumn("masked", changed).withColumn("entity_count", F.size("entities") + hit)
        return done.drop("_heading_end")
    return out.withColumn("masked", changed).withColumn("entity_count", F.size("entities") + hit)


def redact_later_pages(pages: DataFrame, file: str, page: str, hit: str, text: str = "masked") -> DataFrame:
    """Pages after one with a heading are masked whole.

    The first page with a hit is a minimum per file, joined back: no file's pages are
    gathered in a task.
    """
    first = pages.where(F.col(hit)).groupBy(file).agg(F.min(page).alias("first_hit"))
    later = F.coalesce(F.col(page) > F.col("first_hit"), F.lit(False))
    return (
        pages.join(first, file, "left").withColumn("fully_redacted", later)
        .withColumn(text, F.when(later, spans.mask(F.col(text))).otherwise(F.col(text))).drop("first_hit")
    )


def run_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of a run: files that succeeded and failed, and their entities."""
    failed = F.col("error").isNotNull()
    return results.groupBy(*(by or [])).agg(
        F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"),
        F.coalesce(F.sum(F.when(~failed, F.col("entity_count"))), F.lit(0)).alias("entities"),
    )
