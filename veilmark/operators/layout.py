"""Recognised words on a page: text with offsets, lines, boxes, orientation.

Lines are found within a page, so words come as an array of each page (a row) where a
recogniser gives them so, and nothing is shuffled; words that are rows are gathered by page first.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.sources.shared import in_arrow


def map_box(left: Column, top: Column, width: Column, height: Column, angle: Column, page_w: Column, page_h: Column) -> Column:
    """A box on a page turned clockwise, on the page as it was (its own size)."""
    box = lambda a, b, c, d: F.struct(a.alias("left"), b.alias("top"), c.alias("width"), d.alias("height"))
    return (
        F.when(angle == 90, box(top, page_h - left - width, height, width))
        .when(angle == 180, box(page_w - left - width, page_h - top - height, width, height))
        .when(angle == 270, box(page_w - top - height, left, height, width))
        .otherwise(box(left, top, width, height))
    )


def words_with_offsets(words: DataFrame, page: list[str]) -> DataFrame:
    """Words with text and confidence, joined by single spaces: start and end of each."""
    fit = words.where((F.trim("text") != "") & (F.col("conf") >= 0)).withColumn("text", F.trim("text"))
    before = F.sum(F.length("text") + 1).over(Window.partitionBy(*page).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    placed = fit.withColumn("start", F.coalesce(before, F.lit(0)).cast("int"))
    return placed.withColumn("end", F.col("start") + F.length("text"))


def in_pages(words: DataFrame, page: list[str], fields: list[str]) -> DataFrame:
    """Pages with their ``words``, an array of ``fields``; pages that are given so stay in their place."""
    if "words" in words.columns:
        return words.select(*page, F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in fields])).alias("words"))
    return words.groupBy(*page).agg(F.collect_list(F.struct(*fields)).alias("words"))


def lines_by_ids(words: DataFrame, page: list[str]) -> DataFrame:
    """Lines by the recogniser's block, paragraph and line, from the top and left.

    ``words``: rows, or pages with an array of that name; rows: page, block, par, line, top, left, right, text, line_no.
    """
    ids = ["block", "par", "line"]
    pages = in_pages(words, page, ["idx", "text", "left", "top", "width", *ids])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for x in (pages.schema, pages.schema["words"].dataType.elementType) for f in x if f.name in [*page, *ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page_no, flat = _flat(b.column(len(page)))
            if not len(page_no):
                continue
            idx, left, top, width = (flat[k].to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
            own = [pc.rank(x, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) for x in flat[5:]]
            place = np.lexsort((idx, left, *own[::-1], page_no))
            at = _begins(page_no[place], *(x[place] for x in own))
            least = lambda x: np.minimum.reduceat(x[place], at)
            box = [least(top), least(left), np.maximum.reduceat((left + width)[place], at)]
            again = np.lexsort((*(x[place][at] for x in own[::-1]), box[1], box[0], page_no[place][at]))
            of, named = page_no[place][at][again], pa.array(place[at][again])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(pa.array(of)) for k in range(len(page))), *(x.take(named) for x in flat[5:]), *(pa.array(x[again].astype(np.int32)) for x in box),
                 _joined(flat[1], place, at).take(pa.array(again)), pa.array(_numbers(of))],
                [*page, *ids, "top", "left", "right", "text", "line_no"],
            )

    return in_arrow(pages.select(*page, "words"), run, f"{kinds}, top int, left int, right int, text string, line_no int")


def _flat(words: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """The page of each word in a batch, and the fields of all words."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(words)), sizes), words.flatten().flatten()


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def _numbers(of: np.ndarray) -> np.ndarray:
    """Numbers from 1 within runs."""
    first = _begins(of)
    return (np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) + 1).astype(np.int32)


def _joined(text: pa.Array, place: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts of words in order, joined by blanks in runs that begin ``at``; nulls are left out."""
    kept = text.is_valid().to_numpy(zero_copy_only=False)[place]
    ends = np.append(0, np.cumsum(np.add.reduceat(kept.astype(np.int64), at)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), text.take(pa.array(place[kept]))), " ")


def line_keys(page_no: np.ndarray, centre: np.ndarray, height: np.ndarray, factor: float, floor: float, made: Callable[[float, float], MeanLines | MedianLines]) -> np.ndarray:
    """The first word of each word's line; words come in the order in which a page's pass takes them.

    Between centres that are farther apart than any tolerance of the page nothing is decided, so
    the words on either side are passes of their own.  Those that lie within the least tolerance are one line in
    any pass; only others take a pass word by word.
    """
    n = len(centre)
    key = np.arange(n)
    if not n:
        return key
    turns = page_no[1:] != page_no[:-1]
    begins = _begins(page_no)
    sizes = np.diff(np.append(begins, n))
    most = np.repeat(np.maximum(floor, np.maximum.reduceat(height, begins) * factor), sizes) * (1 + 1e-9) + 1e-9
    least = np.repeat(np.maximum(floor, np.minimum.reduceat(height, begins) * factor), sizes) * (1 - 1e-9)
    by = np.lexsort((centre, page_no))
    sorted_centre = centre[by]
    new = np.append(True, turns | (np.diff(sorted_centre) > most[1:]))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    key[by] = np.minimum.reduceat(by, starts)[np.cumsum(new) - 1]
    for g in np.flatnonzero(sorted_centre[ends - 1] - sorted_centre[starts] > least[starts]).tolist():
        own = np.sort(by[starts[g] : ends[g]])
        lines = made(factor, floor)
        for k, a, h in zip(own.tolist(), centre[own].tolist(), height[own].tolist(), strict=True):
            lines.add(k, a, h)
        for words in lines.words:
            key[words] = words[0]
    return key


def _by_place(words: DataFrame, page: list[str], factor: float, floor: float, made: Callable[[float, float], MeanLines | MedianLines]) -> DataFrame:
    """Rows (page, line_no, left, top, right, bottom, text): lines of ``made``, numbered as they are begun."""
    pages = in_pages(words, page, ["idx", "text", "left", "top", "width", "height"])
    if made is MedianLines:
        pages = pages.withColumn("words", F.filter("words", lambda w: F.trim(w["text"]) != ""))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page_no, flat = _flat(b.column(len(page)))
            if not len(page_no):
                continue
            idx, left, top, width, height = (flat[k].to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4, 5))
            order = np.lexsort((idx, left, top, page_no))  # the pages stay in their order
            key = line_keys(page_no, (top + height / 2)[order], height[order].astype(float), factor, floor, made)
            within = np.lexsort((np.arange(len(key)), idx[order], left[order], key))
            place, key = order[within], key[within]
            at = _begins(key)
            low, high = (lambda x: np.minimum.reduceat(x[place], at)), (lambda x: np.maximum.reduceat(x[place], at))
            text = _joined(flat[1], place, at)
            of = page_no[place][at]
            box = [low(left), low(top), high(left + width), high(top + height)]
            if made is MedianLines:  # from the top and left, else in the order of their first words
                again = np.lexsort((np.arange(len(of)), box[0], box[1], of))
                text, box, of = text.take(pa.array(again)), [x[again] for x in box], of[again]
            columns = [pa.array(x.astype(np.int32)) for x in (_numbers(of), *box)]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(of)) for k in range(len(page))), *columns, text], [*page, "line_no", "left", "top", "right", "bottom", "text"])

    return in_arrow(pages.select(*page, "words"), run, f"{kinds}, line_no int, left int, top int, right int, bottom int, text string")


class MeanLines:
    """Lines whose place is the mean centre of their words."""

    def __init__(self, factor: float, floor: float) -> None:
        self.factor, self.floor, self.widest = factor, floor, 0.0
        self.words: list[list[int]] = []
        self.total: list[float] = []
        self.room: list[float] = []
        self.centre: list[float] = []
        self.placed: list[tuple[float, int]] = []

    def _near(self, centre: float, reach: float) -> int:
        """The last line that is near, or -1; only those around the place are looked at."""
        if self.words and abs(self.centre[-1] - centre) <= max(reach, self.room[-1]):
            return len(self.words) - 1
        far = max(reach, self.widest) * (1 + 1e-9) + 1e-9
        some = self.placed[bisect_left(self.placed, (centre - far, -1)) : bisect_right(self.placed, (centre + far, len(self.words)))]
        return max((k for at, k in some if abs(at - centre) <= max(reach, self.room[k])), default=-1)

    def add(self, word: int, centre: float, height: float) -> None:
        k = self._near(centre, max(self.floor, height * self.factor))
        if k < 0:
            k = len(self.words)
            self.words.append([])
            self.total.append(0.0)
            self.room.append(0.0)
            self.centre.append(centre)
            self.placed.insert(bisect_left(self.placed, (centre, k)), (centre, k))
        self.words[k].append(word)
        self.total[k] += centre
        self.room[k] = max(self.room[k], height * self.factor)
        self.widest = max(self.widest, self.room[k])
        _move(self.placed, self.centre, k, self.total[k] / len(self.words[k]))


def _move(placed: list[tuple[float, int]], centre: list[float], k: int, to: float) -> None:
    """Puts line ``k`` into its new place."""
    if to != centre[k]:
        del placed[bisect_left(placed, (centre[k], k))]
        insort(placed, (to, k))
        centre[k] = to


def lines_by_geometry(words: DataFrame, page: list[str], factor: float = 0.65, floor: float = 6.0) -> DataFrame:
    """Lines by position: a word joins the last line whose mean centre is near.

    ``words``: rows, or pages with an array of that name.  The greedy pass depends on its own
    results, so each page runs in one task.
    """
    return _by_place(words, page, factor, floor, MeanLines).select(*page, "line_no", "text")


def upright(words: DataFrame) -> DataFrame:
    """Boxes in the upright layout where a provider gives these (``layout_left`` and so on), else as they are."""
    sides = ("left", "top", "width", "height")
    if "words" in words.columns:
        own = words.schema["words"].dataType.elementType.names
        at = lambda w, c: F.coalesce(w[f"layout_{c}"], w[c]) if c in sides and f"layout_{c}" in own else w[c]
        return words.withColumn("words", F.transform("words", lambda w: F.struct(*[at(w, c).alias(c) for c in own])))
    names = [c for c in sides if f"layout_{c}" in words.columns]
    return words.withColumns({c: F.coalesce(f"layout_{c}", c) for c in names})


class MedianLines:
    """Lines whose place is the median centre of their words; each keeps its values sorted."""

    def __init__(self, factor: float, floor: float) -> None:
        self.factor, self.floor, self.widest = factor, floor, 0.0
        self.words: list[list[int]] = []
        self.sorted: list[tuple[list[float], list[float]]] = []
        self.centre: list[float] = []
        self.room: list[float] = []
        self.placed: list[tuple[float, int]] = []

    def _near(self, centre: float, reach: float) -> int:
        """The nearest line within its tolerance, the first of equals, or -1; lines are tried from the place outwards."""
        far, placed, room = max(reach, self.widest), self.placed, self.room
        best, found = far, -1
        begin = bisect_left(placed, (centre, -1))
        for way in (range(begin, len(placed)), range(begin - 1, -1, -1)):
            for j in way:
                at, k = placed[j]
                d = abs(at - centre)
                if d > best:
                    break
                if d <= max(reach, room[k]) and (d < best or found < 0 or k < found):
                    best, found = d, k
        return found

    def add(self, word: int, centre: float, height: float) -> None:
        """Puts a word into the nearest line within its tolerance, the first of equals, or a new one."""
        k = self._near(centre, max(self.floor, height * self.factor))
        if k < 0:
            k = len(self.words)
            self.words.append([])
            self.sorted.append(([], []))
            self.room.append(0.0)
            self.centre.append(centre)
            insort(self.placed, (centre, k))
        self.words[k].append(word)
        for held, value in zip(self.sorted[k], (centre, height), strict=True):
            insort(held, value)
        middle = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
        self.room[k] = middle(self.sorted[k][1]) * self.factor
        self.widest = max(self.widest, self.room[k])
        _move(self.placed, self.centre, k, middle(self.sorted[k][0]))


def lines_by_medians(words: DataFrame, page: list[str], factor: float = 0.65, floor: float = 5.0) -> DataFrame:
    """Lines by position for text that is laid out anew: a word joins the nearest line by its median centre.

    Words (idx, text, left, top, width, height; page numbers must not be null; rows, or pages with
    an array ``words``) come from the top and left; blank ones are left out.  Rows: page, line_no
    (from the top and left), left, top, right, bottom, text.  The pass depends on its own results,
    so a page runs in one task.
    """
    return _by_place(words, page, factor, floor, MedianLines)


def entity_boxes(words: DataFrame, entities: DataFrame, page: list[str], padding: int = 3) -> DataFrame:
    """A padded box around the words that an entity overlaps, within the page.

    ``words``: start, end, box, page_w, page_h; ``entities``: page, start, end, entity_type.
    """
    e = entities.select(*page, F.col("start").alias("e_start"), F.col("end").alias("e_end"), "entity_type")
    hit = words.join(e, page).where((F.col("start") < F.col("e_end")) & (F.col("end") > F.col("e_start")))
    return hit.groupBy(*page, "e_start", "e_end", "entity_type").agg(
        F.greatest(F.min("left") - padding, F.lit(0)).alias("left"), F.greatest(F.min("top") - padding, F.lit(0)).alias("top"),
        F.least(F.max(F.col("left") + F.col("width")) + padding, F.max("page_w")).alias("right"),
        F.least(F.max(F.col("top") + F.col("height")) + padding, F.max("page_h")).alias("bottom"),
    )


def mask_words(words: DataFrame, entities: DataFrame, page: list[str]) -> DataFrame:
    """Words with their parts in entities masked; a replacement stands in the first word."""
    from veilmark.functions import spans

    spanned = entities.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity_type", "score", "replacement"))).cast(spans.SPANS).alias("_e"))
    x = words.join(spanned, page, "left")
    inside = F.filter(F.coalesce("_e", spans.no_spans()), lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    local = F.transform(
        inside,
        lambda s: spans.span(
            F.greatest(s["start"] - F.col("start"), F.lit(0)), F.least(s["end"], F.col("end")) - F.col("start"), s["entity_type"], s["score"],
            F.when(s["replacement"].isNotNull(), F.when(s["start"] >= F.col("start"), s["replacement"]).otherwise("")),
        ),
    )
    return x.withColumn("masked", spans.transform_text(F.col("text"), local)).drop("_e")


def best_orientation(readings: DataFrame, page: list[str]) -> DataFrame:
    """The reading of a page by heading, entities, sure words, length, confidence.

    Angles are tried in the order 0, 90, 270, 180; the first wins ties.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in (0, 90, 270, 180)]), F.col("angle"))
    keys = ["heading_found", "entity_count", "sure_words", "text_length", "conf_sum"]
    best = F.row_number().over(Window.partitionBy(*page).orderBy(*[F.desc(k) for k in keys], rank))
    return readings.where("error is null").withColumn("_b", best).where("_b = 1").drop("_b")


def best_text(variants: DataFrame, by: list[str]) -> DataFrame:
    """The first variant with all markers, else the longest with 75 points a marker."""
    full = F.col("marker_hits") == F.col("marker_total")
    score = F.col("text_length") + 75 * F.col("marker_hits")
    best = F.row_number().over(Window.partitionBy(*by).orderBy(full.cast("int").desc(), F.when(full, F.col("variant")).asc_nulls_last(), score.desc(), "variant"))
    return variants.withColumns({"_b": best, "confidence": F.least(F.lit(100.0), score / 20)}).where("_b = 1").drop("_b")


def mean_confidence(words: DataFrame, page: list[str]) -> DataFrame:
    return words.groupBy(*page).agg(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("mean_conf"))


def stacked_names(lines: DataFrame, page: list[str], label: str = r"(?iu)passenger name|пассажир", gap: float = 60.0, left: float = 40.0) -> DataFrame:
    """Values of a name label on one of the next two lines, near enough below it."""
    a = lines.where(F.col("text").rlike(label)).select(*page, F.col("line_no").alias("l"), F.col("top").alias("lt"), F.col("left").alias("ll"))
    title = r"(?iu)^(?:mr|mrs|ms|miss|mstr)$"
    words = F.filter(F.split("text", r"[ /]+"), lambda w: (w != "") & ~w.rlike(title))
    below = lines.join(a, page).where(
        F.col("line_no").between(F.col("l") + 1, F.col("l") + 2) & ((F.col("top") - F.col("lt")) <= gap)
        & (F.abs(F.col("left") - F.col("ll")) <= left) & (F.size(words) >= 2) & ~F.col("text").rlike("[0-9]")
    )
    first = F.row_number().over(Window.partitionBy(*page, "l").orderBy("line_no"))
    return below.withColumn("_f", first).where("_f = 1").select(*page, "line_no", "text", F.lit(0.99).alias("score"))


def page_geometry(width: Column, height: Column, dpi: Column, angle: Column) -> Column:
    """Page size in points: from the resolution if plausible, else from A4's long side."""
    turned = angle.isin(90, 270)
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    clamp = lambda x: F.least(F.greatest(x, F.lit(288.0)), F.lit(1584.0))
    ratio = F.least(F.greatest(w / h, F.lit(0.2)), F.lit(5.0))
    long_side = F.lit(841.89)
    return F.when(dpi.between(50, 1200), F.struct(clamp(w * 72 / dpi).alias("w"), clamp(h * 72 / dpi).alias("h"))).otherwise(
        F.struct(F.when(ratio >= 1, long_side).otherwise(long_side * ratio).alias("w"), F.when(ratio >= 1, long_side / ratio).otherwise(long_side).alias("h"))
    )


def line_metrics(words: DataFrame, page: list[str], scale: Column) -> DataFrame:
    """Per line: indent, font size, spaces by the median width of a character."""
    by = [*page, "block", "par", "line"]
    char = F.col("width") / F.length("text")
    m = words.groupBy(*by).agg(
        F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.percentile("height", F.lit(0.5)).alias("height"), F.percentile(char, F.lit(0.5)).alias("char_width"),
    )
    gap = F.col("top") - F.lag("bottom").over(Window.partitionBy(*page).orderBy("top", "left", "block", "par", "line"))
    return m.withColumns(
        {
            "indent": F.col("left") * scale, "font": F.least(F.greatest(F.col("height") * scale * 0.82, F.lit(6.0)), F.lit(28.0)),
            "gap": F.least(F.greatest(F.coalesce(gap, F.lit(0)) * scale, F.lit(0.0)), F.lit(72.0)),
        }
    )


def page_turn(angle: Column) -> Column:
    """Whether a page's sides swap."""
    return angle.isin(90, 270)
