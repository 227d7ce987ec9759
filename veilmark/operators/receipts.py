"""Receipts of the self-employed: taxpayer numbers, names, totals, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import spans
from veilmark.functions.dates import padded_date
from veilmark.functions.money import two_decimals
from veilmark.functions.text import line_whitespace, preview, receipt_number

#: Words that no name holds (fixed values).
NO_NAME_WORDS = ["федеральная", "налоговая", "служба", "российская", "федерации", "налог", "профессиональный", "доход", "чек", "покупатель", "заказчик", "организация", "исполнитель", "самозанятый", "налогоплательщик", "продавец", "поставщик", "услуга", "услуги", "итого", "сумма", "инн", "дата", "номер", "мой"]
#: Marks of an organisation (fixed values).
ORGANISATION = ["ооо", "ао ", "пао", "зао", "общество", "компания", "организация", "заказчик", "покупатель"]
#: Words that are no receipt number (fixed values).
NO_NUMBERS = ["нпд", "налог", "доход"]
#: Points of a name by its lines, and of a receipt by its marks (fixed values).
NAME_POINTS = {"three": 140, "two": 45, "one_two": 150, "two_one": 120, "second_block": 35, "same_block": 140, "before": 20, "label": 45}
RECEIPT_POINTS = {"receipt": 35, "tax_phrase": 45, "tax_short": 35, "app": 30, "self_employed": 25, "inn": 35, "inn_12": 20, "total": 10, "date": 10}
RECOGNISED_AT = 80
#: Warnings (fixed values).
SHORT_INN = "The first INN was selected as the receipt issuer, but it is not 12 digits"
NO_NAME = "The receipt was recognized, but the self-employed issuer name was not extracted"
NO_INN = "The receipt was recognized, but the self-employed issuer INN was not extracted"
NO_NUMBER = "The receipt was recognized, but no value following an explicit receipt-number label was found"
_DATE = r"(?<![0-9])([0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4})(?![0-9])"
_MONEY = r"(?<![0-9])([0-9]{1,3}(?:[ \x{a0}][0-9]{3})*[.,][0-9]{2}|[0-9]+[.,][0-9]{2})(?![0-9])"
#: Labels before a name (fixed values).
_NAME_LABEL = r"(?iu)^(?:фио|ф\.\s*и\.\s*о\.|налогоплательщик|самозанятый|исполнитель|продавец|поставщик)\s*[:：-]?\s*"
_NAME = r"^[А-ЯЁA-Z][А-ЯЁа-яёA-Za-z'’\-]{1,39}$"


def inn_candidates(text: Column) -> Column:
    """Distinct numbers of 10 or 12 digits with their places, in order."""
    found = spans.find(text, r"(?<![0-9])[0-9](?:[ \t\-]?[0-9]){9,11}(?![0-9])", "INN", 1.0)
    bare = F.transform(
        found,
        lambda s: F.struct(
            F.regexp_replace(F.substring(text, s["start"] + 1, s["end"] - s["start"]), "[^0-9]", "").alias("value"),
            s["start"].alias("start"), s["end"].alias("end"),
        ),
    )
    fit = F.filter(bare, lambda c: F.length(c["value"]).isin(10, 12))
    return spans.let(fit, lambda x: F.filter(x, lambda c, i: ~F.exists(F.slice(x, F.lit(1), i), lambda d: d["value"] == c["value"])))


def name_words(line: Column) -> Column:
    """The words of a line if all of them could be a person's, else none."""
    bare = F.regexp_replace(line, r"^[\s:;|—–-]+|[\s:;|—–-]+$", "")
    bare = F.regexp_replace(bare, _NAME_LABEL, "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[()\[\]{}<>]", " "), " +", " "))
    return spans.let(bare, _name_words)


def _name_words(bare: Column) -> Column:
    return spans.let(F.struct(bare.alias("bare"), F.split(bare, " ").alias("words"), F.lower(bare).alias("low")), lambda x: _all_names(x["bare"], x["words"], x["low"]))


def _all_names(bare: Column, words: Column, low: Column) -> Column:
    organised = F.lit(False)
    for m in ORGANISATION:
        organised = organised | low.contains(m)
    stopped = F.exists(words, lambda w: F.regexp_replace(F.lower(w), r"^[.'’\-]+|[.'’\-]+$", "").isin(*NO_NAME_WORDS))
    good = (bare != "") & ~bare.rlike("[0-9]") & F.forall(words, lambda w: w.rlike(_NAME)) & ~stopped & ~organised
    return F.when(good, words).otherwise(F.array().cast("array<string>"))


def issuer_name(text: Column, inns: Column | None = None) -> Column:
    """The best name: by layout, by nearness to the first INN, by its block.

    ``inns``: :func:`inn_candidates` where a column holds them already.
    """
    return spans.let(inn_candidates(text) if inns is None else inns, lambda x: spans.let(_lines(text), lambda w: _issuer(text, F.get(x, 0), w)))


def _lines(text: Column) -> Column:
    """(at, block, words) of the lines that aren't blank."""
    lines = F.aggregate(
        F.split(text, "\n"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("block"), F.lit(True).alias("gap"), F.array().cast("array<struct<at:int,block:int,line:string>>").alias("out")),
        lambda acc, ln: F.struct(
            (acc["at"] + F.length(ln) + 1).alias("at"),
            F.when((F.trim(ln) == "") & ~acc["gap"], acc["block"] + 1).otherwise(acc["block"]).alias("block"),
            (F.trim(ln) == "").alias("gap"),
            F.when(F.trim(ln) == "", acc["out"]).otherwise(
                F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), acc["block"].alias("block"), F.trim(ln).alias("line"))))
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.transform(lines, lambda x: F.struct(x["at"].alias("at"), x["block"].alias("block"), name_words(x["line"]).alias("words")))


def _issuer(text: Column, first: Column, worded: Column) -> Column:
    last = F.aggregate(worded, F.lit(-1), lambda acc, w: F.when(w["at"] <= first["start"], w["block"]).otherwise(acc))
    return spans.let(last, lambda block: _best_name(text, first, worded, block))


def _best_name(text: Column, first: Column, worded: Column, nearest_block: Column) -> Column:
    item = "struct<score:int,at:int,value:string>"

    def named(points: Column, at: Column, block: Column, value: Column) -> Column:
        around = F.substring(text, F.greatest(at - 80, F.lit(0)) + 1, F.length(value) + 160)
        bonus = F.when(block == 1, NAME_POINTS["second_block"]).otherwise(0)
        bonus = bonus + F.when(first.isNotNull() & (block == nearest_block), NAME_POINTS["same_block"]).otherwise(0)
        bonus = bonus + F.when(first.isNotNull(), 100 - F.least(F.abs(at - first["start"]), F.lit(100))).otherwise(0)
        bonus = bonus + F.when(first.isNotNull() & (at <= first["start"]), NAME_POINTS["before"]).otherwise(0)
        bonus = bonus + F.when(around.rlike(r"(?iuU)\b(?:ФИО|самозанятый|исполнитель|налогоплательщик)\b"), NAME_POINTS["label"]).otherwise(0)
        return F.struct((points + bonus).cast("int").alias("score"), (-at).cast("int").alias("at"), value.alias("value")).cast(item)

    single = F.transform(
        F.filter(worded, lambda w: F.size(w["words"]).isin(2, 3)),
        lambda w: named(F.when(F.size(w["words"]) == 3, NAME_POINTS["three"]).otherwise(NAME_POINTS["two"]), w["at"], w["block"], F.array_join(w["words"], " ")),
    )
    joined = F.filter(
        F.transform(
            worded,
            lambda w, i: F.when(
                (F.size(F.get(worded, i + 1)["words"]) + F.size(w["words"]) == 3) & (F.size(w["words"]) > 0)
                & (F.size(F.get(worded, i + 1)["words"]) > 0) & (F.get(worded, i + 1)["block"] == w["block"]),
                named(
                    F.when(F.size(w["words"]) == 1, NAME_POINTS["one_two"]).otherwise(NAME_POINTS["two_one"]), w["at"], w["block"],
                    F.array_join(F.concat(w["words"], F.get(worded, i + 1)["words"]), " "),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return F.array_max(F.concat(single, joined))["value"]


def recipient_name(text: Column, inns: Column | None = None) -> Column:
    """An organisation in one of the eight lines nearest to the second INN."""
    return spans.let(F.get(inn_candidates(text) if inns is None else inns, 1), lambda second: _recipient(text, second))


def _recipient(text: Column, second: Column) -> Column:
    placed = F.aggregate(
        F.split(text, "\n"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<far:int,i:int,line:string>>").alias("out")),
        lambda acc, ln: F.struct(
            (acc["at"] + F.length(ln) + 1).alias("at"),
            F.concat(acc["out"], F.array(F.struct(F.abs(acc["at"] - second["start"]).alias("far"), F.size(acc["out"]).alias("i"), F.trim(ln).alias("line")))).alias("out"),
        ),
        lambda acc: F.slice(F.array_sort(acc["out"]), 1, 8),
    )
    clean = F.transform(placed, lambda p: F.regexp_replace(F.regexp_replace(p["line"], r"(?U)\s+", " "), r"^[ :;|—–-]+|[ :;|—–-]+$", ""))
    pattern = "|".join(m.replace(" ", r"\s") for m in ORGANISATION)
    marked = F.filter(clean, lambda c: F.lower(c).rlike(pattern))
    bare = F.transform(marked, lambda c: F.regexp_replace(c, r"(?iu)^(?:покупатель|заказчик|организация)\s*[:：-]?\s*", ""))
    fit = F.filter(bare, lambda c: (c != "") & ~c.rlike(r"(?iu)^(?:ИНН)?\s*[0-9][0-9\s-]+$"))
    return F.when(second.isNotNull(), F.substring(F.get(fit, 0), 1, 160))


def flat(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def _given(c: Column) -> Column:
    return spans.let(c, lambda x: F.when(x != "", x))


def number(text: Column) -> Column:
    return spans.let(flat(text), _number)


def _number(x: Column) -> Column:
    value = r"([A-ZА-ЯЁ0-9][A-ZА-ЯЁ0-9\-/ ]{2,80})"
    labels = [r"\bчек\s*(?:№|N(?:o)?\.?)[\s:：-]*", r"(?:\bномер\s+чека|№\s*чека)\s*[:：-]?\s*", r"\bквитанц(?:ия|ии)\s*(?:№|N(?:o)?\.?)[\s:：-]*"]
    stop = r"(?iuU)\s+(?:от|дата|инн|покупатель|заказчик|сумма|итого|наименование)\b.*$"
    return F.coalesce(*[receipt_number(F.regexp_replace(F.regexp_extract(x, rf"(?iuU){lab}{value}", 1), stop, ""), NO_NUMBERS) for lab in labels])


def date(text: Column) -> Column:
    return spans.let(flat(text), _date)


def _date(x: Column) -> Column:
    patterns = [rf"(?iu)(?:дата|дата\s+чека|чек[^\n]{{0,80}}?от)\s*[:：-]?\s*{_DATE}", rf"(?iu){_DATE}\s*(?:г\.?|в\s+[0-9]{{1,2}}[:.][0-9]{{2}})", _DATE]
    return padded_date(F.coalesce(*[_given(F.regexp_extract(x, p, 1)) for p in patterns]))


def total(text: Column) -> Column:
    """The last labelled amount, else the last with a currency, else the last."""
    return spans.let(flat(text), _total)


def _total(x: Column) -> Column:
    patterns = [rf"(?iu)(?:итого|всего|сумма\s+чека|к\s+оплате)\s*[:：-]?\s*{_MONEY}", rf"(?iuU){_MONEY}\s*(?:₽|руб\.?|RUB)\b", _MONEY]
    return two_decimals(F.coalesce(*[F.try_element_at(F.regexp_extract_all(x, F.lit(p), F.lit(1)), F.lit(-1)) for p in patterns]))


def service(text: Column) -> Column:
    """What follows a service label on its line or on up to three next ones."""
    label = r"(?iu)(?:наименование\s+(?:предмета\s+расч[её]та|услуги)|описание\s+услуги|предмет\s+расч[её]та|услуга)\s*[:：-]?\s*(.*)$"
    # Words that end a description (fixed values).
    stop = r"(?iuU)^(?:количество|цена|стоимость|сумма|итого|всего|инн|покупатель|заказчик|дата|чек)\b"

    def at_line(lines: Column, line: Column, i: Column) -> Column:
        own = F.regexp_replace(F.regexp_extract(line, label, 1), r"^[ :;|—–-]+|[ :;|—–-]+$", "")
        nexts = F.slice(lines, i + 2, F.lit(3))
        taken = F.aggregate(
            nexts, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("out")),
            lambda acc, n: F.struct(
                (acc["on"] & (n != "") & ~n.rlike(stop)).alias("on"),
                F.when(acc["on"] & (n != "") & ~n.rlike(stop), F.concat(acc["out"], F.array(n))).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: F.nullif(F.array_join(acc["out"], " "), F.lit("")),
        )
        return F.when(line.rlike(label), spans.let(own, lambda o: F.when((o != "") & ~o.rlike(stop), o).otherwise(taken)))

    every = F.transform(F.split(text, "\n"), lambda x: F.trim(flat(x)))
    found = spans.let(every, lambda lines: F.filter(F.transform(lines, lambda line, i: at_line(lines, line, i)), lambda v: v.isNotNull()))
    return F.substring(F.get(found, 0), 1, 300)


def score(text: Column, inns: Column | None = None) -> Column:
    found = inn_candidates(text) if inns is None else inns
    return spans.let(flat(text), lambda x: spans.let(found, lambda n: _score(F.lower(x), n, _total(x), _date(x))))


def _score(low: Column, inns: Column, amount: Column, day: Column) -> Column:
    return spans.let(low, lambda x: _points(x, inns, amount, day))


def _points(x: Column, inns: Column, amount: Column, day: Column) -> Column:
    p = RECEIPT_POINTS
    marks = [
        (x.rlike(r"(?U)\bчек\b"), "receipt"), (x.contains("налог на профессиональный доход"), "tax_phrase"), (x.rlike(r"(?U)\bнпд\b"), "tax_short"),
        (x.contains("мой налог"), "app"), (x.contains("самозан") | x.contains("налогоплательщик"), "self_employed"), (F.size(inns) > 0, "inn"),
        (F.length(F.get(inns, 0)["value"]) == 12, "inn_12"), (amount.isNotNull(), "total"), (day.isNotNull(), "date"),
    ]
    out = F.lit(0)
    for test, name in marks:
        out = out + F.when(test, p[name]).otherwise(0)
    return out


def extract_receipts(pages: DataFrame) -> DataFrame:
    """Pages (rel_path, text, header_text, targeted_text, rotation) to receipt rows."""
    t = line_whitespace(F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in ("header_text", "targeted_text", "text")]))
    x = pages.withColumn("all", t).withColumns({"inns": inn_candidates(F.col("all")), "line": flat(F.col("all"))})
    a, inns, line = F.col("all"), F.col("inns"), F.col("line")
    x = x.withColumns({"document_date": _date(line), "total_amount": _total(line)})  # the score asks for them too
    x = x.withColumns(
        {
            "score": _score(F.lower(line), inns, F.col("total_amount"), F.col("document_date")), "document_number": _number(line), "issuer_name": issuer_name(a, inns),
            "issuer_inn": F.get(inns, 0)["value"], "recipient_name": recipient_name(a, inns),
            "recipient_inn": F.get(inns, 1)["value"], "description": service(a),
        }
    )
    ok = F.col("score") >= RECOGNISED_AT
    lacks = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    warnings = F.array_compact(
        F.array(
            F.when(F.length("issuer_inn") != 12, SHORT_INN), F.when(ok & lacks("issuer_name"), NO_NAME),
            F.when(ok & lacks("issuer_inn"), NO_INN), F.when(ok & lacks("document_number"), NO_NUMBER),
        )
    )
    return x.select(
        "rel_path", ok.alias("is_recognized"), "document_number", "document_date", "issuer_name", "issuer_inn", "recipient_name", "recipient_inn",
        "total_amount", F.lit("RUB").alias("currency"), "description", F.least("score", F.lit(100)).alias("confidence"), "rotation",
        preview("all").alias("text_preview"), warnings.alias("warnings"),
    )
