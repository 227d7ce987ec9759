"""Scanned transfer documents: classification, identity, parties, amounts.

One row per page with the recognised text; every field is a Column expression over
it, so a corpus of pages is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.dates import invoice_date, mixed_text_date, strict_date, template_date
from veilmark.functions.money import last_three_amounts
from veilmark.functions.spans import let
from veilmark.functions.text import digits, preview

#: Markers of a continuation page and their weights (fixed values).
CONTINUATION = {
    "наименование экономического субъекта": 35, "составителя документа": 35, "ответственный за правильность": 30,
    "оформления факта хозяйственной жизни": 25, "м.п": 15, "подпись": 10, "должность": 10, "траст": 15, "эталон": 15,
}
CONTINUATION_SCORE = 60
#: Points of the confidence (fixed values).
POINTS = {"recognized": 35, "number": 25, "date": 15, "seller": 10, "buyer": 10, "total": 5}
#: Ends of a number of five digits that are likely read from its neighbours (fixed values).
SUSPICIOUS_ENDS = ["01", "07", "10", "20", "23"]
_INVOICE = r"сч[её]т\s*[-–]?\s*фактур"
_STATUS_ONE = r"1\s*[-–]\s*сч[её]т\s*[-–]?\s*фактура\s*и\s*передаточ"
_SIGN = r"(?:№|N|No)?"
_WORD_DATE = r"[0-9]{1,2}\s+[а-яё]+\s+[0-9]{4}\s*г?\.?"
_DOT_DATE = r"[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4}"


def flat(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def compact(c: Column) -> Column:
    return F.lower(flat(c))


def _given(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def weighted_score(text: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the markers that a text holds."""
    out = F.lit(0)
    for marker, weight in weights.items():
        out = out + F.when(F.contains(text, F.lit(marker)), weight).otherwise(0)
    return out


def continuation_score(text: Column) -> Column:
    return let(compact(text), _continuation)


def _continuation(x: Column) -> Column:
    return F.when(x.rlike(_INVOICE) | x.contains("универсальн"), 0).otherwise(weighted_score(x, CONTINUATION))


def classify(text: Column, status: Column, number: Column, date: Column, shipment_row: Column) -> Column:
    """struct(recognized, continuation, inferred) of a page."""
    return let(compact(text), lambda x: _classify(x, _continuation(x), status, number, date, shipment_row))


def _classify(x: Column, points: Column, status: Column, number: Column, date: Column, shipment_row: Column) -> Column:
    one = F.coalesce(status == "1", F.lit(False))
    marks = F.struct(x.rlike(_INVOICE).alias("invoice"), (x.contains("передаточ") | x.contains("универсальн")).alias("transfer"))

    def decide(m: Column) -> Column:
        direct = m["invoice"] & m["transfer"] & (one | x.rlike(_STATUS_ONE))
        known = number.isNotNull() & date.isNotNull()
        return F.struct(direct.alias("direct"), (known & m["invoice"] & (m["transfer"] | (one & shipment_row))).alias("likely"))

    def show(k: Column) -> Column:
        return F.struct(
            (k["direct"] | k["likely"]).alias("recognized"), (~k["direct"] & (points >= CONTINUATION_SCORE)).alias("continuation"),
            (~k["direct"] & k["likely"]).alias("inferred"),
        )

    return let(let(marks, decide), show)


def confidence(text: Column, recognized: Column, continuation: Column, number: Column, date: Column, seller: Column, buyer: Column, total: Column) -> Column:
    return let(continuation_score(text), lambda x: _confidence(x, recognized, continuation, number, date, seller, buyer, total))


def _confidence(continued: Column, recognized: Column, continuation: Column, number: Column, date: Column, seller: Column, buyer: Column, total: Column) -> Column:
    given = {"number": number, "date": date, "seller": seller, "buyer": buyer, "total": total}
    points = F.when(recognized, POINTS["recognized"]).otherwise(0)
    for name, c in given.items():
        points = points + F.when(F.coalesce(c, F.lit("")) != "", POINTS[name]).otherwise(0)
    lifted = lambda p: F.when(continuation, F.greatest(p, F.least(F.lit(90), continued))).otherwise(p)
    return let(points, lambda p: F.least(lifted(p), F.lit(100)))


def trim_suspicious(n: Column) -> Column:
    return F.when((F.length(n) == 5) & F.substring(n, 4, 2).isin(*SUSPICIOUS_ENDS), F.substring(n, 1, 3)).otherwise(n)


def reconcile_number(current: Column, fallback: Column) -> Column:
    """struct(value, reason): the more reliable of two readings of a number.

    A reading that is the beginning of the other was not spoilt by neighbouring
    digits; very short ones lose; known bad ends are cut.
    """
    read = F.struct(digits(current).alias("a"), digits(fallback).alias("b"))
    return let(read, lambda n: let(trim_suspicious(n["a"]), lambda cut: _reconcile(n["a"], n["b"], cut)))


def _reconcile(a: Column, b: Column, cut: Column) -> Column:
    pick = lambda v, reason: F.struct(v.cast("string").alias("value"), F.lit(reason).cast("string").alias("reason"))
    longer = lambda x, y: x.startswith(y) & (F.length(x) > F.length(y)) & (F.length(y) >= 3)
    return (
        F.when(a.isNull() & b.isNull(), pick(a, None))
        .when(a.isNull(), pick(b, "document_number_from_fallback"))
        .when(b.isNull() & (cut != a), pick(cut, "trimmed_suspicious_trailing_digits"))
        .when(b.isNull() | (a == b), pick(a, None))
        .when(longer(a, b), pick(b, "document_number_replaced_by_shorter_fallback_prefix"))
        .when(longer(b, a), pick(a, "document_number_kept_as_shorter_header_prefix"))
        .when((F.length(a) <= 2) & (F.length(b) >= 3), pick(b, "document_number_replaced_because_header_was_too_short"))
        .when((F.length(b) <= 2) & (F.length(a) >= 3), pick(a, None))
        .when((F.length(a) >= 5) & (b == cut), pick(b, "document_number_replaced_by_trimmed_fallback"))
        .when((F.length(a) >= 5) & (cut != a), pick(cut, "trimmed_suspicious_trailing_digits"))
        .otherwise(pick(a, None))
    )


def reconcile_date(current: Column, shipment: Column, crop: Column, text: Column, template: str = "26-12-2011", markers: list[str] | None = None) -> Column:
    """struct(value, reason): the shipment row's date, the header's, or the crop's."""
    marks = markers or ["постановлени", "приложени", "правительств", "1137", "редакции"]
    read = F.struct(current.alias("now"), shipment.alias("ship"), template_date(current, text, template, marks).alias("form"))
    return let(read, lambda x: _reconcile_date(x["now"], x["ship"], x["form"], crop))


def _reconcile_date(current: Column, shipment: Column, is_form: Column, crop: Column) -> Column:
    pick = lambda v, reason: F.struct(v.cast("string").alias("value"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(shipment.isNotNull() & (shipment.eqNullSafe(current)), pick(current, None))
        .when(shipment.isNotNull(), pick(shipment, "document_date_from_shipment_row"))
        .when(current.isNotNull() & ~is_form, pick(current, None))
        .otherwise(let(mixed_text_date(crop), lambda c: F.when(c.isNotNull(), pick(c, "document_date_from_crop")).otherwise(pick(F.when(~is_form, current), None))))
    )


def header_identity(text: Column) -> Column:
    """struct(number, date) from the header or the shipment line."""
    return let(compact(text), _header)


def _header(x: Column) -> Column:
    heads = [rf"сч[её]т\s*[-–]?\s*фактура\s*{_SIGN}\s*", rf"документ\s+об\s+отгрузке\s*{_SIGN}[^0-9]{{0,20}}"]
    joint = [rf"(?iu){h}([0-9\s\-/]+)\s*от\s*({d})" for h in heads for d in (_WORD_DATE, _DOT_DATE)]
    both = lambda n, d: F.struct(n.cast("string").alias("number"), d.cast("string").alias("date"))
    loose_number = digits(F.regexp_extract(x, rf"(?iu){heads[0]}([0-9\s\-/]{{1,20}})", 1))
    loose_date = F.coalesce(*[strict_date(_given(F.regexp_extract(x, rf"(?iu)от\s*({d})", 1))) for d in (_WORD_DATE, _DOT_DATE)])
    out = both(loose_number, loose_date)

    def either(p: str, other: Column) -> Column:  # groups are read from the match, which is short
        pair = lambda m: both(digits(F.regexp_extract(m, p, 1)), strict_date(F.regexp_extract(m, p, 2)))
        return let(F.regexp_extract(x, p, 0), lambda m: F.when(m != "", pair(m)).otherwise(other))

    for p in reversed(joint):
        out = either(p, out)
    return out


def shipment_identity(text: Column) -> Column:
    """struct(number, date) of the row about the shipment document."""
    return let(compact(F.coalesce(text, F.lit(""))), _shipment)


def _shipment(x: Column) -> Column:
    row = r"№\s*п\s*/?\s*п"
    date = r"[0-9]{1,2}\s+[а-яёa-z0-9]{3,20}\s+[0-9]{4}\s*г?\.?|[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4}"
    about = lambda c: c.contains("документ") & c.contains("отгруз")
    explicit = rf"{row}\s*1\s*{_SIGN}\s*([0-9\s\-/]{{1,15}})\s*от\s*({date})"
    dated = rf"^(.*?)(?<![\p{{L}}\p{{N}}])от\s*({date})"
    tail = let(F.regexp_extract(x, dated, 1), lambda b: F.when(about(b), F.element_at(F.split(b, "(?iu)№|no|n"), -1)).otherwise(b))
    numbers = F.transform(F.regexp_extract_all(tail, F.lit(r"([0-9][0-9\s\-/]{0,12})"), F.lit(1)), digits)
    fit = F.filter(numbers, lambda n: (n != "1") & F.length(n).between(2, 6))
    both = lambda n, d: F.struct(n.cast("string").alias("number"), d.cast("string").alias("date"))
    usable = about(x) | x.rlike(row)
    return (
        F.when(usable & x.rlike(explicit), both(digits(F.regexp_extract(x, explicit, 1)), invoice_date(F.regexp_extract(x, explicit, 2))))
        .when(usable & x.rlike(dated), both(F.try_element_at(fit, F.lit(-1)), invoice_date(F.regexp_extract(x, dated, 2))))
        .otherwise(both(F.lit(None), F.lit(None)))
    )


def tax_ids(text: Column, label: str) -> Column:
    """struct(inn, kpp) within 40 characters behind a label."""
    p = rf"(?iu){label}[^0-9]{{0,40}}([0-9]{{10}})\s*/\s*([0-9]{{9}})"
    g = lambda m, k: _given(F.regexp_extract(m, p, k))
    return let(F.regexp_extract(text, p, 0), lambda m: F.struct(g(m, 1).alias("inn"), g(m, 2).alias("kpp")))


def party_name(text: Column, label: str) -> Column:
    return _party(flat(text), label)


def _party(x: Column, label: str) -> Column:
    name = F.regexp_extract(x, rf"(?iu){label}\s*[:：]?\s*(ООО\s*[\"“”']?[^\n\r;()]+)", 1)
    return _given(F.substring(F.trim(name), 1, 80))


def service_text(text: Column) -> Column:
    return let(flat(text), _service)


def _service(x: Column) -> Column:
    head = r"(?iu)(Транспортно[-\s]экспедиционные услуги"
    stopped = F.regexp_extract(x, rf"{head}.{{0,600}}?)(?:Всего к оплате|Руководитель|Главный бухгалтер)", 1)
    return _given(F.trim(F.coalesce(_given(stopped), F.regexp_extract(x, rf"{head}.{{0,400}})", 1))))


def transport_details(service: Column) -> Column:
    """struct(request_number, request_date, vehicle, loading, unloading)."""
    return let(flat(service), _transport)


def _transport(x: Column) -> Column:
    request = rf"(?iu)заявк[аеи]\s*{_SIGN}\s*([0-9\s\-/]+)\s*от\s*([0-9]{{1,2}}\s+[а-яё]+\s+[0-9]{{4}}|{_DOT_DATE})"
    when = lambda word: rf"(?iu){word}\s*({_DOT_DATE})\s*([0-9]{{1,2}}:[0-9]{{2}})"
    first = lambda p, show: let(F.regexp_extract(x, p, 0), lambda m: F.when(m != "", show(m)))
    moment = lambda word: first(when(word), lambda m: F.concat_ws(" ", strict_date(F.regexp_extract(m, when(word), 1)), F.regexp_extract(m, when(word), 2)))
    vehicle = F.regexp_extract(x, r"(?iu)(?:а/м|автомобиль|машина)\s*([A-Za-zА-Яа-я0-9\-\s]{3,40})\s+Погрузка", 1)
    return F.struct(
        first(request, lambda m: digits(F.regexp_extract(m, request, 1))).alias("request_number"),
        first(request, lambda m: strict_date(F.regexp_extract(m, request, 2))).alias("request_date"),
        _given(F.trim(vehicle)).alias("vehicle"), moment("Погрузка").alias("loading"), moment("разгрузка").alias("unloading"),
    )


def extract_invoices(pages: DataFrame) -> DataFrame:
    """Pages (rel_path, text, header_text, targeted map, status) to invoice rows.

    Texts and what is read from them are columns and values of :func:`let`: Spark computes
    each once, and no expression holds copies of another.
    """
    t = F.concat_ws("\n", "header_text", "text", F.array_join(F.map_values("targeted"), "\n"))
    crop = lambda k: F.col("targeted")[k]
    low, line = F.col("low"), F.col("line")
    x = pages.withColumn("all", t).withColumn("line", flat(F.col("all"))).withColumn("low", F.lower("line"))
    whole = F.when(low.contains("документ") & low.contains("отгруз"), F.col("all"))
    x = x.withColumns({"head": _header(low), "ship": shipment_identity(F.coalesce(crop("shipment_document_text_from_crop"), whole)), "points": let(low, _continuation)})
    x = x.withColumn("n", reconcile_number(F.coalesce("head.number", crop("invoice_number_from_crop")), F.col("ship.number")))
    x = x.withColumn("d", reconcile_date(F.col("head.date"), F.col("ship.date"), crop("invoice_date_text_from_crop"), F.col("all")))
    x = x.withColumns(
        {
            "page": _classify(low, F.col("points"), F.col("status"), F.col("n.value"), F.col("d.value"), F.col("ship.number").isNotNull() & F.col("ship.date").isNotNull()),
            "seller": tax_ids(F.col("all"), r"инн\s*/\s*кпп\s+продавц[а-я]*"), "buyer": tax_ids(F.col("all"), r"инн\s*/\s*кпп\s+покупател[а-я]*"),
            "amounts": last_three_amounts(F.col("all")), "service": let(line, _service),
        }
    )
    warnings = F.array_compact(
        F.array(F.col("n.reason"), F.col("d.reason"), F.when(F.col("page.inferred"), "status_inferred_from_header_markers"))
    )
    return x.select(
        "rel_path", F.col("page.recognized").alias("is_recognized"), F.col("page.continuation").alias("is_continuation_page"), "status",
        F.col("n.value").alias("document_number"), F.col("d.value").alias("document_date"), _party(line, "Продавец").alias("issuer_name"),
        F.col("seller.inn").alias("issuer_inn"), F.col("seller.kpp").alias("issuer_kpp"), _party(line, "Покупатель").alias("recipient_name"),
        F.col("buyer.inn").alias("recipient_inn"), F.col("buyer.kpp").alias("recipient_kpp"), F.col("amounts.net").alias("amount_without_tax"),
        F.col("amounts.tax").alias("tax_amount"), F.col("amounts.gross").alias("total_amount"), F.lit("RUB").alias("currency"),
        F.col("service").alias("description"), let(F.col("service"), _transport).alias("transport"),
        _confidence(F.col("points"), F.col("page.recognized"), F.col("page.continuation"), F.col("n.value"), F.col("d.value"), F.col("seller.inn"), F.col("buyer.inn"), F.col("amounts.gross")).alias("confidence"),
        preview("all", collapse=False).alias("text_preview"), warnings.alias("warnings"),
    )
