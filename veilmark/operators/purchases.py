"""Electronic transfer documents: tables to items, totals, checks.

A document's tables are small and stand in its row: headers, lines and totals are found by
functions on arrays there, and nothing is shuffled or collected over documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.dates import purchase_date
from veilmark.functions.money import labelled_totals, rounded_money
from veilmark.functions.spans import let
from veilmark.functions.text import bare_header, cell, preview, table_header, unit

KEYS = ["name", "quantity", "unit_price", "tax_rate", "tax_amount", "amount_without_tax", "total_amount", "unit_code", "unit"]
#: Each field's rule asks for a word that begins with one of these; cells are joined by blanks, so one cell holds it.
HEADER_STEMS = ["наименование", "количество", "объем", "цена", "налоговая", "сумма", "стоимость", "единица", "океи", "условное"]
SUMMARY_MARKS = ["всего к оплате", "всего по документу", "итого", "всего"]
TOLERANCE = "0.02"
HEADER_ROWS, HEADER_SPAN, HEADER_KEYS = 12, 4, 4
#: Points of the confidence (fixed values).
POINTS = {"invoice": 20, "transfer": 20, "status": 20, "number": 10, "date": 10, "seller": 8, "items": 7, "total": 5}
#: Warnings (fixed values).
PRICE_WARNING = "Quantity multiplied by price does not match line amount"
TOTAL_WARNING = "Line amount plus VAT does not match line total"
UNIT_WARNING = "Text unit name was not extracted; numeric OKEI code was ignored"
NO_ITEMS = "No goods or service rows were extracted"
REQUIRED = {"document_number": "document number", "document_date": "document date", "issuer_inn": "seller INN", "total_amount": "total amount"}
COMPARED = {"amount_without_tax": "amount without VAT", "tax_amount": "VAT amount", "total_amount": "total amount"}
STATUS_TWO = "The file contains explicit UPD status 2"
INFERRED = "UPD status was not explicit; status 1 was inferred from invoice-transfer markers"
NOT_ONE = "The file was not recognized as an UPD status 1 document"


def column_key(header: Column) -> Column:
    """The item field that a header cell names, or null; rules in order."""
    return _key(table_header(header))


def _key(header: Column) -> Column:
    return let(header, lambda h: F.coalesce(*[F.when(rule, key) for key, rule in _rules(h).items()]))


def _rules(h: Column) -> dict[str, Column]:
    """Whether a header, as :func:`table_header` gives it, meets the rule of each field."""

    def any_of(*words: str) -> Column:
        return functools.reduce(lambda a, b: a | b, [h.contains(w) for w in words])

    return {
        "name": h.contains("наименование") & any_of("товар", "работ", "услуг", "имуществен"),
        "quantity": any_of("количество", "объем"),
        "unit_price": h.contains("цена") & h.contains("единиц"),
        "tax_rate": h.contains("налоговая ставка"),
        "tax_amount": h.contains("сумма налога"),
        "amount_without_tax": h.contains("стоимость") & h.contains("без налога"),
        "total_amount": h.contains("стоимость") & any_of("с налогом", "всего"),
        "unit_code": (h.contains("единица измерения") & h.contains("код")) | h.contains("океи"),
        "unit": h.contains("условное обозначение") | h.contains("единица измерения"),
    }


def _names_goods(value: Column) -> Column:
    """Whether a cell is the header of the name itself."""
    return header_hint(value) & let(bare_header(value), lambda h: _rules(h)["name"])


#: Signs that a column's mark is written with.
_SIGNS = r"[\s№().:-]*"


def _is_marker(value: Column) -> Column:
    """One or two digits and perhaps a letter (the last is the sign of Kelvin, in lower case a k), among signs."""
    return value.rlike(rf"(?U)^{_SIGNS}[0-9](?:{_SIGNS}[0-9])?(?:{_SIGNS}[а-яА-Яa-zA-Z\u212a])?{_SIGNS}$")


def is_summary(name: Column) -> Column:
    return let(F.lower(name), lambda low: functools.reduce(lambda a, b: a | b, [low.contains(m) for m in SUMMARY_MARKS]))


def _hinted(low: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, [low.contains(s) for s in HEADER_STEMS])


def header_hint(value: Column) -> Column:
    """Whether a cell may be part of a header that names a field; no header without such a cell does."""
    return let(F.replace(F.lower(value), F.lit("ё"), F.lit("е")), _hinted)


def header_of(table: Column) -> Column:
    """struct(n, row, at) of a table of cells, or null: the span of rows that names most fields.

    Spans of one to four rows within the first twelve; the earliest and shortest of
    the best.  The name and four fields at least are needed.  ``row`` is the span's last
    row, ``at`` the column of each field.  A span is read if more of its columns hold
    a hint than fields were found before, which is as many as it can name.
    """
    top = F.slice(table, 1, HEADER_ROWS + HEADER_SPAN - 1)
    last = F.array_max(F.transform(table, lambda row, r: F.when(F.size(row) > 0, r)))
    # A row's cells are looked at one by one only if the row as a whole holds a hint.
    hints = F.transform(top, lambda row: F.when(header_hint(F.array_join(row, " ")), F.transform(row, header_hint)))
    wide = F.sequence(F.lit(0), F.array_max(F.transform(top, F.size)) - 1)
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(n).alias("span")) for a in range(HEADER_ROWS) for n in range(1, HEADER_SPAN + 1)])
    merged = lambda rows, c: F.array_join(F.filter(F.transform(rows, lambda row: F.get(row, c)), lambda v: v != ""), " ")
    none = F.lit(None).cast("struct<n:int,row:int,keys:array<string>>")

    def named(s: Column, columns: Column, x: Column, best: Column) -> Column:
        """The fields of a span's columns, if these are more than those of the best before."""
        key = lambda c: F.when(F.array_contains(columns, c), _key(bare_header(merged(F.slice(top, s["start"] + 1, s["span"]), c))))
        n = lambda k: F.size(F.array_distinct(F.array_compact(k)))
        better = lambda k: F.array_contains(F.array_compact(k), "name") & (n(k) >= HEADER_KEYS) & (n(k) > F.coalesce(best["n"], F.lit(0)))
        found = lambda k: F.struct(n(k).alias("n"), (s["start"] + s["span"] - 1).alias("row"), k.alias("keys"))
        return let(F.transform(x["wide"], key), lambda k: F.when(better(k), found(k)).otherwise(best))

    def search(x: Column) -> Column:
        def step(best: Column, s: Column) -> Column:
            here = F.slice(x["hints"], s["start"] + 1, s["span"])
            columns = F.filter(x["wide"], lambda c: F.exists(here, lambda h: F.get(h, c)))
            return let(columns, lambda cs: F.when(F.size(cs) > F.coalesce(best["n"], F.lit(HEADER_KEYS - 1)), named(s, cs, x, best)).otherwise(best))

        hinted = lambda s: F.exists(F.slice(x["hints"], s["start"] + 1, s["span"]), lambda h: h.isNotNull())
        return F.aggregate(F.filter(spans, lambda s: (s["start"] + s["span"] - 1 <= x["last"]) & hinted(s)), none, step)

    def found(x: Column) -> Column:
        at = F.struct(*[(F.nullif(F.array_position(x["keys"], k), F.lit(0)) - 1).cast("int").alias(k) for k in KEYS])
        return F.when(x.isNotNull(), F.struct(x["n"].alias("n"), x["row"].alias("row"), at.alias("at")))

    seen = F.struct(hints.alias("hints"), last.alias("last"), wide.alias("wide"))
    return let(let(seen, lambda x: F.when(F.exists(x["hints"], lambda h: h.isNotNull()), search(x))), found)


def item_warnings(quantity: Column, price: Column, net: Column, tax: Column, total: Column) -> Column:
    """Arithmetic of a line; a missing value means no check."""
    bad = lambda diff: F.abs(diff) > F.lit(TOLERANCE).cast("decimal(38,4)")
    d = lambda c: c.cast("decimal(18,2)")
    return F.array_compact(
        F.array(F.when(bad(d(quantity) * d(price) - d(net)), PRICE_WARNING), F.when(bad(d(net) + d(tax) - d(total)), TOTAL_WARNING))
    )


MONEY = ["quantity", "unit_price", "amount_without_tax", "tax_amount", "total_amount"]


def _designators(row: Column) -> Column:
    """Whether a row only holds the marks of its columns."""

    def many(filled: Column) -> Column:
        marks = lambda m: (m >= 3) & (m * 10 >= F.size(filled) * 7)
        return (F.size(filled) >= 3) & let(F.size(F.filter(filled, _is_marker)), marks)

    return let(F.filter(row, lambda v: v != ""), many)


def _line(row: Column, head: Column) -> Column:
    """The fields of a row below a header, or null if it has no name or is none of the lines."""
    at = lambda k: F.nullif(F.get(row, head["at"][k]), F.lit(""))
    value = lambda k: rounded_money(at(k)).cast("string") if k in MONEY else at(k)
    fields = lambda: F.struct(*[value(k).alias(k) for k in KEYS], is_summary(at("name")).alias("summary"), head["n"].alias("n"))
    return F.when(at("name").isNotNull() & ~_designators(row), fields())


def _is_item(x: Column) -> Column:
    named = ~x["summary"] & ~_names_goods(x["name"]) & ~_is_marker(x["name"]) & x["name"].rlike(r"\p{L}")
    return named & F.coalesce(*[x[k] for k in [*MONEY, "tax_rate"]]).isNotNull()


def _item(x: Column, place: Column) -> Column:
    def checked(known: Column) -> Column:
        no_unit = F.when(known.isNull() & F.coalesce(x["unit"], x["unit_code"]).isNotNull(), UNIT_WARNING)
        return F.struct(
            (place + 1).alias("line_number"), x["name"].alias("name"), known.alias("unit"),
            *[x[k].alias(k) for k in ("quantity", "unit_price", "amount_without_tax", "tax_rate", "tax_amount", "total_amount")],
            F.least(F.lit(100), 45 + x["n"] * 7).alias("confidence"),
            F.concat(F.array_compact(F.array(no_unit)), item_warnings(*[x[k] for k in MONEY])).alias("warnings"),
        )

    return let(unit(x["unit"]), checked)


def with_items(sources: DataFrame) -> DataFrame:
    """``sources`` with ``items``, an array, and ``totals``, a struct that is null without a summary line.

    A document's tables stand in its row and are read there: no cell is shuffled.
    """
    clean = F.transform("tables", lambda table: F.transform(table, lambda row: F.transform(row, cell)))
    lines = lambda table, head: F.transform(F.slice(table, head["row"] + 2, F.size(table)), lambda row: _line(row, head))
    read = F.transform("_grid", lambda table: let(header_of(table), lambda head: F.when(head.isNotNull(), lines(table, head))))
    rows = F.filter(F.flatten(F.filter(read, lambda x: x.isNotNull())), lambda x: x.isNotNull())
    items = F.transform(F.filter("_lines", _is_item), _item)
    ends = F.filter("_lines", lambda x: x["summary"])
    total = lambda x, k: F.try_element_at(F.filter(x[k], lambda v: v.isNotNull()), F.lit(-1)).alias(k)
    totals = let(ends, lambda x: F.when(F.size(x) > 0, F.struct(*[total(x, k) for k in COMPARED])))
    return sources.withColumn("_grid", clean).withColumn("_lines", rows).withColumns({"items": items, "totals": totals}).drop("_grid", "_lines")


def extract_items(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, totals) of documents from their tables."""
    read = with_items(sources.select("rel_path", "tables"))
    # Outer: Spark would read the tables once more, to leave out documents without items.
    items = read.select("rel_path", F.explode_outer("items").alias("i")).where("i is not null").select("rel_path", "i.*")
    return items, read.where("totals is not null").select("rel_path", "totals.*")


def document_warnings(doc: dict[str, Column], items: Column, sums: dict[str, Column]) -> Column:
    """Missing fields, missing items, and sums of items that differ from the document."""
    parts = [F.when(F.coalesce(doc[k], F.lit("")) == "", f"Missing required {label}") for k, label in REQUIRED.items()]
    parts.append(F.when(F.coalesce(items, F.lit(0)) == 0, NO_ITEMS))
    d = lambda c: c.cast("decimal(38,2)")
    for k, label in COMPARED.items():
        parts.append(F.when(F.abs(d(sums[k]) - d(doc[k])) > F.lit(TOLERANCE).cast("decimal(38,2)"), f"Item {label} does not match document total"))
    return F.array_compact(F.array(*parts))


def status(text: Column) -> Column:
    x = F.lower(F.regexp_replace(text, r"(?U)\s+", " "))
    explicit = F.nullif(F.regexp_extract(x, r"(?iuU)статус\s*[:№]?\s*([12])\b", 1), F.lit(""))
    phrase = x.rlike(r"1\s*[-–—]\s*сч[её]т\s*[-–—]?\s*фактура\s+и\s+передаточ") | x.rlike("сч[её]т-фактура и передаточный документ")
    return F.coalesce(explicit, F.when(phrase, "1"))


def number_and_date(text: Column) -> Column:
    x = F.regexp_replace(text, r"(?U)\s+", " ")
    date = r"([0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4}|[0-9]{1,2}\s+[а-яё]+\s+[0-9]{4})"
    number = r"([A-ZА-ЯЁ0-9][A-ZА-ЯЁ0-9\-/]*)"
    heads = [r"(?:сч[её]т\s*[-–—]?\s*фактура|универсальн\w*\s+передаточ\w*\s+документ)\s*", r"документ\s+об\s+отгрузке[^№N0-9]{0,40}"]
    out = F.struct(F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("date"))
    for h in reversed(heads):
        p = rf"(?iuU){h}(?:№|N|No)?\s*{number}\s*от\s*{date}"
        hit = F.struct(F.regexp_extract(x, p, 1).alias("number"), purchase_date(F.regexp_extract(x, p, 2)).alias("date"))
        out = F.when(x.rlike(p), hit).otherwise(out)
    return out


def party(text: Column, label: str, stem: str) -> Column:
    x = F.regexp_replace(text, r"(?U)\s+", " ")
    nexts = r"Адрес|ИНН\s*/\s*КПП|Грузоотправитель|Грузополучатель|Покупатель|Продавец|Валюта|Идентификатор"
    name = F.regexp_extract(x, rf"(?iuU){label}\s*[:：]?\s*(.+?)(?=\s+(?:{nexts})\b|$)", 1)
    tax = rf"(?iuU)ИНН\s*/\s*КПП\s+{stem}\w*\s*[:：]?\s*([0-9]{{10,12}})(?:\s*/\s*([0-9]{{9}}))?"
    none = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        none(F.substring(F.regexp_replace(name, r"^[ :;|]+|[ :;|]+$", ""), 1, 200)).alias("name"),
        none(F.regexp_extract(x, tax, 1)).alias("inn"), none(F.regexp_extract(x, tax, 2)).alias("kpp"),
    )


def extract_purchases(sources: DataFrame) -> DataFrame:
    """Sources (rel_path, text, tables, page_count, used_ocr, warnings) to documents with their items."""
    def total(k: str) -> Column:
        """The sum of what the items hold of a field, null if none does."""
        given = F.filter(F.transform("items", lambda i: i[k].cast("decimal(38,2)")), lambda v: v.isNotNull())
        zero = F.lit(0).cast("decimal(38,2)")
        return let(given, lambda x: F.when(F.size(x) > 0, F.aggregate(x, zero, lambda a, v: (a + v).cast("decimal(38,2)")))).cast("string")

    t = F.col("text")
    x = with_items(sources).withColumn("items", F.coalesce("items", F.array()))
    x = x.withColumns(
        {"status": status(t), "nd": number_and_date(t), "s": party(t, "Продавец", "продав"), "b": party(t, "Покупатель", "покупател"),
         "tt": labelled_totals(t, r"всего\s+к\s+оплате"), "low": F.lower(F.regexp_replace(t, r"(?U)\s+", " "))}
        | {f"sum_{k}": total(k) for k in COMPARED} | {f"tab_{k}": F.col("totals")[k] for k in COMPARED}
    )
    text_total = {"amount_without_tax": "tt.net", "tax_amount": "tt.tax", "total_amount": "tt.total"}
    x = x.withColumns({k: F.coalesce(f"tab_{k}", text_total[k], f"sum_{k}") for k in COMPARED})
    x = x.withColumns({"document_number": F.col("nd.number"), "document_date": F.col("nd.date"), "issuer_inn": F.col("s.inn"), "n_items": F.size("items")})
    invoice = F.col("low").rlike(r"сч[её]т\s*[-–—]?\s*фактур")
    transfer = F.col("low").contains("универсальн") & F.col("low").contains("передаточ")
    two = F.coalesce(F.col("status") == "2", F.lit(False))
    one = F.coalesce(F.col("status") == "1", F.lit(False))
    known = F.col("document_number").isNotNull() & F.col("document_date").isNotNull()
    recognized = invoice & transfer & ~two & (one | known)
    tests = {"invoice": invoice, "transfer": transfer, "status": one, "number": F.col("document_number").isNotNull(), "date": F.col("document_date").isNotNull(),
             "seller": F.col("issuer_inn").isNotNull(), "items": F.col("n_items") > 0, "total": F.col("total_amount").isNotNull()}
    points = F.lit(0)
    for name, test in tests.items():
        points = points + F.when(test, POINTS[name]).otherwise(0)
    checks = document_warnings({k: F.col(k) for k in [*REQUIRED, *COMPARED]}, F.col("n_items"), {k: F.col(f"sum_{k}") for k in COMPARED})
    extra = F.array_compact(F.array(F.when(two, STATUS_TWO), F.when(recognized & F.col("status").isNull(), INFERRED), F.when(~recognized & ~two, NOT_ONE)))
    warnings = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), extra, checks)
    names = F.when(F.col("n_items") > 0, F.array_join(F.transform(F.slice("items", 1, 5), lambda i: i["name"]), "; "))
    out = x.select(
        "rel_path", recognized.alias("is_recognized"), "status", "document_number", "document_date", F.col("s.name").alias("issuer_name"), "issuer_inn",
        F.col("s.kpp").alias("issuer_kpp"), F.col("b.name").alias("recipient_name"), F.col("b.inn").alias("recipient_inn"), F.col("b.kpp").alias("recipient_kpp"),
        *COMPARED, F.lit("RUB").alias("currency"), names.alias("description"), F.least(points, F.lit(100)).alias("confidence"), "page_count", "used_ocr",
        preview("text").alias("text_preview"), "items", warnings.alias("warnings"),
    )
    review = (F.size("warnings") > 0) | ~F.col("is_recognized") | F.exists("items", lambda i: F.size(i["warnings"]) > 0)
    return out.withColumn("requires_review", review)
