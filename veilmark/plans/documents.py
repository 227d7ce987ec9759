"""Extraction over documents that Spark writes from the tables, with their fields as SQL.

Each row of a table becomes the text (or the cells) of a business document, which is written
as a table of pages; the operators read it back.  Values of fields are stated anew in SQL, from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import dates, recognizers
from veilmark.operators import planning, readings
from veilmark.operators.invoices import SUSPICIOUS_ENDS, extract_invoices
from veilmark.operators.purchases import NO_ITEMS, PRICE_WARNING, TOTAL_WARNING, extract_items, extract_purchases
from veilmark.operators.receipts import extract_receipts
from veilmark.sources.shared import stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURNAMES = ["Иванов", "Петренко", "Сидоров-Белый", "Ким", "Орлова", "Ёлкина", "Гусев"]
NAMES = ["Мария", "Олег", "Анна", "Пётр", "Яна"]
PATRONYMICS = ["Ивановна", "Павлович", "Олеговна", "Ильич"]
FIRMS = ["Ромашка", "Вектор", "Клён"]


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({key} % {len(values)} AS INTEGER) + 1]"


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores: a small table is one piece of a file, but its pages take long to read."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _inn(first: str, key: Column, size: int) -> Column:
    return F.concat(F.lit(first), F.lpad(key.cast("string"), size - len(first), "0"))


def receipt_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each part: a receipt in one of three layouts, or no receipt."""
    x = _spread(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice", "p_name"), "p_partkey")
    k = F.col("p_partkey")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 1500).cast("int"))
    amount = F.translate(F.format_number(F.col("p_retailprice").cast("decimal(18,2)"), 2), ",.", " ,")
    names = _pick(SURNAMES, k), _pick(NAMES, k), _pick(PATRONYMICS, k)
    inn = _inn("5", k, 12)
    plain = _text(
        "Мой налог\nЧек № АБ-", k.cast("string"), " от ", F.date_format(day, "dd.MM.yyyy"), "\n\n", F.concat_ws(" ", *names), "\nИНН ", inn,
        "\n\nНаименование услуги: Работа ", k.cast("string"), "\nИтого: ", amount, " руб.\n\nПокупатель ООО ", _pick(FIRMS, k), "\nИНН ", _inn("77", k, 10), "\nНалог на профессиональный доход",
    )
    split = _text("Чек № ", k.cast("string"), "-12 дата ", F.date_format(day, "d.M.yy"), "\n", names[0], "\n", F.concat_ws(" ", *names[1:]), "\nИНН ", inn, "\nсамозанятый\n1 000,00\n", amount)
    late = _text("НПД чек ", F.date_format(day, "dd-MM-yyyy"), "\n", F.concat_ws(" ", *names[:2]), "\n", names[2], "\nИНН ", inn, "\nИтого ", amount, "\nКвитанция № КВ-", k.cast("string"), " от ", F.date_format(day, "dd-MM-yyyy"))
    other = _text("просто текст ", F.col("p_name"))
    page = F.when(k % 4 == 0, plain).when(k % 4 == 1, split).when(k % 4 == 2, late).otherwise(other)
    pages = x.select(k.cast("string").alias("rel_path"), page.alias("text")).withColumns({"header_text": F.lit(""), "targeted_text": F.lit(""), "rotation": F.lit(0)})
    return stash(pages, "receipt-pages")


_PARTS_SQL = f"""x AS (SELECT *, p_partkey AS k, p_partkey % 4 AS form, DATE '2020-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS day,
  {_sql_pick(SURNAMES, "p_partkey")} || ' ' || {_sql_pick(NAMES, "p_partkey")} || ' ' || {_sql_pick(PATRONYMICS, "p_partkey")} AS person FROM part)"""


@query(f"""WITH {_PARTS_SQL} SELECT CAST(k AS VARCHAR) AS rel_path, form < 3 AS is_recognized,
  CASE form WHEN 0 THEN 'АБ-' || k WHEN 1 THEN k || '-12' WHEN 2 THEN 'КВ-' || k ELSE '-' END AS document_number,
  CASE WHEN form < 3 THEN strftime(day, '%d-%m-%Y') ELSE '-' END AS document_date, CASE WHEN form < 3 THEN person ELSE '-' END AS issuer_name,
  CASE WHEN form < 3 THEN '5' || lpad(CAST(k AS VARCHAR), 11, '0') ELSE '-' END AS issuer_inn, CASE form WHEN 0 THEN 'ООО ' || {_sql_pick(FIRMS, "k")} ELSE '-' END AS recipient_name,
  CASE form WHEN 0 THEN '77' || lpad(CAST(k AS VARCHAR), 8, '0') ELSE '-' END AS recipient_inn, CASE WHEN form < 3 THEN CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR) ELSE '-' END AS total_amount,
  CASE form WHEN 0 THEN 'Работа ' || k ELSE '-' END AS description, CAST(CASE WHEN form < 3 THEN 100 ELSE 0 END AS INTEGER) AS confidence, '' AS warnings FROM x""")
def receipt_documents(spark, d):
    """Receipts of all parts are read back."""
    x = extract_receipts(receipt_pages(spark, d))
    blank = lambda c: F.coalesce(F.col(c), F.lit("-")).alias(c)
    columns = ["document_number", "document_date", "issuer_name", "issuer_inn", "recipient_name", "recipient_inn", "total_amount", "description"]
    return x.select("rel_path", "is_recognized", *[blank(c) for c in columns], "confidence", F.array_join("warnings", "|").alias("warnings"))


def invoice_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each order: an invoice, a continuation, or one whose number was misread."""
    x = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    x = _spread(x, "o_orderkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date(F.add_months("o_orderdate", 300))
    word = F.concat_ws(" ", F.date_format(day, "d"), _pick(dates.MONTHS, F.month(day) - 1), F.date_format(day, "yyyy"), F.lit("г."))
    cents = lambda n: F.translate(F.format_number(n.cast("decimal(18,2)"), 2), ",.", " ,")
    net = F.col("o_totalprice").cast("decimal(18,2)")
    whole = _text(
        "Счет-фактура № ", k.cast("string"), " от ", word, "\nУниверсальный передаточный документ\nПродавец: ООО ", _pick(FIRMS, k), " (перевозки)\nИНН / КПП продавца ", _inn("77", c, 10),
        " / 770101001\nИНН / КПП покупателя ", _inn("69", c, 10), " / 690101001\nТранспортно-экспедиционные услуги по заявке № ", c.cast("string"), " от ", F.date_format(day, "dd.MM.yyyy"),
        " а/м Скания А", (k % 1000).cast("string"), " Погрузка 02.03.2023 09:30 разгрузка 03.03.2023 18:00 Всего к оплате\n", cents(net), " ", cents(net / 5), " ", cents(net + (net / 5).cast("decimal(18,2)")),
    )
    second = _text("Наименование экономического субъекта составителя документа\nподпись М.П. ", F.col("o_orderpriority"))
    misread = _text("счет фактура № ", k.cast("string"), "23 универсальный")
    crop = F.create_map(F.lit("shipment_document_text_from_crop"), _text("№ п/п 1 № ", k.cast("string"), " от ", word))
    none = F.create_map().cast("map<string,string>")
    pages = x.select(
        k.cast("string").alias("rel_path"), F.when(k % 3 == 0, whole).when(k % 3 == 1, second).otherwise(misread).alias("text"),
        F.when(k % 3 == 2, crop).otherwise(none).alias("targeted"), F.when(k % 3 != 1, F.lit("1")).alias("status"), F.lit("").alias("header_text"),
    )
    return stash(pages, "invoice-pages")


_ENDS = ", ".join(f"'{e}'" for e in SUSPICIOUS_ENDS)


@query(f"""WITH x AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 3 AS form, strftime(o_orderdate + INTERVAL 300 MONTH, '%d-%m-%Y') AS day, CAST(o_totalprice AS DECIMAL(18, 2)) AS net FROM orders),
y AS (SELECT *, length(k) = 5 AND substr(k, 4, 2) IN ({_ENDS}) AS cut, CASE WHEN length(k) >= 3 THEN 1 WHEN length(k) = 1 THEN 2 ELSE 3 END AS pick FROM x)
SELECT k AS rel_path, form <> 1 AS is_recognized, form = 1 AS is_continuation_page,
  CASE WHEN form = 0 AND cut THEN substr(k, 1, 3) WHEN form = 0 OR (form = 2 AND pick = 1) THEN k WHEN form = 2 THEN k || '23' ELSE '-' END AS document_number,
  CASE WHEN form = 1 THEN '-' ELSE day END AS document_date, CASE WHEN form = 0 THEN 'ООО ' || {_sql_pick(FIRMS, "o_orderkey")} ELSE '-' END AS issuer_name,
  CASE WHEN form = 0 THEN '77' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') ELSE '-' END AS issuer_inn, CASE WHEN form = 0 THEN '69' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') ELSE '-' END AS recipient_inn,
  CASE WHEN form = 0 THEN CAST(net + CAST(net / 5 AS DECIMAL(18, 2)) AS VARCHAR) ELSE '-' END AS total_amount, CASE WHEN form = 0 THEN 'Скания А' || o_orderkey % 1000 ELSE '-' END AS vehicle,
  CASE WHEN form = 0 THEN '02-03-2023 09:30' ELSE '-' END AS loading, CASE WHEN form = 0 THEN day ELSE '-' END AS request_date,
  CAST(CASE form WHEN 0 THEN 100 WHEN 1 THEN 90 ELSE 75 END AS INTEGER) AS confidence,
  CASE WHEN form = 0 AND cut THEN 'trimmed_suspicious_trailing_digits' WHEN form = 2 AND pick = 1 THEN 'document_number_replaced_by_shorter_fallback_prefix' ELSE '' END AS warnings FROM y""")
def invoice_documents(spark, d):
    """Scanned invoices of all orders are read back."""
    x = extract_invoices(invoice_pages(spark, d))
    blank = lambda c, n: F.coalesce(F.col(c), F.lit("-")).alias(n)
    columns = ["document_number", "document_date", "issuer_name", "issuer_inn", "recipient_inn", "total_amount"]
    return x.select(
        "rel_path", "is_recognized", "is_continuation_page", *[blank(c, c) for c in columns], blank("transport.vehicle", "vehicle"), blank("transport.loading", "loading"),
        blank("transport.request_date", "request_date"), "confidence", F.array_join("warnings", "|").alias("warnings"),
    )


HEADER = ["Наименование товара (работ)", "Единица измерения", "Количество", "Цена за единицу", "Стоимость без налога", "Налоговая ставка", "Сумма налога", "Стоимость с налогом"]


def purchase_sources(spark: SparkSession, d: str) -> DataFrame:
    """A document for each customer, with a table whose lines are the customer's orders.

    Of every seventh order the net amount is off, of every fifth the gross one, and of every
    eleventh customer the document's total.
    """
    dec = lambda c: c.cast("decimal(18,2)")
    # Keys are dealt once, over all cores, and lines are made behind that; the join and the documents stay where they are.
    pieces = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey").repartition(pieces, "o_custkey")
    k, quantity = F.col("o_orderkey"), F.col("o_orderkey") % 9 + 1
    price = dec(F.col("o_orderkey") % 1000) + F.lit("0.25").cast("decimal(18,2)")
    net = dec(quantity * price + F.when(k % 7 == 0, F.lit("0.05")).otherwise("0.00").cast("decimal(18,2)"))
    o = o.select("o_custkey", k.alias("k"), dec(quantity).alias("quantity"), dec(price).alias("price"), net.alias("net"), dec(net / 5).alias("tax"))
    o = o.withColumn("gross", dec(F.col("net") + F.col("tax") + F.when(F.col("k") % 5 == 0, F.lit("0.03")).otherwise("0.00").cast("decimal(18,2)")))
    shown = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    row = F.array(_text("Товар ", F.col("k").cast("string")), F.lit("шт"), shown("quantity"), shown("price"), shown("net"), F.lit("20%"), shown("tax"), shown("gross"))
    lines = o.groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("k", row.alias("row"))))["row"].alias("rows"), *[dec(F.sum(c)).alias(c) for c in ("net", "tax", "gross")]
    )
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").repartition(pieces, "c_custkey").hint("merge")
    c = c.join(lines, F.col("c_custkey") == F.col("o_custkey"), "left")
    key = F.col("c_custkey")
    head = F.array(F.array(*map(F.lit, HEADER)), F.array(*[F.lit(str(i)) for i in range(1, 9)]))
    c = c.withColumn("gross", F.when(key % 11 == 0, F.col("gross") + 1).otherwise(F.col("gross")))
    end = F.array(F.array(F.lit("Итого"), F.lit(""), F.lit(""), F.lit(""), shown("net"), F.lit(""), shown("tax"), shown("gross")))
    text = _text(
        "Универсальный передаточный документ Статус: 1\nСчет-фактура № УП-", key.cast("string"), " от ", F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (key % 1500).cast("int")), "dd.MM.yyyy"),
        "\nПродавец: ООО ", _pick(FIRMS, key), " Адрес: Москва\nИНН/КПП продавца: ", _inn("77", key, 10), "/770101001\nПокупатель: ООО Клён Адрес: Тверь\nИНН/КПП покупателя: 6901234567/690101001",
    )
    tables = F.when(F.col("rows").isNotNull(), F.array(F.concat(head, "rows", end))).otherwise(F.array().cast("array<array<array<string>>>"))
    made = c.select(key.cast("string").alias("rel_path"), text.alias("text"), tables.alias("tables"), F.lit(1).alias("page_count"), F.lit(False).alias("used_ocr"), F.array().cast("array<string>").alias("warnings"))
    return stash(made, "purchase-sources")


_LINES_SQL = """l AS (SELECT o_custkey, o_orderkey AS k, CAST((o_orderkey % 9 + 1) AS DECIMAL(18, 2)) AS quantity, CAST(o_orderkey % 1000 AS DECIMAL(18, 2)) + 0.25 AS price,
  CASE WHEN o_orderkey % 7 = 0 THEN 0.05 ELSE 0.00 END AS off, CASE WHEN o_orderkey % 5 = 0 THEN 0.03 ELSE 0.00 END AS over FROM orders),
m AS (SELECT *, CAST(quantity * price + off AS DECIMAL(18, 2)) AS net FROM l), n AS (SELECT *, CAST(net * 0.2 AS DECIMAL(18, 2)) AS tax, CAST(net + CAST(net * 0.2 AS DECIMAL(18, 2)) + over AS DECIMAL(18, 2)) AS gross FROM m)"""


@query(f"""WITH {_LINES_SQL}, s AS (SELECT o_custkey, count(*) AS items, sum(gross) AS gross, bool_or(off > 0 OR over > 0) AS bad FROM n GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS rel_path, true AS is_recognized, '1' AS status, 'УП-' || c_custkey AS document_number, strftime(DATE '2020-01-01' + CAST(c_custkey % 1500 AS INTEGER), '%d-%m-%Y') AS document_date,
  'ООО ' || {_sql_pick(FIRMS, "c_custkey")} AS issuer_name, '77' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS issuer_inn, 'ООО Клён' AS recipient_name,
  coalesce(CAST(CAST(gross + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS DECIMAL(18, 2)) AS VARCHAR), '-') AS total_amount, CAST(coalesce(items, 0) AS INTEGER) AS n_items,
  CAST(CASE WHEN items IS NULL THEN 88 ELSE 100 END AS INTEGER) AS confidence,
  CASE WHEN items IS NULL THEN 'Missing required total amount|{NO_ITEMS}' WHEN c_custkey % 11 = 0 THEN 'Item total amount does not match document total' ELSE '' END AS warnings,
  items IS NULL OR c_custkey % 11 = 0 OR bad AS requires_review FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def purchase_documents(spark, d):
    """Transfer documents of all customers are read back and checked."""
    x = extract_purchases(purchase_sources(spark, d))
    blank = lambda c: F.coalesce(F.col(c), F.lit("-")).alias(c)
    columns = ["status", "document_number", "document_date", "issuer_name", "issuer_inn", "recipient_name", "total_amount"]
    return x.select("rel_path", "is_recognized", *[blank(c) for c in columns], F.size("items").alias("n_items"), "confidence", F.array_join("warnings", "|").alias("warnings"), "requires_review")


@query(f"""WITH {_LINES_SQL} SELECT CAST(o_custkey AS VARCHAR) AS rel_path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS INTEGER) AS line_number, 'Товар ' || k AS name, 'шт' AS unit,
  CAST(quantity AS VARCHAR) AS quantity, CAST(net AS VARCHAR) AS amount_without_tax, CAST(gross AS VARCHAR) AS total_amount,
  concat_ws('|', CASE WHEN off > 0 THEN '{PRICE_WARNING}' END, CASE WHEN over > 0 THEN '{TOTAL_WARNING}' END) AS warnings FROM n JOIN customer ON c_custkey = o_custkey""")
def purchase_items(spark, d):
    """The lines of these documents' tables, with the warnings of their arithmetic."""
    items, _ = extract_items(purchase_sources(spark, d))
    return items.select("rel_path", "line_number", "name", F.coalesce("unit", F.lit("-")).alias("unit"), "quantity", "amount_without_tax", "total_amount", F.array_join("warnings", "|").alias("warnings"))


def _digits(key: Column, size: int, first: str = "") -> Column:
    return F.concat(F.lit(first), F.lpad((key % 10**size).cast("string"), size, "0"))


def _entities(k: Column) -> dict[str, Column]:
    """A value of each kind of entity, by a key."""
    return {
        "RU_ORGANIZATION": _text("ООО «Ромашка ", k.cast("string"), "»"), "PERSON": _text("Директор: ", _pick(SURNAMES, k), " ", _pick(NAMES, k), " ", _pick(PATRONYMICS, k)),
        "RU_INN": _digits(k, 8, "77"), "RU_KPP": _text(_digits(k, 4), "01123"), "RU_OGRN": _digits(k, 12, "1"), "RU_SNILS": _digits(k, 2, "112-233-445 "),
        "RU_PASSPORT": _digits(k, 6, "45 12 "), "RU_BANK_ACCOUNT": _digits(k, 12, "40702810"), "RU_BIK": _digits(k, 5, "0445"), "RU_PHONE_NUMBER": _digits(k, 2, "+7 (495) 123-45-"),
        "EMAIL_ADDRESS": _text("u", k.cast("string"), "@mail.example.com"), "IP_ADDRESS": _text("10.0.", (k % 250).cast("string"), ".7"), "VEHICLE_REGISTRATION": _text(_digits(k, 3, "А"), "ВС77"),
        "VIN": _digits(k, 8, "WVWZZZ1KZ"), "DOCUMENT_NUMBER": _text("договор № АБ-", k.cast("string")), "INTERNATIONAL_PHONE_NUMBER": _digits(k, 4, "+44 20 7946 "),
    }


def _sql_digits(size: int, first: str = "") -> str:
    return f"'{first}' || lpad(CAST(k % {10**size} AS VARCHAR), {size}, '0')"


_ENTITY_SQL = {
    "RU_ORGANIZATION": "'ООО «Ромашка ' || k || '»'", "PERSON": f"'Директор: ' || {_sql_pick(SURNAMES, 'k')} || ' ' || {_sql_pick(NAMES, 'k')} || ' ' || {_sql_pick(PATRONYMICS, 'k')}",
    "RU_INN": _sql_digits(8, "77"), "RU_KPP": _sql_digits(4) + " || '01123'", "RU_OGRN": _sql_digits(12, "1"), "RU_SNILS": _sql_digits(2, "112-233-445 "),
    "RU_PASSPORT": _sql_digits(6, "45 12 "), "RU_BANK_ACCOUNT": _sql_digits(12, "40702810"), "RU_BIK": _sql_digits(5, "0445"), "RU_PHONE_NUMBER": _sql_digits(2, "+7 (495) 123-45-"),
    "EMAIL_ADDRESS": "'u' || k || '@mail.example.com'", "IP_ADDRESS": "'10.0.' || k % 250 || '.7'", "VEHICLE_REGISTRATION": _sql_digits(3, "А") + " || 'ВС77'",
    "VIN": _sql_digits(8, "WVWZZZ1KZ"), "DOCUMENT_NUMBER": "'договор № АБ-' || k", "INTERNATIONAL_PHONE_NUMBER": _sql_digits(4, "+44 20 7946 "),
}


@query("WITH c AS (SELECT c_custkey AS k FROM customer) " + " UNION ALL ".join(f"SELECT k, '{kind}' AS kind, {value} AS found, {r.score} AS score FROM c" for (kind, value), r in ((i, recognizers.BY_KIND[i[0]]) for i in _ENTITY_SQL.items())))
def recognized_entities(spark, d):
    """An entity of each kind in a text for each customer is found by its recognizer."""
    k = F.col("k")
    x = _spread(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k")), "k")
    own = [F.struct(F.lit(kind).alias("kind"), _text("до ", value, ", конец").alias("text")) for kind, value in _entities(k).items()]
    x = stash(x.select("k", F.inline(F.array(*own))), "entity-texts")
    found = F.coalesce(*[F.when(F.col("kind") == kind, recognizers.recognize(F.col("text"), [kind])) for kind in _ENTITY_SQL])
    x = x.select("k", "kind", "text", F.explode(found).alias("s"))
    return x.select("k", "kind", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("found"), F.col("s.score").alias("score"))


@query("""SELECT o_orderkey, strftime(d, '%d-%m-%Y') AS mixed, strftime(d, '%d-%m-%Y') AS textual, strftime(d, '%d-%m-%Y') AS padded, o_orderkey % 3 = 0 AS of_form
FROM (SELECT o_orderkey, o_orderdate + INTERVAL 300 MONTH AS d FROM orders)""")
def dates_of_forms(spark, d):
    """Dates in scattered lines, as words, in short, and those of a printed form."""
    day = F.to_date(F.add_months("o_orderdate", 300))
    part = lambda f: F.date_format(day, f)
    month = _pick(dates.MONTHS, F.month(day) - 1)
    value = F.when(F.col("o_orderkey") % 3 == 0, "26-12-2011").otherwise("27-12-2011")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", dates.mixed_text_date(_text("дата\n", part("d"), "\n", month, "\n", part("yyyy"))).alias("mixed"), dates.purchase_date(_text(part("d"), " ", month, " ", part("yyyy"))).alias("textual"),
        dates.padded_date(part("d/M/yy")).alias("padded"), dates.template_date(value, F.lit("Приложение к постановлению 1137"), "26-12-2011", ["1137"]).alias("of_form"),
    )


@query("""SELECT o_orderkey, substr(k, 1, 6) AS value, CAST(CASE WHEN n = 1 THEN 10 WHEN n < 5 THEN 100 + n WHEN n = 5 THEN 95 ELSE 20 END AS INTEGER) AS score,
  CASE WHEN n < 3 OR n > 5 THEN k || '23' ELSE k END AS shorter, CASE WHEN n < 4 OR n > 5 THEN k || '23' ELSE k END AS crop, CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '1' END AS status
FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, length(CAST(o_orderkey AS VARCHAR)) AS n FROM orders)""")
def number_readings(spark, d):
    """Readings of a number spoilt by its neighbours, and votes on a status."""
    k, form = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    some = lambda n, v: F.when(form == n, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    vote = readings.status_vote(some(0, "1 2"), some(1, "2"), F.array().cast("array<string>"), F.when(form == 2, "статус: 1").otherwise("-"))
    crop = readings.crop_number(F.array(F.concat(k, F.lit("23"))), F.array(k))
    x = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", readings.digit_score(k).alias("s"), readings.prefer_shorter(F.array(F.concat(k, F.lit("23")), k)).alias("shorter"), crop.alias("crop"), vote.alias("status"))
    return x.select("o_orderkey", "s.value", "s.score", "shorter", "crop", "status")


@query(f"""WITH x AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS k, strftime(o_orderdate, '%d-%m-%Y') AS day, o_orderkey % 3 + 1 AS page, {_sql_pick(SURNAMES, "o_orderkey")} AS name FROM orders)
SELECT o_orderkey, 'УПД_' || CASE WHEN o_orderkey % 7 = 0 THEN 'без_номера' ELSE k END || '_от_' || day || CASE WHEN page > 1 THEN '_' || page || '_страница' ELSE '' END AS invoice,
  'act_' || CASE WHEN o_orderkey % 7 = 0 THEN 'without_number' ELSE k END || CASE WHEN o_orderkey % 2 = 0 THEN '_' || day ELSE '' END || CASE WHEN page > 1 THEN '_page_' || page ELSE '' END AS other,
  day || '_' || CASE WHEN o_orderkey % 5 = 0 THEN 'без_суммы' ELSE k || '.00' END || '_' || name || 'Олег_' || CASE WHEN o_orderkey % 4 = 0 THEN 'без_номера' ELSE 'N' || k END AS receipt,
  'out/' || o_orderpriority || '/' || o_orderstatus AS folder, o_orderstatus = 'F' AS inside FROM x""")
def output_names(spark, d):
    """Stems of copies, folders that mirror the source's, and containment of paths."""
    key = F.col("o_orderkey")
    k, day = key.cast("string"), F.date_format("o_orderdate", "dd-MM-yyyy")
    receipt = planning.receipt_stem(day, F.when(key % 5 != 0, F.concat(k, F.lit(".00"))), F.concat(_pick(SURNAMES, key), F.lit(" Олег")), F.when(key % 4 != 0, F.concat(F.lit("N"), k)))
    path = F.concat_ws("/", "o_orderpriority", "o_orderstatus", k)
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", planning.invoice_stem(F.when(key % 7 != 0, k), day, key % 3 + 1).alias("invoice"),
        planning.generic_stem(F.lit("act"), F.when(key % 7 != 0, k), F.when(key % 2 == 0, day), key % 3 + 1).alias("other"), receipt.alias("receipt"), planning.mirrored(path, "out").alias("folder"),
        planning.contains_path(F.concat(F.col("o_orderpriority"), F.lit("/F/")), path).alias("inside"),
    )


@query("""SELECT CAST(doc_id AS VARCHAR) AS rel_path, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS succeeded, CAST(greatest(doc_id % 11, doc_id % 13) AS BIGINT) AS entity_count, CAST(2 AS BIGINT) AS jobs FROM documents""")
def dual_output_jobs(spark, d):
    """Two jobs for each document; a failed one fails the file."""
    k = F.col("doc_id")
    job = lambda n, m: F.struct(F.when(k % n == 0, "broken").alias("error"), (k % m).alias("entity_count"))
    x = spark.read.parquet(f"{d}/documents.parquet").select(k.cast("string").alias("rel_path"), F.inline(F.array(job(7, 11), job(5, 13))))
    return planning.dual_outputs(x)
