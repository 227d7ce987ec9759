"""Extraction rules on small made-up documents, with their expected fields as SQL."""

from __future__ import annotations

from collections.abc import Callable

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.invoices import extract_invoices
from veilmark.operators.purchases import extract_items, extract_purchases
from veilmark.operators.receipts import extract_receipts, service

from .test_queries import canonical

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_RECEIPT = """Мой налог
Чек № А12-345 от 05.04.2024

Сидорова Мария Ивановна
ИНН 123456789012

Наименование услуги: Верстка брошюры
Итого: 12 500,00 руб.

Покупатель ООО Ромашка
ИНН 7701234567
Налог на профессиональный доход"""

_SPLIT = """Чек № 77-1 дата 1.2.25
Петренко
Олег Павлович
ИНН 210987654321
самозанятый
1 000,00
900,50"""


def receipt_pages(spark: SparkSession) -> DataFrame:
    rows = [("a.jpg", _RECEIPT), ("b.jpg", _SPLIT), ("c.jpg", "просто текст")]
    return spark.createDataFrame(rows, "rel_path string, text string").withColumns(
        {"header_text": F.lit(""), "targeted_text": F.lit(""), "rotation": F.lit(0)}
    )


def fixture_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extract_receipts(receipt_pages(spark))
    blank = lambda c: F.coalesce(F.col(c), F.lit("-")).alias(c)
    columns = ["document_number", "document_date", "issuer_name", "issuer_inn", "recipient_name", "recipient_inn", "total_amount", "description"]
    return x.select("rel_path", "is_recognized", *[blank(c) for c in columns], "confidence")


ORACLES["fixture_receipts"] = """SELECT * FROM (VALUES
 ('a.jpg', true, 'А12-345', '05-04-2024', 'Сидорова Мария Ивановна', '123456789012', 'ООО Ромашка', '7701234567', '12500.00', 'Верстка брошюры', CAST(100 AS INTEGER)),
 ('b.jpg', true, '77-1', '01-02-2025', 'Петренко Олег Павлович', '210987654321', '-', '-', '900.50', '-', 100),
 ('c.jpg', false, '-', '-', '-', '-', '-', '-', '-', '-', 0))
 v(rel_path, is_recognized, document_number, document_date, issuer_name, issuer_inn, recipient_name, recipient_inn, total_amount, description, confidence)"""

_PURCHASE = """Универсальный передаточный документ Статус: 1
Счет-фактура № УП-17 от 12.03.2024
Продавец: ООО Вектор Адрес: Москва
ИНН/КПП продавца: 7701234567/770101001
Покупатель: ООО Клён Адрес: Тверь
ИНН/КПП покупателя: 6901234567/690101001"""
_HEADER = ["Наименование товара (работ)", "Единица измерения", "Количество", "Цена за единицу", "Стоимость без налога", "Налоговая ставка", "Сумма налога", "Стоимость с налогом"]
_TABLE = [
    _HEADER, ["1", "2", "3", "4", "5", "6", "7", "8"],
    ["Бумага", "шт", "2,00", "1000,00", "2000,00", "20%", "400,00", "2400,00"],
    ["Ручка", "796", "3", "10,00", "31,00", "20%", "6,00", "36,00"],
    ["Итого", "", "", "", "2 031,00", "", "406,00", "2 436,00"],
]


def purchase_sources(spark: SparkSession) -> DataFrame:
    rows = [
        ("a.docx", _PURCHASE, [_TABLE], 1, False, []),
        ("b.docx", "Универсальный передаточный документ статус 2 счет-фактура", [], 1, False, []),
    ]
    return spark.createDataFrame(rows, "rel_path string, text string, tables array<array<array<string>>>, page_count int, used_ocr boolean, warnings array<string>")


def fixture_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extract_purchases(purchase_sources(spark))
    blank = lambda c: F.coalesce(F.col(c), F.lit("-")).alias(c)
    columns = ["status", "document_number", "document_date", "issuer_name", "issuer_inn", "issuer_kpp", "recipient_name", "total_amount", "description"]
    return x.select("rel_path", "is_recognized", *[blank(c) for c in columns], F.size("items").alias("n_items"), "confidence", F.array_join("warnings", "|").alias("warnings"), "requires_review")


ORACLES["fixture_purchases"] = """SELECT * FROM (VALUES
 ('a.docx', true, '1', 'УП-17', '12-03-2024', 'ООО Вектор', '7701234567', '770101001', 'ООО Клён', '2436.00', 'Бумага; Ручка', CAST(2 AS INTEGER), CAST(100 AS INTEGER), '', true),
 ('b.docx', false, '2', '-', '-', '-', '-', '-', '-', '-', '-', 0, 40, 'The file contains explicit UPD status 2|Missing required document number|Missing required document date|Missing required seller INN|Missing required total amount|No goods or service rows were extracted', true))
 v(rel_path, is_recognized, status, document_number, document_date, issuer_name, issuer_inn, issuer_kpp, recipient_name, total_amount, description, n_items, confidence, warnings, requires_review)"""


def fixture_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = extract_items(purchase_sources(spark))
    return items.select("rel_path", "line_number", "name", F.coalesce("unit", F.lit("-")).alias("unit"), "quantity", "total_amount", F.array_join("warnings", "|").alias("warnings"))


ORACLES["fixture_items"] = """SELECT * FROM (VALUES
 ('a.docx', CAST(1 AS INTEGER), 'Бумага', 'шт', '2.00', '2400.00', ''),
 ('a.docx', 2, 'Ручка', '-', '3.00', '36.00', 'Text unit name was not extracted; numeric OKEI code was ignored|Quantity multiplied by price does not match line amount|Line amount plus VAT does not match line total'))
 v(rel_path, line_number, name, unit, quantity, total_amount, warnings)"""

_INVOICE = """Счет-фактура № 511 от 21 марта 2023 г.
Универсальный передаточный документ
Продавец: ООО Путь (перевозки)
ИНН / КПП продавца 7701234567 / 770101001
ИНН / КПП покупателя 6901234567 / 690101001
Транспортно-экспедиционные услуги по заявке № 18 от 01.03.2023 а/м Скания А123 Погрузка 02.03.2023 09:30 разгрузка 03.03.2023 18:00 Всего к оплате
10 000,00 2 000,00 12 000,00"""
_SECOND = """Наименование экономического субъекта составителя документа
подпись М.П."""


def invoice_pages(spark: SparkSession) -> DataFrame:
    rows = [("1.jpg", _INVOICE, {}, "1"), ("2.jpg", _SECOND, {}, None), ("3.jpg", "счет фактура № 51123 универсальный", {"shipment_document_text_from_crop": "№ п/п 1 № 511 от 21 марта 2023 г."}, "1")]
    return spark.createDataFrame(rows, "rel_path string, text string, targeted map<string,string>, status string").withColumn("header_text", F.lit(""))


def fixture_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extract_invoices(invoice_pages(spark))
    blank = lambda c, n: F.coalesce(F.col(c), F.lit("-")).alias(n)
    return x.select(
        "rel_path", "is_recognized", "is_continuation_page", blank("document_number", "document_number"), blank("document_date", "document_date"), blank("issuer_name", "issuer_name"),
        blank("issuer_inn", "issuer_inn"), blank("total_amount", "total_amount"), blank("transport.vehicle", "vehicle"), blank("transport.loading", "loading"), "confidence", F.array_join("warnings", "|").alias("warnings"),
    )


ORACLES["fixture_invoices"] = """SELECT * FROM (VALUES
 ('1.jpg', true, false, '511', '21-03-2023', 'ООО Путь', '7701234567', '12000.00', 'Скания А123', '02-03-2023 09:30', CAST(100 AS INTEGER), ''),
 ('2.jpg', false, true, '-', '-', '-', '-', '-', '-', '-', 90, ''),
 ('3.jpg', true, false, '511', '21-03-2023', '-', '-', '-', '-', '-', 75, 'document_number_replaced_by_shorter_fallback_prefix'))
 v(rel_path, is_recognized, is_continuation_page, document_number, document_date, issuer_name, issuer_inn, total_amount, vehicle, loading, confidence, warnings)"""

for _f in (fixture_receipts, fixture_purchases, fixture_items, fixture_invoices):
    QUERIES[_f.__name__] = _f


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_fixture(spark, name):
    assert canonical(QUERIES[name](spark, "").toPandas()) == canonical(duckdb.sql(ORACLES[name]).df())


def test_words_that_end_a_description(spark):
    """Only whole words end it."""
    text = "Услуга:\nчековый принтер\nценаметр\nЧек № 1"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(service(F.col("t")).alias("s")).first().s == "чековый принтер ценаметр"
