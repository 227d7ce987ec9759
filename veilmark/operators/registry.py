"""Registries: rows for accountants, projected from documents and their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.text import inline_whitespace

#: Column orders and headers of the registries (fixed values).
INVOICE_COLUMNS = ["source_file", "destination_file", "document_type", "is_recognized", "is_continuation_page", "continued_from", "status", "document_number", "document_date", "document_datetime", "rotation_degrees", "issuer_name", "issuer_inn", "issuer_kpp", "recipient_name", "recipient_inn", "recipient_kpp", "amount_without_tax", "tax_amount", "total_amount", "currency", "description", "confidence", "warnings", "error", "text_preview", "request_number", "request_date", "vehicle", "loading_datetime", "unloading_datetime"]
RECEIPT_COLUMNS = {"target_file_name": "target_file_name", "source_file_name": "source_file_name", "receipt_date": "дата", "amount": "сумма", "payee_name": "фио получателя суммы", "receipt_number": "номер_чека", "payee_inn": "ИНН получателя", "generation_comments": "комментарии о генерации"}
DOCUMENT_COLUMNS = {"processed": "обработано", "task_id": "task_id", "source_file": "исходный файл", "source_document": "открыть документ", "is_recognized": "УПД распознан", "status": "статус УПД", "document_number": "номер", "document_date": "дата", "issuer_name": "продавец", "issuer_inn": "ИНН продавца", "issuer_kpp": "КПП продавца", "recipient_name": "покупатель", "recipient_inn": "ИНН покупателя", "recipient_kpp": "КПП покупателя", "amount_without_tax": "сумма без НДС", "tax_amount": "сумма НДС", "total_amount": "сумма с НДС", "currency": "валюта", "item_count": "позиций", "requires_review": "требует проверки", "confidence": "уверенность", "generation_comments": "комментарии"}
ITEM_COLUMNS = {"task_id": "task_id", "document_number": "номер УПД", "document_date": "дата УПД", "line_number": "№ строки", "name": "наименование товара/услуги", "unit": "единица измерения", "quantity": "количество", "unit_price": "цена за единицу", "amount_without_tax": "сумма без НДС", "tax_rate": "ставка НДС", "tax_amount": "сумма НДС", "total_amount": "сумма с НДС", "requires_review": "требует проверки", "generation_comments": "комментарии"}
REVIEW_COLUMNS = {"task_id": "task_id", "source_file": "исходный файл", "source_document": "открыть документ", "document_number": "номер", "issue_scope": "область", "issue": "проблема"}
METADATA = {"registry_schema": "incoming_purchase_documents_tasks", "registry_schema_version": "2", "document_type": "incoming_purchase_documents"}
YES, NO = "да", "нет"


def _flag(c: Column) -> Column:
    return F.when(c, YES).otherwise(NO)


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def checked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Declared columns in order, missing ones empty; undeclared ones are an error."""
    if len(set(columns)) != len(columns) or not columns or any(not c.strip() for c in columns):
        raise ValueError("columns must be named once each")
    if extra := set(df.columns) - set(columns):
        raise ValueError(f"undeclared columns: {sorted(extra)}")
    return df.select(*[_text(df, c).alias(c) for c in columns])


def _issues(df: DataFrame) -> Column:
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array_compact(F.array(error)))


def invoice_registry(docs: DataFrame) -> DataFrame:
    """All pages; unrecognised ones carry five columns only."""
    kept = {"source_file", "document_type", "is_recognized", "warnings", "error"}
    values = {c: _text(docs, c) for c in INVOICE_COLUMNS}
    values |= {
        "warnings": F.array_join("warnings", " | "),
        "is_recognized": F.col("is_recognized").cast("int").cast("string"),
        "document_type": F.coalesce(F.nullif(_text(docs, "document_type"), F.lit("")), F.lit("upd_invoices_status_1")),
    }
    if "is_continuation_page" in docs.columns:
        values["is_continuation_page"] = F.col("is_continuation_page").cast("int").cast("string")
    return docs.select(*[(v if c in kept else F.when(F.col("is_recognized"), v).otherwise("")).alias(c) for c, v in values.items()])


def receipt_registry(docs: DataFrame) -> DataFrame:
    """Recognised receipts only; comments are the warnings and the error."""
    date = F.coalesce(F.nullif(_text(docs, "document_date"), F.lit("")), _text(docs, "document_datetime"))
    return docs.where("is_recognized").select(
        _text(docs, "destination_file").alias("target_file_name"), _text(docs, "source_file").alias("source_file_name"), date.alias("receipt_date"),
        _text(docs, "total_amount").alias("amount"), _text(docs, "issuer_name").alias("payee_name"), _text(docs, "document_number").alias("receipt_number"),
        _text(docs, "issuer_inn").alias("payee_inn"), F.array_join(_issues(docs), "; ").alias("generation_comments"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    values = {c: _text(docs, c) for c in DOCUMENT_COLUMNS}
    values |= {
        "processed": F.lit("Нет"), "source_document": F.regexp_extract(_text(docs, "source_file"), "([^/]*)$", 1), "is_recognized": _flag(F.col("is_recognized")),
        "currency": F.coalesce(F.nullif(_text(docs, "currency"), F.lit("")), F.lit("RUB")), "item_count": F.size("items"),
        "requires_review": _flag(F.col("requires_review")), "confidence": F.col("confidence"), "generation_comments": F.array_join(_issues(docs), "; "),
    }
    return docs.select(*[v.alias(c) for c, v in values.items()])


def item_rows(docs: DataFrame) -> DataFrame:
    x = docs.select("task_id", "document_number", "document_date", F.explode("items").alias("i")).select(
        "task_id", "document_number", "document_date", "i.*"
    )
    values = {c: _text(x, c) for c in ITEM_COLUMNS} | {
        "line_number": F.col("line_number"), "requires_review": _flag(F.size("warnings") > 0), "generation_comments": F.array_join("warnings", "; "),
    }
    return x.select(*[v.alias(c) for c, v in values.items()])


def review_rows(docs: DataFrame) -> DataFrame:
    """One row per issue of a document or of one of its items."""
    head = ["task_id", "source_file", "document_number"]
    of_docs = docs.select(*head, F.lit("document").alias("issue_scope"), F.explode(_issues(docs)).alias("issue"))
    items = docs.select(*head, F.explode("items").alias("i"))
    scope = F.concat(F.lit("item "), F.coalesce(F.col("i.line_number").cast("string"), F.lit("-")))
    of_items = items.select(*head, scope.alias("issue_scope"), F.explode("i.warnings").alias("issue"))
    x = of_docs.unionByName(of_items)
    values = {c: _text(x, c) for c in REVIEW_COLUMNS} | {"source_document": F.regexp_extract(_text(x, "source_file"), "([^/]*)$", 1)}
    return x.select(*[v.alias(c) for c, v in values.items()])


def event_log(results: DataFrame, order: str) -> DataFrame:
    """Events of a run in order: two per file, without any content."""
    events = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("file_started").alias("event")),
        F.struct(F.lit(1).alias("step"), F.when(F.col("error").isNull(), "file_completed").otherwise("file_failed").alias("event")),
    )
    return results.select(F.col(order).alias("file_no"), "rel_path", F.explode(events).alias("e")).select("file_no", "rel_path", "e.step", "e.event")


def processing_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("is_recognized")).alias("recognized"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )


def external_link(target: Column, workbook_dir: str) -> Column:
    """A link that stays valid when the folder moves, else an absolute one."""
    base = workbook_dir.rstrip("/") + "/"
    return F.concat(F.lit("external:"), F.when(target.startswith(base), F.substring(target, len(base) + 1, 4096)).otherwise(target))


def clean_cell(c: Column | str) -> Column:
    return inline_whitespace(c)
