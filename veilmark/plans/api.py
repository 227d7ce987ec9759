"""Public entry points: ``process`` documents, ``anonymize`` files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.text import natural_sort_key
from veilmark.operators import registry
from veilmark.operators.anonymize import anonymize_text, run_summary
from veilmark.operators.invoices import extract_invoices
from veilmark.operators.ordered import CONTINUATION, INHERITED, OTHER, PRIMARY, continue_runs
from veilmark.operators.planning import hashed_task_id
from veilmark.operators.purchases import extract_purchases
from veilmark.operators.receipts import extract_receipts
from veilmark.operators.rules import Rules
from veilmark.sources.files import decode_text, encode_text, scan
from veilmark.sources.packages import anonymize_packages
from veilmark.sources.sinks import write_csv_registry, write_workbook


@dataclass(frozen=True)
class DocumentType:
    """A registered type: how to extract rows and which registry they make."""

    key: str
    title: str
    extract: Callable[[DataFrame], DataFrame]
    register: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Result:
    """Lazy tables of a run; nothing ran before one of them is used."""

    documents: DataFrame
    registry: DataFrame
    summary: DataFrame


def _scanned(pages: DataFrame) -> DataFrame:
    """Invoices with continuations attached in natural order of their paths."""
    docs = extract_invoices(pages).withColumn(
        "kind", F.when(F.col("is_recognized"), PRIMARY).when(F.col("is_continuation_page"), CONTINUATION).otherwise(OTHER)
    ).withColumns({"folder": F.regexp_extract("rel_path", "^(.*?)[^/]*$", 1), "ord_key": natural_sort_key("rel_path")})
    docs = docs.withColumn("continued_from", F.when(F.col("kind") != CONTINUATION, F.col("rel_path")))
    filled = continue_runs(docs, ["folder"], ["ord_key", "rel_path"], [*INHERITED, "continued_from"])
    filled = filled.withColumn("continued_from", F.when(F.col("attached"), F.col("continued_from")))
    return filled.withColumns({"is_recognized": F.col("is_recognized") | F.col("attached"), "source_file": F.regexp_extract("rel_path", "([^/]*)$", 1)})


def _receipts(pages: DataFrame) -> DataFrame:
    return extract_receipts(pages).withColumn("source_file", F.regexp_extract("rel_path", "([^/]*)$", 1))


def _purchases(sources: DataFrame) -> DataFrame:
    docs = extract_purchases(sources).withColumn("source_file", F.col("rel_path"))
    # The hash of the file where the reader gives it, else of the whole text.
    own = F.col("content_hash") if "content_hash" in sources.columns else F.sha2(F.col("text").cast("binary"), 256)
    ids = sources.select("rel_path", hashed_task_id(F.col("rel_path"), own).alias("task_id"))
    return docs.drop("task_id").join(ids, "rel_path")


TYPES: dict[str, DocumentType] = {
    t.key: t
    for t in (
        DocumentType("upd_invoices_status_1", "Scanned transfer documents", _scanned, registry.invoice_registry),
        DocumentType("npd_receipts", "Receipts of the self-employed", _receipts, registry.receipt_registry),
        DocumentType("incoming_purchase_documents", "Electronic transfer documents", _purchases, registry.document_rows),
    )
}


def document_type(key: str) -> DocumentType:
    found = TYPES.get(key.strip().lower())
    if found is None:
        raise ValueError(f"unknown document type {key!r}; known: {sorted(TYPES)}")
    return found


def process(inputs: DataFrame, key: str) -> Result:
    """Extracts documents of a type from recognised pages or read sources."""
    kind = document_type(key)
    docs = kind.extract(inputs)
    with_error = docs if "error" in docs.columns else docs.withColumn("error", F.lit(None).cast("string"))
    return Result(with_error, kind.register(with_error), registry.processing_summary(with_error))


def write_registry(result: Result, key: str, path: str | Path) -> None:
    """A CSV for scans, a workbook for receipts, a task workbook for purchases."""
    if document_type(key).key == "upd_invoices_status_1":
        write_csv_registry(result.registry, path)
    elif key == "npd_receipts":
        write_workbook({"Registry": result.registry}, path, {"Registry": registry.RECEIPT_COLUMNS})
    else:
        frames = {"Documents": result.registry, "Items": registry.item_rows(result.documents), "Review": registry.review_rows(result.documents)}
        heads = {"Documents": registry.DOCUMENT_COLUMNS, "Items": registry.ITEM_COLUMNS, "Review": registry.REVIEW_COLUMNS}
        write_workbook(frames, path, heads, registry.METADATA)


def anonymize(spark: SparkSession, source: str, rules: Rules | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, summary) for the text, DOCX and XLSX files below a folder.

    Results: rel_path, content, entity_count, error.  A file that fails doesn't stop
    others; files of other kinds are failed rows.
    """
    files = scan(spark, source, exclude=exclude)
    decoded = decode_text(files.where("suffix = '.txt'"))
    texts = anonymize_text(decoded.where("error is null"), rules)
    as_bytes = encode_text(F.col("masked"), F.col("encoding"))
    nothing = F.lit(None).cast("binary").alias("content")
    done = texts.select("rel_path", as_bytes.alias("content"), F.col("entity_count").cast("long").alias("entity_count"), F.lit(None).cast("string").alias("error"))
    bad = decoded.where("error is not null").select("rel_path", nothing, F.lit(0).cast("long").alias("entity_count"), "error")
    other = files.where(~F.col("suffix").isin(".txt", ".docx", ".xlsx")).select(
        "rel_path", nothing, F.lit(0).cast("long").alias("entity_count"), F.lit("files of this kind need an external provider").alias("error")
    )
    results = done.union(bad).union(other).union(anonymize_packages(files, rules))
    return results, run_summary(results)
