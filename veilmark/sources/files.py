"""Files as DataFrames: scans with exclusions, text decoding, documents as text."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.planning import contains_path

#: Suffixes by kind of source (fixed values).
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff"]
DOCUMENT_SUFFIXES = [".pdf", ".docx"]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RECEIPT_HOST = "lknpd.nalog.ru"
RECEIPT_PATH = r"(?i)^/api/v1/receipt/([0-9]{10,12})/([^/]+)/print/?$"


def scan(spark: SparkSession, root: str, suffixes: list[str] | None = None, exclude: list[str] | None = None, content: bool = True) -> DataFrame:
    """(path, rel_path, suffix, length, content) of files below ``root``.

    Folders in ``exclude`` are left out whole.  Without ``content`` bytes aren't read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = F.regexp_replace("path", r"^file:/*", "/")
    base = root.removeprefix("file://").rstrip("/")
    out = raw.withColumn("path", clean).withColumn("rel_path", F.substring("path", len(base) + 2, 4096))
    out = out.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    if suffixes:
        out = out.where(F.col("suffix").isin([s.lower() for s in suffixes]))
    for e in exclude or []:
        out = out.where(~contains_path(e.removeprefix("file://"), F.col("path")))
    return out.select("path", "rel_path", "suffix", "length", *(["content"] if content else []))


def decode_text(files: DataFrame) -> DataFrame:
    """Adds text, encoding and error: UTF-8 with a mark, or without one, else Windows-1251."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b["content"]:
                found = (None, None, "the text is neither UTF-8 nor Windows-1251")
                for name in ("utf-8-sig",) if raw.startswith(b"\xef\xbb\xbf") else ("utf-8", "cp1251"):
                    try:
                        found = (raw.decode(name), name, None)
                        break
                    except UnicodeDecodeError:
                        continue
                rows.append(found)
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=["text", "encoding", "error"])], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{kinds}, text string, encoding string, error string")


#: The upper half of Windows-1251, and the characters of the same codes in Latin-1.
_CP1251 = "".join(bytes([b]).decode("cp1251", "ignore") for b in range(128, 256))
_LATIN1 = _CP1251.encode("cp1251").decode("latin-1")


def encode_text(text: Column, encoding: Column) -> Column:
    """The bytes of a text in the encoding that :func:`decode_text` found.

    A text that Windows-1251 can't hold (a mask may not be in it) becomes UTF-8 with a mark.
    """
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))
    fits = ~text.rlike(f"[^\\x00-\\x7f{_CP1251}]")
    narrow = F.encode(F.when(fits, F.translate(text, _CP1251, _LATIN1)), "ISO-8859-1")
    return F.when(encoding == "utf-8-sig", marked).when(encoding == "cp1251", F.coalesce(narrow, marked)).otherwise(F.encode(text, "UTF-8"))


def docx_content(raw: bytes) -> tuple[str, list[list[list[str]]]]:
    """Text and tables of a DOCX package."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    paragraphs = [p.strip() for p in (text_of(e) for e in body.findall(f"{W}p")) if p.strip()]
    tables = [
        [[" ".join(" ".join(text_of(p) for p in c.iter(f"{W}p")).split()) for c in r.findall(f"{W}tc")] for r in t.findall(f"{W}tr")]
        for t in body.findall(f"{W}tbl")
    ]
    rows = [" | ".join(c for c in r if c) for t in tables for r in t]
    return "\n".join([*paragraphs, *rows]), tables


def read_documents(files: DataFrame) -> DataFrame:
    """(rel_path, text, tables, page_count, used_ocr, warnings, content_hash) of DOCX files.

    A package that can't be read gives a row with a warning.  PDF text comes from a
    provider table of the same columns (see :func:`with_provider`).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rel, raw in zip(b["rel_path"], b["content"], strict=True):
                try:
                    text, tables = docx_content(raw)
                    rows.append((rel, text, tables, 1, False, [], hashlib.sha256(raw).hexdigest()))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                    rows.append((rel, None, [], 0, False, [f"The file can't be read: {type(e).__name__}"], hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["rel_path", "text", "tables", "page_count", "used_ocr", "warnings", "content_hash"])

    return files.where(F.col("suffix") == ".docx").select("rel_path", "content").mapInPandas(
        run, "rel_path string, text string, tables array<array<array<string>>>, page_count int, used_ocr boolean, warnings array<string>, content_hash string"
    )


def page_text(native: Column, recognised: Column, least: int = 20, deep: bool = False) -> Column:
    """A page's own text, joined by recognised text where it is short or asked for."""
    use = (F.length(F.trim(F.coalesce(native, F.lit("")))) < least) | F.lit(deep)
    both = F.concat_ws("\n", F.nullif(F.trim(F.coalesce(native, F.lit(""))), F.lit("")), F.nullif(F.trim(recognised), F.lit("")))
    return F.when(use, both).otherwise(native)


def with_provider(own: DataFrame, provided: DataFrame) -> DataFrame:
    """Own readings and those of an external provider; own ones win."""
    return own.unionByName(provided.join(own.select("rel_path"), "rel_path", "left_anti").select(*own.columns))


def receipt_link(url: Column) -> Column:
    """struct(url, issuer_inn, receipt_number) of an official receipt's address."""
    u = F.trim(url)
    host = F.regexp_extract(u, r"(?i)^https?://([^/:?#@]+)(?::[0-9]+)?(?:[/?#]|$)", 1)
    path = F.regexp_extract(u, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    ok = (F.lower(host) == RECEIPT_HOST) & decoded.rlike(RECEIPT_PATH)
    return F.when(ok, F.struct(u.alias("url"), F.regexp_extract(decoded, RECEIPT_PATH, 1).alias("issuer_inn"), F.regexp_extract(decoded, RECEIPT_PATH, 2).alias("receipt_number")))
