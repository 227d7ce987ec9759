"""Scalars, extraction, layout, planning, packages and the public entry points."""

from __future__ import annotations

import csv
import io
import random
import uuid
import zipfile
from statistics import median
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from veilmark.functions import dates, money, text
from veilmark.operators import invoices, layout, ordered, planning, purchases, registry
from veilmark.operators.rules import Rules
from veilmark.plans import api, documents
from veilmark.operators.anonymize import anonymize_text
from veilmark.sources import files, packages, sinks

from . import test_fixtures as fixtures


def value(spark, column, **columns):
    row = spark.range(1)
    for k, v in columns.items():
        row = row.withColumn(k, F.lit(v) if v is not None else F.lit(None).cast("string"))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("05.04.2024", "05-04-2024"), ("5/4/24 г.", "05-04-2024"), ("3 августа 2023 года", "03-08-2023"), ("31 февраля 2024", "31-02-2024"), ("32.01.2024", None), ("1 мартобря 2024", None), ("01.01.1999", None), (None, None), ("", None)],
)
def test_strict_date(spark, raw, want):
    assert value(spark, dates.strict_date("c"), c=raw) == want


def test_loose_dates(spark):
    assert value(spark, dates.invoice_date("c"), c="21 марга 2023") == "21-03-2023"
    assert value(spark, dates.mixed_text_date("c"), c="стр 7\nапреля\n14\n2024 год") == "14-04-2024"
    assert value(spark, dates.padded_date("c"), c="1.2.25") == "01-02-2025"


def test_money(spark):
    assert value(spark, money.strict_money("c"), c="1 234 567,5") == "1234567.5"
    assert value(spark, money.strict_money("c"), c="1,234") is None
    assert str(value(spark, money.rounded_money("c"), c="2,345")) == "2.34"
    assert value(spark, money.format_decimal(F.lit("2.355").cast("decimal(10,3)"), 2)) == "2.36"
    assert str(value(spark, money.parse_decimal("c", True), c="итого -12,5 руб")) == "-12.500000"


def test_names_and_keys(spark):
    assert value(spark, text.safe_filename("c"), c=' a<b> :"c".txt. ') == "a_b_c_.txt"
    assert value(spark, text.safe_filename("c"), c="...") == "document"
    df = spark.createDataFrame([("scan_10.jpg",), ("Scan_2.jpg",), ("scan_2a.jpg",)], "p string")
    assert [r.p for r in df.orderBy(text.natural_sort_key("p")).collect()] == ["Scan_2.jpg", "scan_2a.jpg", "scan_10.jpg"]
    assert value(spark, text.look_alike("c"), c="CTOЛ-Ё") == "столе"
    assert value(spark, planning.task_id(F.lit("a/b.docx"), F.lit("x"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a/b.docx:2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("511", "511", ("511", None)), ("5112", "511", ("511", "document_number_replaced_by_shorter_fallback_prefix")), ("511", "5112", ("511", "document_number_kept_as_shorter_header_prefix")),
     ("12", "345", ("345", "document_number_replaced_because_header_was_too_short")), (None, "7", ("7", "document_number_from_fallback")), ("43420", None, ("434", "trimmed_suspicious_trailing_digits")), (None, None, (None, None))],
)
def test_numbers(spark, a, b, want):
    assert tuple(value(spark, invoices.reconcile_number(F.col("a"), F.col("b")), a=a, b=b)) == want


def test_continuations_in_folders(spark):
    kinds = ["primary", "continuation", "continuation", "unrecognized", "continuation", "primary", "error", "continuation"]
    df = spark.createDataFrame([("f", k, v, None if v == "continuation" else f"n{k}", {"k": None} if k == 1 else {"k": "x"}) for k, v in enumerate(kinds)], "f string, i int, kind string, document_number string, extra map<string,string>")
    got = ordered.continue_runs(df, ["f"], ["i"], ["document_number"], "extra").orderBy("i").collect()
    assert [r.page_number for r in got] == [1, 2, 3, None, None, 1, None, None]
    assert [r.document_number for r in got][:5] == ["n0", "n0", "n0", "n3", None]
    assert got[1].extra == {"k": None}


def test_layout(spark):
    box = value(spark, layout.map_box(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(180), F.lit(100), F.lit(50)))
    assert tuple(box) == (96, 44, 3, 4)
    w = spark.createDataFrame([(1, 0, "Mr Jo", 0, 0, 5, 9.0), (1, 1, " ", 0, 0, 5, 9.0), (1, 2, "b", 9, 0, 5, 9.0), (1, 3, "c", 0, 30, 5, -1.0)], "p int, idx int, text string, left int, top int, height int, conf double")
    assert [(r.start, r.end) for r in layout.words_with_offsets(w, ["p"]).orderBy("idx").collect()] == [(0, 5), (6, 7)]
    lines = spark.createDataFrame([(1, 1, 0, 0, "Passenger name"), (1, 2, 0, 20, "SMITH JOHN MR"), (1, 3, 0, 500, "A B")], "p int, line_no int, left int, top int, text string")
    assert [r.text for r in layout.stacked_names(lines, ["p"]).collect()] == ["SMITH JOHN MR"]


def test_process_and_registries(spark, tmp_path):
    inv = api.process(fixtures.invoice_pages(spark), "upd_invoices_status_1")
    rows = {r.source_file: r for r in inv.registry.collect()}
    assert rows["2.jpg"].continued_from == "1.jpg" and rows["2.jpg"].document_number == "511"
    api.write_registry(inv, "upd_invoices_status_1", tmp_path / "r.csv")
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    table = list(csv.reader(io.StringIO(raw.decode("utf-8-sig")), delimiter=";"))
    assert table[0] == registry.INVOICE_COLUMNS and len(table) == 4
    rec = api.process(fixtures.receipt_pages(spark), "npd_receipts")
    assert rec.registry.count() == 2 and rec.summary.first().processed == 3
    api.write_registry(rec, "npd_receipts", tmp_path / "r.xlsx")
    pur = api.process(fixtures.purchase_sources(spark), " Incoming_Purchase_Documents ")
    api.write_registry(pur, "incoming_purchase_documents", tmp_path / "p.xlsx")
    with zipfile.ZipFile(tmp_path / "p.xlsx") as z:
        book = z.read("xl/workbook.xml").decode()
        assert 'name="Review"' in book and 'state="hidden"' in book
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
    with pytest.raises(ValueError):
        api.process(fixtures.receipt_pages(spark), "other")
    with pytest.raises(ValueError):
        registry.checked(rec.registry, ["a"])


def docx(paragraphs, table=()):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda runs: "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p([c])}</w:tc>" for c in r) + "</w:tr>" for r in table)
    body = "".join(map(p, paragraphs)) + (f"<w:tbl>{rows}</w:tbl>" if table else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {ns}><w:body>{body}</w:body></w:document>')
        z.writestr("docProps/core.xml", "<c><creator>Somebody</creator></c>")
    return out.getvalue()


def xlsx(shared, formula=""):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c><f>{formula}</f><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_anonymize_folder(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes("﻿почта x.y@mail.example.com".encode())
    (root / "b.txt").write_bytes("адрес 10.0.0.1".encode("cp1251"))
    (root / "b2.txt").write_bytes("чисто №5".encode("cp1251"))
    (root / "b3.txt").write_bytes(b"\xef\xbb\xbf\xcf\xf0")
    (root / "sub/c.docx").write_bytes(docx([["почта x.y@ma", "il.example.com!"], ["чисто"]], [["Имя", "10.0.0.1"]]))
    (root / "d.xlsx").write_bytes(xlsx(["x.y@mail.example.com", "чисто"]))
    (root / "e.xlsx").write_bytes(xlsx(["чисто"], '"10.0.0.1"'))
    (root / "f.docx").write_bytes(b"no package")
    (root / "g.bin").write_bytes(b"\x00")
    results, summary = api.anonymize(spark, f"file://{root}")
    got = {r.rel_path: r for r in results.collect()}
    assert got["a.txt"].content.startswith(b"\xef\xbb\xbf") and b"mail" not in got["a.txt"].content
    assert "10.0.0.1" not in got["b.txt"].content.decode() and got["b.txt"].entity_count == 1
    assert got["b2.txt"].content == "чисто №5".encode("cp1251") and got["b3.txt"].error
    with zipfile.ZipFile(io.BytesIO(got["sub/c.docx"].content)) as z:
        body = z.read("word/document.xml").decode()
        assert "mail" not in body and "10.0.0.1" not in body and "чисто" in body
        assert "Somebody" not in z.read("docProps/core.xml").decode()
    assert got["sub/c.docx"].entity_count == 2
    with zipfile.ZipFile(io.BytesIO(got["d.xlsx"].content)) as z:
        assert "mail" not in z.read("xl/sharedStrings.xml").decode()
    assert all(got[k].error and got[k].content is None for k in ("e.xlsx", "f.docx", "g.bin"))
    s = summary.first()
    assert (s.succeeded, s.failed, s.entities) == (5, 4, 5)
    written = sinks.write_files(results.where("error is null").select("rel_path", "content"), str(tmp_path / "out"))
    assert written.where("error is not null").count() == 0 and (tmp_path / "out/sub/c.docx").exists()
    with pytest.raises(ValueError):
        sinks.clear_folder(tmp_path, protect=root)
    assert sinks.clear_folder(tmp_path / "out") == 5


def test_read_docx_and_links(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(docx([["  Первый "], [""]], [["a", "b  c"]]))
    got = files.read_documents(files.scan(spark, f"file://{tmp_path}", [".docx"])).first()
    assert got.text == "Первый\na | b c" and got.tables == [[["a", "b c"]]]
    url = "http://lknpd.nalog.ru:8080/api/v1/receipt/1234567890/20%2Db/print"
    link = value(spark, files.receipt_link(F.lit(url)))
    assert (link.issuer_inn, link.receipt_number) == ("1234567890", "20-b")
    assert value(spark, files.receipt_link(F.lit("http://evil.ru/lknpd.nalog.ru/api/v1/receipt/1234567890/2/print"))) is None
    assert value(spark, files.page_text(F.lit("коротко"), F.lit("дольше прочитано"))) == "коротко\nдольше прочитано"


def test_unsafe_packages():
    refused = ("xl/pivotCache/a.xml", "xl/queryTables/a.xml", "xl/threadedComments/a.xml", "xl/persons/p.xml", "xl/connections.xml", "word/media/a.png")
    for name in ("../x.xml", "word/vbaProject.bin", "word/embeddings/a.xml", *refused):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, "x")
        with pytest.raises(packages.Unsafe):
            packages.open_package(out.getvalue())


def test_packages_hold_no_hidden_text(spark, tmp_path):
    """Links of documents go, headers of sheets and descriptions are cleaned."""
    rel = '<Relationships xmlns="r"><Relationship Id="1" TargetMode="External" Target="mailto:x.y@mail.example.com"/><Relationship Id="2" Target="a.xml"/></Relationships>'
    raw = io.BytesIO(docx([["чисто"]]))
    with zipfile.ZipFile(raw, "a") as z:
        z.writestr("word/_rels/document.xml.rels", rel)
        z.writestr("word/footnotes.xml", '<a descr="x.y@mail.example.com" email="x.y@mail.example.com"/>')
        z.writestr("docProps/custom.xml", "<a>x.y@mail.example.com</a>")
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    raw = io.BytesIO(xlsx(["чисто"]))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(raw, "a") as z:
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><headerFooter><firstHeader>x.y@mail.example.com</firstHeader></headerFooter></worksheet>")
        z.writestr("xl/charts/chart1.xml", '<c xmlns:a="a"><a:p><a:t>x.y@mail</a:t><a:t>.example.com</a:t></a:p><v>x.y@mail.example.com</v></c>')
    (tmp_path / "b.xlsx").write_bytes(raw.getvalue())
    got = {r.rel_path: r for r in packages.anonymize_packages(files.scan(spark, f"file://{tmp_path}"), Rules()).collect()}
    assert [got[k].error for k in ("a.docx", "b.xlsx")] == [None, None] and got["b.xlsx"].entity_count == 3
    for r in got.values():
        with zipfile.ZipFile(io.BytesIO(r.content)) as z:
            assert [n for n in z.namelist() if b"mail.example" in z.read(n) or b"x.y" in z.read(n)] == []


MAIL = "x.y@mail.example.com"
W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
SAFE_PARTS = {
    "deleted text": ("word/footnotes.xml", f"<w:x {W_NS}><w:p><w:r><w:delText>{MAIL}</w:delText></w:r></w:p></w:x>"),
    "field": ("word/footnotes.xml", f'<w:x {W_NS}><w:p><w:r><w:instrText>HYPERLINK "mailto:{MAIL}"</w:instrText></w:r></w:p></w:x>'),
    "alias": ("word/footnotes.xml", f'<w:x {W_NS}><w:sdt><w:sdtPr><w:alias w:val="{MAIL}"/><w:tag w:val="{MAIL}"/></w:sdtPr></w:sdt></w:x>'),
    "odd name": ("word/mystyles.xml", f"<w:x {W_NS}><w:p><w:r><w:t>{MAIL}</w:t></w:r></w:p></w:x>"),
}
REFUSED_PARTS = {
    "simple field": ("word/footnotes.xml", f'<w:x {W_NS}><w:fldSimple w:instr="mailto:{MAIL}"/></w:x>'),
    "style": ("word/styles.xml", f'<w:x {W_NS}><w:name w:val="{MAIL}"/></w:x>'),
    "table": ("xl/tables/table1.xml", f'<table {S_NS} name="T" displayName="{MAIL}"/>'),
    "column": ("xl/tables/table1.xml", f'<table {S_NS} name="T"><tableColumns><tableColumn name="{MAIL}"/></tableColumns></table>'),
    "link": ("xl/worksheets/sheet2.xml", f'<worksheet {S_NS}><hyperlinks><hyperlink display="{MAIL}" location="S!A1"/></hyperlinks></worksheet>'),
    "place": ("xl/worksheets/sheet2.xml", f'<worksheet {S_NS}><hyperlinks><hyperlink display="x" location="{MAIL}"/></hyperlinks></worksheet>'),
    "prompt": ("xl/worksheets/sheet2.xml", f'<worksheet {S_NS}><dataValidations><dataValidation prompt="write to {MAIL}" error="{MAIL}"/></dataValidations></worksheet>'),
    "stray text": ("xl/worksheets/sheet2.xml", f"<worksheet {S_NS}><extLst>{MAIL}</extLst></worksheet>"),
}


def test_every_part_of_a_package_is_read(spark, tmp_path):
    """Texts are rewritten or cleared wherever they stand; what can't be changed fails the file."""
    for name, (part, body) in (SAFE_PARTS | REFUSED_PARTS).items():
        docx_part = part.startswith("word/")
        raw = io.BytesIO(docx([["чисто"]]) if docx_part else xlsx(["чисто"]))
        with zipfile.ZipFile(raw, "a") as z:
            z.writestr(part, body)
        (tmp_path / f"{name}.{'docx' if docx_part else 'xlsx'}").write_bytes(raw.getvalue())
    got = {r.rel_path.rsplit(".", 1)[0]: r for r in packages.anonymize_packages(files.scan(spark, f"file://{tmp_path}"), Rules()).collect()}
    assert {k for k, r in got.items() if r.error} == set(REFUSED_PARTS) and len(got) == len(SAFE_PARTS) + len(REFUSED_PARTS)
    for name in SAFE_PARTS:
        with zipfile.ZipFile(io.BytesIO(got[name].content)) as z:
            assert [n for n in z.namelist() if MAIL.encode() in z.read(n)] == [], name


def test_median_lines_equal_a_loop(spark):
    """Words with any centres: the nearest line by median, the first of equals, a new one beyond the tolerance."""
    rng = random.Random(7)
    rows = [(p, i, rng.choice(["a", "b c", " "]), rng.randint(0, 90), rng.randint(0, 60), 5, rng.choice([4, 8, 8, 20])) for p in range(6) for i in range(rng.randint(0, 60))]
    df = spark.createDataFrame(rows, "p int, idx int, text string, left int, top int, width int, height int")
    got = {}
    for r in layout.lines_by_medians(df, ["p"]).orderBy("p", "line_no").collect():
        got.setdefault(r.p, []).append((r.top, r.left, r.right, r.bottom, r.text))
    for p in range(6):
        lines = []
        for w in sorted((r for r in rows if r[0] == p and r[2].strip()), key=lambda r: (r[4], r[3], r[1])):
            centre, best, near = w[4] + w[6] / 2, None, None
            for line in lines:
                d = abs(centre - median(x[4] + x[6] / 2 for x in line))
                if d <= max(5.0, median(x[6] for x in line) * 0.65, w[6] * 0.65) and (near is None or d < near):
                    best, near = line, d
            if best is None:
                lines.append([w])
            else:
                best.append(w)
        want = [(min(x[4] for x in line), min(x[3] for x in line), max(x[3] + 5 for x in line), max(x[4] + x[6] for x in line), " ".join(x[2] for x in sorted(line, key=lambda x: (x[3], x[1])))) for line in lines]
        assert sorted(got.get(p, [])) == sorted(want) and [g[:2] for g in got.get(p, [])] == sorted(w[:2] for w in want)


@pytest.mark.parametrize("name", ["lines_by_ids", "lines_by_geometry", "lines_by_medians"])
def test_lines_of_pages_need_no_shuffle(spark, name):
    rng = random.Random(5)
    rows = [(p, i, rng.choice(["a", "bc", "d"]), rng.randint(0, 90), rng.randint(0, 60), 5, rng.choice([4, 8, 8, 20]), rng.choice([1, None]), 1, rng.randint(0, 3)) for p in range(6) for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "p int, idx int, text string, left int, top int, width int, height int, block int, par int, line int")
    pages = df.groupBy("p").agg(F.collect_list(F.struct(*df.columns[1:])).alias("words")).localCheckpoint()
    lines = getattr(layout, name)
    got = lines(pages, ["p"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, lines(df, ["p"]).collect()))
    if name == "lines_by_geometry":
        for p in range(6):
            words, made = sorted((r for r in rows if r[0] == p), key=lambda r: (r[4], r[3], r[1])), []
            for w in words:
                centre = w[4] + w[6] / 2
                near = [x for x in made if abs(sum(v[4] + v[6] / 2 for v in x) / len(x) - centre) <= max(6.0, w[6] * 0.65, max(v[6] for v in x) * 0.65)]
                (near[-1] if near else made.append([]) or made[-1]).append(w)
            assert [r.text for r in got.where(F.col("p") == p).orderBy("line_no").collect()] == [" ".join(w[2] for w in sorted(x, key=lambda w: (w[3], w[1]))) for x in made]
    if name == "lines_by_ids":
        for p in range(6):
            made = {}
            for w in sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[1])):
                made.setdefault(w[7:], []).append(w)
            want = sorted((min(w[4] for w in x), x[0][3], (k[0] or 0), k[2], " ".join(w[2] for w in x)) for k, x in made.items())
            assert [(r.top, r.left, r.block or 0, r.line, r.text) for r in got.where(F.col("p") == p).orderBy("line_no").collect()] == want


def test_no_text_is_too_long(spark):
    rows = [("x@" + "a." * 100_000 + "com",), ("7" * 100_000,), ("x" * 1_000_000,), ("+1" + " 22" * 50_000,)]
    out = anonymize_text(spark.createDataFrame(rows, "text string")).collect()
    assert len(out) == 4


def test_collisions(spark):
    df = spark.createDataFrame([(1, "f", "a.txt"), (2, "f", "a.txt"), (3, "f", "a_2.txt"), (4, "g", "a.txt")], "i int, f string, n string")
    got = [r.destination for r in planning.number_collisions(df, "f", "n", "i").orderBy("i").collect()]
    assert got == ["a.txt", "a_2.txt", "a_2_2.txt", "a.txt"]
    names = ["A.txt", "a.txt", "a_3.txt", "a.txt", None, "b", "b", "a_2.txt", "a.txt"]
    df = spark.createDataFrame([(k, "f", n) for k, n in enumerate(names)], "i int, f string, n string").repartition(3)
    got = [r.destination for r in planning.number_collisions(df, "f", "n", "i").orderBy("i").collect()]
    assert got == ["A.txt", "a_2.txt", "a_3.txt", "a_4.txt", None, "b", "b_2", "a_2_2.txt", "a_5.txt"]


def test_rules_replace_over_runs(spark, tmp_path):
    (tmp_path / "r.docx").write_bytes(docx([["ком", "панияX дом"]]))
    out = packages.anonymize_packages(files.scan(spark, f"file://{tmp_path}"), Rules(replacements=(("компанияX", "компанияY"),))).first()
    with zipfile.ZipFile(io.BytesIO(out.content)) as z:
        assert "".join(packages._texts("docx", "", ElementTree.fromstring(z.read("word/document.xml")))[0][k].text for k in (0, 1)) == "компанияY дом"


def test_no_expression_of_an_invoice_holds_copies_of_another(spark):
    pages = spark.createDataFrame([("a", "Счет-фактура № 12 от 2 мая 2023 г.", "", {}, "1")], "rel_path string, text string, header_text string, targeted map<string,string>, status string")
    plan = invoices.extract_invoices(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") < 300


@pytest.mark.parametrize("pages", [documents.receipt_pages, documents.invoice_pages])
def test_pages_of_a_small_table_are_read_by_many_tasks(spark, pages):
    assert pages(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= 4


def test_cells_of_tables_are_shuffled_once(spark):
    sources = spark.createDataFrame([("a", [[["x", "y"], ["1", "2"]]])], "rel_path string, tables array<array<array<string>>>")
    items, _ = purchases.extract_items(sources)
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4


_PURCHASE_HEADER = ["Наименование товара", "Количество (объём)", "Цена за единицу", "Сумма налога"]


def test_tables_of_documents_are_read_where_they_stand(spark):
    """Neither cells nor items are shuffled, and the documents lie in many pieces."""
    sources = documents.purchase_sources(spark, "/root/testdata/sf0.001")
    assert sources.rdd.getNumPartitions() >= 4
    for x in (purchases.extract_items(sources)[0], purchases.extract_purchases(sources)):
        assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()


def test_headers_of_many_rows(spark):
    line = ["Перо", "2", "1,50", "0,60"]
    tables = {
        "one row": [_PURCHASE_HEADER, line],
        "two rows": [["Наименование", "Коли-", "Цена за", "Сумма"], ["работ", "количество", "единицу", "налога"], line],
        "a bracket over two rows": [["Наименование (", "Объём", "Цена (x", "Сумма налога"], ["без скобок) услуг", "", "y) за единицу", ""], line],
        "row 12": [*[["x"]] * 11, _PURCHASE_HEADER, line],
        "row 16": [*[["x"]] * 15, _PURCHASE_HEADER, line],
        "three fields": [_PURCHASE_HEADER[:3], line],
        "no name": [["x", *_PURCHASE_HEADER[1:], "Налоговая ставка"], line],
        "marks and blank rows": [[], _PURCHASE_HEADER, ["1", "(2)", "3 а", "№ 4."], None, [], line],
    }
    df = spark.createDataFrame([(k, [v]) for k, v in tables.items()] + [("none", None), ("no table", [])], "rel_path string, tables array<array<array<string>>>")
    items, totals = purchases.extract_items(df)
    got = {(r.rel_path, r.line_number, r.name, r.quantity, r.unit_price, r.tax_amount, r.confidence) for r in items.collect()}
    assert got == {(k, 1, "Перо", "2.00", "1.50", "0.60", 73) for k in tables if k not in {"row 16", "three fields", "no name"}}
    assert totals.count() == 0
