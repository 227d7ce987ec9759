"""Office packages made safe: texts go through the same anonymisation as others.

A package is unpacked into text units (one per paragraph or string), these are
anonymised natively as rows, and the package is put together again.  Whatever could
hide data or run code fails the whole file.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import spans
from veilmark.operators.anonymize import anonymize_text
from veilmark.operators.rules import Rules

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Parts that a safe package doesn't hold (fixed values).
REFUSED = re.compile(
    r"(?i)(vbaProject|vbaData|/embeddings/|/activeX/|/externalLinks/|/pivotCache/|/queryTables/|/threadedComments/|xl/persons/|xl/model/|xl/richData/|xl/connections\.xml"
    r"|oleObject|EncryptedPackage|\.bin$)"
)
#: Attributes that name people, and attributes with texts of their own (fixed values).
AUTHORS = {"author", "initials", "lastModifiedBy", "creator", "userId", "email"}
DESCRIPTIONS = {"descr", "title", "tooltip"}
#: Headers and footers of sheets (fixed values).
MARGINS = {"oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter"}
HIDDEN_NAME = "anonymized"
#: Parts of these names hold formats only; any other part of the document holds texts.
FORMATS = {"styles", "stylesWithEffects", "settings", "webSettings", "fontTable", "numbering", "workbook"}
#: Attributes with texts that can't be changed without harm: names of tables and columns, what a
#: link shows and where it leads, prompts of cells, instructions of fields.
NAMES = {"name", "displayName", "display", "location", "prompt", "promptTitle", "error", "errorTitle", "instr", "alt", "ref", "anchor"}
PICTURE = re.compile(r"(?i)/media/")


class Unsafe(ValueError):
    """A package that can't be anonymised safely."""


def open_package(raw: bytes) -> dict[str, bytes]:
    """The parts of a package; traversal, links, doubles and active parts are refused."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        names = [i.filename for i in infos]
        if len({n.lower() for n in names}) != len(names):
            raise Unsafe("a part occurs twice")
        for i in infos:
            if i.filename.startswith("/") or ".." in posixpath.normpath(i.filename).split("/") or (i.external_attr >> 16) & 0o170000 == 0o120000:
                raise Unsafe(f"the part {i.filename} leaves the package")
            if i.flag_bits & 1 or REFUSED.search(i.filename):
                raise Unsafe(f"the part {i.filename} is not allowed")
        if any(n.lower().startswith("xl/") for n in names) and any(n.lower() == "docprops/custom.xml" or n.lower().startswith("customxml/") for n in names):
            raise Unsafe("a workbook with custom data")
        if any(PICTURE.search(n) for n in names):
            raise Unsafe("a picture needs an external provider")
        stripped = ("customxml/", "docprops/custom.xml")
        return {i.filename: z.read(i) for i in infos if not i.filename.lower().startswith(stripped)}


def _local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def clean_relationships(root: ElementTree.Element) -> None:
    """Removes relationships that leave the package or lead to stripped parts."""
    for r in list(root):
        kind = r.get("Type", "") + " " + r.get("Target", "")
        if r.get("TargetMode") == "External" or "customXml" in kind or "custom-properties" in kind:
            root.remove(r)


def clean_content_types(root: ElementTree.Element) -> None:
    """Removes the declarations of stripped parts."""
    for e in list(root):
        if "customxml" in e.get("PartName", "").lower() or "custom-properties" in e.get("ContentType", ""):
            root.remove(e)


def close_package(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def _texts(kind: str, part: str, root: ElementTree.Element) -> list[list[ElementTree.Element]]:
    """Text elements of a part, grouped as they are read."""
    if kind == "docx" and "/charts/" not in part and "/diagrams/" not in part:
        # What is shown, what was deleted but tracked, and the instructions of fields, each on its own.
        return [list(p.iter(f"{W}{tag}")) for p in root.iter(f"{W}p") for tag in ("t", "delText", "instrText", "delInstrText")]
    if kind == "docx" or "/charts/" in part or "/drawings/" in part or "/diagrams/" in part:
        paragraphs = [[t for t in p.iter() if _local(t.tag) == "t"] for p in root.iter() if _local(p.tag) == "p"]
        return paragraphs + [[e] for e in root.iter() if _local(e.tag) in {"v", "f"}]  # what a chart repeats of its cells
    if part.endswith("sharedStrings.xml"):
        return [list(si.iter(f"{S}t")) for si in root.iter(f"{S}si")]
    found = [list(x.iter(f"{S}t")) for x in [*root.iter(f"{S}is"), *root.iter(f"{S}text")]]
    found += [[c.find(f"{S}v")] for c in root.iter(f"{S}c") if c.get("t") == "str" and c.find(f"{S}v") is not None]
    return found + [[e] for e in root.iter() if _local(e.tag) in MARGINS]


def _is_text_part(kind: str, part: str) -> bool:
    top, _, rest = part.partition("/")
    folder, _, name = rest.rpartition("/")
    formats = (folder == "" and name.removesuffix(".xml") in FORMATS) or folder == "theme"
    return top == ("word" if kind == "docx" else "xl") and part.endswith(".xml") and "_rels" not in folder.split("/") and not formats


def _hidden(root: ElementTree.Element, groups: list[list[ElementTree.Element]]) -> list[str]:
    """Texts of a part that are neither rewritten nor cleared: other nodes, and attributes that may hold words."""
    seen = {id(e) for g in groups for e in g}
    out = {e.text.strip() for e in root.iter() if id(e) not in seen and e.text and _local(e.tag) != "v" and re.search(r"[^\W\d_]", e.text)}
    for e in root.iter():
        for a, v in e.attrib.items():
            name = _local(a)
            if name not in AUTHORS | DESCRIPTIONS and not _is_label(e, name) and (name in NAMES or "@" in v or " " in v.strip()):
                out.add(v)
    return sorted(out)


def _is_label(e: ElementTree.Element, attribute: str) -> bool:
    """Whether an attribute labels a content control, and is cleared."""
    return attribute == "val" and _local(e.tag) in {"alias", "tag", "placeholder"}


def unpack(files: DataFrame) -> DataFrame:
    """(rel_path, part, unit, runs, text, sensitive, error) of DOCX and XLSX files.

    ``sensitive`` units (formulas, names of sheets, areas, tables and columns, any other
    text or attribute that isn't rewritten) can't be changed: an entity in one fails the file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["rel_path", "part", "unit", "runs", "text", "sensitive", "error"]
        for b in batches:
            rows = []
            for rel, suffix, raw in zip(b["rel_path"], b["suffix"], b["content"], strict=True):
                kind = suffix[1:]
                try:
                    own = []
                    for part, data in open_package(raw).items():
                        if part.endswith(".rels") and kind == "xlsx" and b'TargetMode="External"' in data:
                            raise Unsafe("a relationship leaves the package")
                        if part == "xl/workbook.xml":
                            root = ElementTree.fromstring(data)
                            fixed = [e.get("name") or "" for e in root.iter(f"{S}sheet")] + [(e.get("name") or "") + " " + (e.text or "") for e in root.iter(f"{S}definedName")]
                            own += [(rel, part, k, [t], t, True, None) for k, t in enumerate(fixed)]
                        if not part.endswith(".xml") or not part.startswith(("word/", "xl/")):
                            continue
                        root = ElementTree.fromstring(data)
                        groups = _texts(kind, part, root) if _is_text_part(kind, part) else []
                        own += [(rel, part, 2_000_000 + k, [t], t, True, None) for k, t in enumerate(_hidden(root, groups))]
                        for k, group in enumerate(groups):
                            runs = [e.text or "" for e in group]
                            own.append((rel, part, k, runs, "".join(runs), False, None))
                        fixed = [e for e in root.iter() if _local(e.tag) in {"formula1", "formula2"} or e.tag == f"{S}f"]
                        own += [(rel, part, 1_000_000 + k, [e.text or ""], e.text or "", True, None) for k, e in enumerate(fixed)]
                    rows += own
                except (Unsafe, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((rel, None, None, [], None, False, str(e)))
            yield pd.DataFrame(rows, columns=columns)

    return files.where(F.col("suffix").isin(".docx", ".xlsx")).select("rel_path", "suffix", "content").mapInPandas(
        run, "rel_path string, part string, unit int, runs array<string>, text string, sensitive boolean, error string"
    )


def anonymize_packages(files: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(rel_path, content, entity_count, error) of DOCX and XLSX files."""
    units = unpack(files)
    masked = anonymize_text(units.where("error is null"), rules)
    runs = F.when(F.col("masked") == spans.transform_text(F.col("text"), F.col("entities")), spans.transform_runs(F.col("runs"), F.col("entities"))).otherwise(
        F.concat(F.array("masked"), F.array_repeat(F.lit(""), F.size("runs") - 1))  # a heading masked what follows
    )
    per_file = masked.groupBy("rel_path").agg(
        F.sum("entity_count").alias("entity_count"),
        F.bool_or(F.col("sensitive") & (F.col("entity_count") > 0)).alias("leak"),
        F.collect_list(F.when(~F.col("sensitive") & (F.size("runs") > 0), F.struct("part", "unit", runs.alias("runs")))).alias("units"),
    )
    failed = units.where("error is not null").select("rel_path", "error")
    joined = files.where(F.col("suffix").isin(".docx", ".xlsx")).select("rel_path", "suffix", "content").join(per_file, "rel_path", "left").join(failed, "rel_path", "left")
    leaked = F.when(F.col("leak"), "an entity lies in a formula or name")
    ready = joined.select("rel_path", "suffix", "content", F.coalesce("entity_count", F.lit(0)).alias("entity_count"), "units", F.coalesce("error", leaked).alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                if isinstance(r.error, str):
                    rows.append((r.rel_path, None, 0, r.error))
                    continue
                parts = open_package(r.content)
                by_part: dict[str, dict[int, list[str]]] = {}
                for u in r.units if r.units is not None else []:
                    by_part.setdefault(u["part"], {})[u["unit"]] = list(u["runs"])
                for part, data in list(parts.items()):
                    if part.endswith(".rels") or part == "[Content_Types].xml":
                        root = ElementTree.fromstring(data)
                        (clean_relationships if part.endswith(".rels") else clean_content_types)(root)
                        parts[part] = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
                        continue
                    if not part.endswith(".xml") or not (part.startswith(("word/", "xl/", "docProps/"))):
                        continue
                    root = ElementTree.fromstring(data)
                    for k, group in enumerate(_texts(r.suffix[1:], part, root) if part in by_part else []):
                        for e, new in zip(group, by_part[part].get(k, []), strict=False):
                            e.text = new
                    for e in root.iter():
                        for a in list(e.attrib):
                            if _local(a) in AUTHORS:
                                e.set(a, HIDDEN_NAME)
                            elif _local(a) in DESCRIPTIONS or _is_label(e, _local(a)):
                                e.set(a, "")
                    if part.startswith("docProps/"):
                        for e in root.iter():
                            if len(e) == 0:
                                e.text = ""
                    parts[part] = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
                rows.append((r.rel_path, close_package(parts), int(r.entity_count), None))
            yield pd.DataFrame(rows, columns=["rel_path", "content", "entity_count", "error"])

    return ready.mapInPandas(run, "rel_path string, content binary, entity_count long, error string")
