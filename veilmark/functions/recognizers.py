"""Patterns of entities with their base scores.

``(?iu)`` folds case beyond ASCII, ``(?U)`` makes ``\\d``, ``\\w`` and ``\\s`` Unicode.
A cheap hint per type (a character it must hold) spares most texts the pattern.
A repeated group without an upper bound is possessive: Java's matcher then needs no
stack for its turns, so that no text is too long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions import spans


@dataclass(frozen=True)
class Recognizer:
    kind: str
    score: float
    pattern: str
    hint: str | None = None


_PLATE = "ABEKMHOPCTYXАВЕКМНОРСТУХ"
#: Types, scores and shapes of the entities (fixed values).
RECOGNIZERS: list[Recognizer] = [
    Recognizer("RU_ORGANIZATION", 0.75, r'(?iu)(?<![A-ZА-Я])(?:ООО|ПАО|АО|ЗАО)\s*[«"][^»"\n]{2,120}[»"]', '[«"]'),
    Recognizer("PERSON", 0.70, r"(?iu)(?:ФИО|водитель|директор|руководитель|представитель|исполнитель)\s*[:.-]?\s*[А-ЯЁ][а-яё-]{1,30}\s+[А-ЯЁ][а-яё-]{1,30}(?:\s+[А-ЯЁ][а-яё-]{1,30})?", "[а-яА-Я]"),
    Recognizer("RU_INN", 0.55, r"(?<!\d)(?:\d[\s-]?){9}\d(?!\d)|(?<!\d)(?:\d[\s-]?){11}\d(?!\d)", r"\d"),
    Recognizer("RU_KPP", 0.45, r"(?<!\d)\d{4}[0-9A-ZА-Я]{2}\d{3}(?!\d)", r"\d{4}"),
    Recognizer("RU_OGRN", 0.45, r"(?<!\d)\d{13}(?!\d)|(?<!\d)\d{15}(?!\d)", r"\d{13}"),
    Recognizer("RU_SNILS", 0.60, r"(?<!\d)\d{3}[ -]?\d{3}[ -]?\d{3}[ -]?\d{2}(?!\d)", r"\d{3}"),
    Recognizer("RU_PASSPORT", 0.45, r"(?<!\d)\d{2} ?\d{2} ?\d{6}(?!\d)", r"\d{6}"),
    Recognizer("RU_BANK_ACCOUNT", 0.55, r"(?<!\d)\d{20}(?!\d)", r"\d{20}"),
    Recognizer("RU_BIK", 0.35, r"(?<!\d)\d{9}(?!\d)", r"\d{9}"),
    Recognizer("RU_PHONE_NUMBER", 0.70, r"(?<!\d)(?:\+7|8)[\s(.-]*\d{3}[\s).-]*\d{3}[\s.-]*\d{2}[\s.-]*\d{2}(?!\d)", r"(?:\+7|8)"),
    Recognizer("EMAIL_ADDRESS", 0.85, r"(?iuU)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]++)++(?![\w.-])", "@"),
    Recognizer("IP_ADDRESS", 0.55, r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)", r"\d\.\d"),
    Recognizer("VEHICLE_REGISTRATION", 0.65, rf"(?iu)(?<![A-ZА-Я0-9])[{_PLATE}]\d{{3}}[{_PLATE}]{{2}}\s?\d{{2,3}}(?![A-ZА-Я0-9])", r"\p{L}\d{3}\p{L}"),
    Recognizer("VIN", 0.65, r"(?iu)(?<![A-Z0-9])[A-HJ-NPR-Z0-9]{17}(?![A-Z0-9])", r"[A-Za-z0-9]{17}"),
    Recognizer("DOCUMENT_NUMBER", 0.60, r"(?iu)(?:договор|сч[её]т(?:-фактура)?|упд|акт|накладная|чек|документ|паспорт)\s*(?:№|N|No\.?)[\s:.-]*[A-ZА-Я0-9][A-ZА-Я0-9/_-]{2,}", "[а-яА-Я]"),
    Recognizer("INTERNATIONAL_PHONE_NUMBER", 0.78, r"(?U)(?<![\w+])\+\d(?:[\s().-]*\d){7,14}(?!\d)", r"\+"),
]
BY_KIND = {r.kind: r for r in RECOGNIZERS}


def recognize(text: Column, kinds: list[str] | None = None) -> Column:
    """Spans of the named (all) types, unmerged, in the order of the types."""
    parts = []
    for r in RECOGNIZERS:
        if kinds is None or r.kind in kinds:
            found = spans.find(text, r.pattern, r.kind, r.score)
            parts.append(F.when(text.rlike(r.hint), found).otherwise(spans.no_spans()) if r.hint else found)
    return F.coalesce(F.concat(*parts), spans.no_spans())


def luhn(c: Column) -> Column:
    """Whether a number passes the check of card numbers."""
    return F.coalesce(F.call_function("luhn_check", F.regexp_replace(c, r"[\s-]", "")), F.lit(False))


def iban_valid(c: Column) -> Column:
    """Whether an account number passes its modulo 97 check."""
    bare = F.upper(F.regexp_replace(c, r"\s", ""))
    turned = F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4))
    remainder = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, ch: F.when(ch.rlike("[0-9]"), (acc * 10 + ch.try_cast("int")) % 97)
        .when(ch.rlike("[A-Z]"), (acc * 100 + F.ascii(ch) - 55) % 97).otherwise(acc),
    )
    return bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (remainder == 1)
