"""Span algebra against plain Python versions on random spans."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from veilmark.functions import recognizers, spans
from veilmark.operators import rules
from veilmark.operators.anonymize import anonymize_text, passenger_names


def plain_merge(found, size):
    out = []
    clamped = [(max(s, 0), min(e, size), t, sc, r) for s, e, t, sc, r in found]
    for s, e, t, sc, r in sorted((x for x in clamped if x[1] > x[0]), key=lambda x: (x[0], x[1])):
        if out and s < out[-1][1]:
            a, b, u, best, old = out[-1]
            replacement = (r if r is not None else old) if (a, b) == (s, e) else None
            out[-1] = (a, max(b, e), u if best >= sc else t, max(best, sc), replacement)
        else:
            out.append((s, e, t, sc, r))
    return out


@pytest.fixture(scope="module")
def random_spans(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        one = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(-2, 12)
            one.append((a, a + rng.randint(0, 5), rng.choice("XYZ"), rng.choice([0.3, 0.5, 0.5, 0.9]), rng.choice([None, None, "r", "q"])))
        rows.append((k, "".join(rng.choice("ab é\n") for _ in range(12)), one))
    return spark.createDataFrame(rows, f"k int, text string, s {spans.SPANS}"), rows


def test_merge_is_the_plain_fold(random_spans):
    df, rows = random_spans
    got = {r.k: [tuple(x) for x in r.m] for r in df.select("k", spans.merge(F.col("s"), F.length("text")).alias("m")).collect()}
    assert got == {k: plain_merge(s, len(t)) for k, t, s in rows}


def test_transform_and_runs_agree(random_spans):
    df, rows = random_spans
    m = df.withColumn("m", spans.merge(F.col("s"), F.length("text")))
    runs = F.array(F.substring("text", 1, 5), F.lit(""), F.substring("text", 6, 20))
    got = m.select("k", spans.transform_text(F.col("text"), F.col("m")).alias("a"), F.array_join(spans.transform_runs(runs, F.col("m")), "").alias("b")).collect()
    want = {}
    for k, t, s in rows:
        out, at = "", 0
        for a, b, _, _, r in plain_merge(s, len(t)):
            out += t[at:a] + (r if r is not None else "".join(c if c.isspace() else "█" for c in t[a:b]))
            at = b
        want[k] = out + t[at:]
    assert {r.k: r.a for r in got} == want
    assert {r.k: r.b for r in got} == want


def test_subtract(spark):
    df = spark.createDataFrame([([(0, 10, "A", 1.0, None)], [(2, 4, "", 0.0, None), (3, 6, "", 0.0, None), (9, 20, "", 0.0, None)])], f"a {spans.SPANS}, b {spans.SPANS}")
    got = df.select(spans.subtract(F.col("a"), F.col("b")).alias("x")).first().x
    assert [(s.start, s.end) for s in got] == [(0, 2), (6, 9)]


def plain_subtract(found, cuts):
    out = []
    for s, e, *rest in found:
        parts = [(s, e)]
        for a, b, *_ in cuts:
            parts = [p for x, y in parts for p in ([(x, y)] if a >= y or b <= x or b <= a else [(x, min(y, a)), (max(x, b), y)]) if p[1] > p[0]]
        out += [(x, y, *rest) for x, y in parts]
    return out


@pytest.mark.parametrize("apart", [True, False])
def test_subtract_random_spans(random_spans, apart):
    """Merged spans in one sweep, others one by one; cuts may overlap, touch or be empty."""
    df, rows = random_spans
    cuts = {k: rows[(k + 1) % len(rows)][2] for k, _, _ in rows}
    other = df.select((F.col("k") - 1).alias("k"), F.col("s").alias("c")).union(df.where("k = 0").select(F.lit(len(rows) - 1), "s"))
    own = spans.merge(F.col("s"), F.length("text")) if apart else F.filter("s", lambda x: x["end"] > x["start"])
    got = df.withColumn("s", own).join(other, "k").select("k", spans.subtract(F.col("s"), F.col("c")).alias("x")).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = plain_merge(rows[r.k][2], len(rows[r.k][1])) if apart else [x for x in rows[r.k][2] if x[1] > x[0]]
        assert sorted(map(str, map(tuple, r.x))) == sorted(map(str, plain_subtract(mine, cuts[r.k])))


def test_many_spans_take_linear_time(spark):
    """20,000 spans in one text are found, merged, cut and masked in seconds."""
    n = 20_000
    text = " ".join(f"10.0.{k % 250}.{k % 99}" for k in range(n))
    df = spark.createDataFrame([(text,), (None,)], "text string")
    begun = time.monotonic()
    done = df.withColumn("s", spans.find(F.col("text"), r"(?:\d{1,3}\.){3}\d{1,3}", "IP", 0.5))
    done = done.withColumn("m", spans.merge(F.concat("s", "s"), F.length("text"))).withColumn("left", spans.subtract(F.col("m"), F.slice("s", 1, n // 10)))
    r = done.select("m", F.size("left").alias("n"), spans.transform_text(F.col("text"), F.col("m")).alias("masked")).collect()
    assert time.monotonic() - begun < 60  # it took over three minutes by folds that copy
    assert r[0].masked == "".join(" " if c == " " else "█" for c in text) and r[1].masked is None
    assert len(r[0].m) == n and r[0].n == n - n // 10


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("пишите на a.b@mail.example.com, да", "EMAIL_ADDRESS", ["a.b@mail.example.com"]),
        ("a@b.com. конец", "EMAIL_ADDRESS", []),
        ("ИНН 7701 234567", "RU_INN", ["7701 234567"]),
        ('ООО «Ромашка» и АО "Клён"', "RU_ORGANIZATION", ["ООО «Ромашка»", 'АО "Клён"']),
        ("Директор: Иванов Пётр Ильич", "PERSON", ["Директор: Иванов Пётр Ильич"]),
        ("а123вс77", "VEHICLE_REGISTRATION", ["а123вс77"]),
        ("+44 20 7946 0958", "INTERNATIONAL_PHONE_NUMBER", ["+44 20 7946 0958"]),
        ("+1234567", "INTERNATIONAL_PHONE_NUMBER", []),
        ("счет № АБ-12", "DOCUMENT_NUMBER", ["счет № АБ-12"]),
        ("112-233-445 95", "RU_SNILS", ["112-233-445 95"]),
    ],
)
def test_recognizers(spark, text, kind, want):
    df = spark.createDataFrame([(text,)], "t string").withColumn("s", recognizers.recognize(F.col("t"), [kind]))
    assert df.select(spans.texts(F.col("t"), F.col("s")).alias("x")).first().x == want


def test_modes_and_rules(spark):
    df = spark.createDataFrame([("почта a@b.com и петров Пётр, Петрович", False), (None, False), ("", False)], "text string, ocr boolean")
    r = rules.Rules(mode="combined", excluded=("a@b",), included=("петр",), replacements=(("Пётр", "Иван"),))
    got = [x.masked for x in anonymize_text(df, r).collect()]
    assert got == ["почта a@b██████ и ████ов Иван, ████ович".replace("██████", "████"), None, ""]
    assert rules.Rules().effective_mode == "automatic"
    assert rules.Rules(included=("x",)).effective_mode == "configured"
    assert anonymize_text(df, rules.Rules(mode="disabled")).first().masked == df.first().text


def test_fuzzy_only_on_ocr(spark):
    df = spark.createDataFrame([("cрок Komпaния X", True), ("cрок Komпaния X", False)], "text string, ocr boolean")
    r = rules.Rules(mode="configured", included=("компания",), fuzzy=True, max_errors=1)
    a, b = [x.masked for x in anonymize_text(df, r, is_ocr="ocr").collect()]
    assert a == "cрок ████████ X"
    assert b == df.first().text


def test_headings(spark):
    df = spark.createDataFrame([("до\n9. Реквизиты  и подписи СТОРОН: после",), ("нет",)], "text string")
    r = rules.Rules(mode="disabled", headings=("9. Реквизиты и подписи сторон",))
    a, b = anonymize_text(df, r).select("masked", "entity_count").collect()
    assert a.masked == "до\n9. Реквизиты  и подписи СТОРОН█ █████" and a.entity_count == 1
    assert b.masked == "нет" and b.entity_count == 0


def test_passenger_names(spark):
    df = spark.createDataFrame([("Passenger name: SMITH JOHN\nIVANOV/PETR MR\nMOW/LED",)], "t string")
    got = df.select(spans.texts(F.col("t"), passenger_names(F.col("t"))).alias("x")).first().x
    assert got == ["SMITH JOHN", "IVANOV/PETR MR"]


def test_settings_file():
    r = rules.parse_rules("[anonymization]\nentityDetectionMode = combined\nincluded = a, A\n  b\nincludedAndReplaced =\n  x -> y\nincludedFuzzyMaxErrors = 2\n")
    assert (r.mode, r.included, r.replacements, r.max_errors) == ("combined", ("a", "b"), (("x", "y"),), 2)
    for bad in ("[other]\n", "[anonymization]\nincludedAndReplaced = x\n", "[anonymization]\nincludedFuzzyMaxErrors = 4\n", "[anonymization]\nwhat = 1\n"):
        with pytest.raises(ValueError):
            rules.parse_rules(bad)


def test_checks_of_numbers(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"), ("4111 1111 1111 1112", "GB82 WEST 1234 5698 7654 33")], "c string, i string")
    got = [tuple(r) for r in df.select(recognizers.luhn(F.col("c")), recognizers.iban_valid(F.col("i"))).collect()]
    assert got == [(True, True), (False, False)]
