from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from veilmark.operators import readings
from veilmark.operators.anonymize import anonymize_text
from veilmark.operators.headings import Heading, Words, best_heading, best_of_texts, fuzzy_heading_end
from veilmark.operators.rules import Rules
from veilmark.plans import paths


@pytest.mark.parametrize(
    ("crops", "want"),
    [(["51123", "511"], "511"), (["12345", "678"], "678"), (["1", "12"], "1"), ([None, "a4b5c6"], "456"), ([], None), (["7777", "888"], "888")],
)
def test_shorter_readings(spark, crops, want):
    df = spark.createDataFrame([(crops,)], "c array<string>")
    assert df.select(readings.prefer_shorter(F.col("c")).alias("x")).first().x == want


def test_scores_and_votes(spark):
    df = spark.createDataFrame([(["x1"], ["2"], [], "статус: 2"), (["2"], ["1 2"], ["1"], ""), (["2"], [], [], "статус 1"), (["2"], ["x"], [], "")], "t array<string>, w array<string>, f array<string>, text string")
    assert [r.x for r in df.select(readings.status_vote(F.col("t"), F.col("w"), F.col("f"), F.col("text")).alias("x")).collect()] == ["1", "1", "1", "2"]
    one = spark.createDataFrame([("No 1234567",), ("12",), ("",)], "c string").select(readings.digit_score(F.col("c")).alias("x")).collect()
    assert [(r.x.value, r.x.score) for r in one] == [("123456", 20), ("12", 102), (None, None)]
    crops = spark.createDataFrame([(["51"], ["511", "5112"])], "a array<string>, b array<string>")
    assert crops.select(readings.crop_number(F.col("a"), F.col("b")).alias("x")).first().x == "511"


def test_fuzzy_headings(spark):
    text = "начало\n9. Рекзивиты и подписи сторон\nдалее"
    score, start, end = best_heading(text, "9. Реквизиты и подписи сторон")
    assert 0.84 <= score < 1 and text[start:end] == "9. Рекзивиты и подписи сторон"
    assert best_heading("подписи", "подпись") is None
    df = spark.createDataFrame([(text,), (None,)], "text string")
    r = Rules(mode="disabled", headings=("9. Реквизиты и подписи сторон",), fuzzy_headings=True)
    a, b = anonymize_text(df, r).collect()
    assert a.masked.endswith("сторон\n█████") and a.entity_count == 1 and b.masked is None


def plain_heading(text, headings):
    """The best window by comparing each with each heading."""
    words = [(m.start(), m.end(), m.group().casefold().replace("ё", "е")) for m in re.finditer(r"[^\W_]+", text)]
    best = None
    for h in headings:
        aim = [m.group().casefold().replace("ё", "е") for m in re.finditer(r"[^\W_]+", h)]
        for size in range(max(1, len(aim) - 1), len(aim) + 2) if aim else []:
            for i in range(len(words) - size + 1):
                part = [w for _, _, w in words[i : i + size]]
                score = 1.0 if part == aim else 0 if len(aim) < 3 else SequenceMatcher(None, " ".join(part), " ".join(aim)).ratio()
                if score >= 0.84:
                    best = max(best or (0, 0, 0), (score, -words[i][0], words[i + size - 1][1]))
    return best and (best[0], -best[1], best[2])


def test_bounded_headings_equal_plain_scoring():
    rng = random.Random(8)
    letters = "абвге ё-.x1"
    for _ in range(400):
        heading = "".join(rng.choice(letters) for _ in range(rng.randint(0, 16)))
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        spoilt = "".join(c if rng.random() > 0.1 else rng.choice(letters) for c in heading)
        text += rng.choice(["", " " + spoilt + " ", " " + heading + "\n"]) + text[::-1]
        other = text[3:12]
        assert best_heading(text, heading, other) == plain_heading(text, [heading, other]), (heading, text)


def test_headings_of_many_texts_are_found_at_once(monkeypatch):
    """Texts are compared together, in a few array operations for all; no window crosses texts, odd letters keep their places."""
    rng, letters, heading = random.Random(3), "абвг ё_ŉßǰİ\u0345ﬁ😀²\n.", "подписи İ ǰсторон"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(100)] + ["", " ", "Подписи İ", "ǰсторон"]
    texts += [t + rng.choice([" ", "ǰ\n"]) + h + t for t in texts for h in ("пoдписи i сторон", heading.upper(), "подпись\u0345İ.ǰстрон")]
    calls, likely = [], Heading.likely
    monkeypatch.setattr(Heading, "likely", lambda *a: calls.append(a) or likely(*a))
    got = best_of_texts(texts, [Heading(heading), Heading("вг аб")])
    assert len(calls) == 4  # three sizes of windows and one

    def plain_words(text):
        return [(m.start(), m.end(), "".join(filter(str.isalnum, m.group().casefold().replace("ё", "е")))) for m in re.finditer(r"[^\W_]+", text)]

    for k, t in enumerate(texts):
        words, best = plain_words(t), None
        for aim in ([w for *_, w in plain_words(heading)], ["вг", "аб"]):
            for size in range(len(aim) - 1, len(aim) + 2) if len(aim) > 2 else [len(aim)]:
                for i in range(len(words) - size + 1):
                    part = [w for *_, w in words[i : i + size]]
                    score = 1.0 if part == aim else 0 if len(aim) < 3 else SequenceMatcher(None, " ".join(part), " ".join(aim)).ratio()
                    if score >= 0.84:
                        best = max(best or (0, 0, 0), (score, -words[i][0], words[i + size - 1][1]))
        assert got.get(k) == best, t
    assert len(got) > 100


def test_few_windows_of_documents_are_scored(spark):
    """Over all documents: the plain result, and below one per cent of windows compared in full."""
    headings = ("Licensed under the Apache License", "GNU General Public License", "9. Реквизиты и подписи сторон")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", fuzzy_heading_end(F.col("text"), headings).alias("end")).collect()
    every = scored = 0
    for r in docs:
        words = Words(r.text)
        for h in map(Heading, headings):
            every += sum(max(0, len(words.words) - n + 1) for n in h.sizes)
            scored += sum(len(h.likely(words, n)) for n in h.sizes)
    assert scored < 0.01 * every
    for r in docs[::20]:
        found = plain_heading(r.text, headings)
        assert r.end == (found and found[2])


def test_paths(tmp_path):
    (tmp_path / "f").write_text("x")
    assert paths.path_issues("", " ") == ["source_empty", "output_empty"]
    assert paths.path_issues(str(tmp_path / "no"), str(tmp_path / "f")) == ["source_missing", "output_not_folder"]
    assert paths.path_issues(str(tmp_path), str(tmp_path)) == ["same_folder"]
    assert paths.target_folder("/o/", "/t/", True) == "/o/t"
    for bad in ("a/b", ".."):
        with pytest.raises(ValueError):
            paths.target_folder("/o", bad, False)
    with pytest.raises(ValueError):
        paths.check_options("same", "plain", False)
