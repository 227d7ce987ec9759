"""Conditional readings against loops over single pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veilmark.operators import settling


def test_settled_readings_equal_a_loop(spark):
    rng = random.Random(2)
    known = {(k, t): (rng.choice([True, False, False, None]), rng.choice([None, 1, 2, 3])) for k in range(60) for t in settling.ANGLES if rng.random() < 0.8}
    table = spark.createDataFrame([(k, t, *v) for (k, t), v in known.items()], "k int, t int, full boolean, points int").cache()
    asked = []

    def read(pages, turn):
        asked.append(pages.count())
        return table.where(F.col("t") == turn).drop("t").join(pages, "k", "left_semi")

    got = {r["k"]: r for r in settling.settle(spark.range(62).select(F.col("id").cast("int").alias("k")), ["k"], settling.ANGLES, read, F.col("full"), F.col("points")).collect()}
    for k in range(62):
        best, n = None, 0
        for place, t in enumerate(settling.ANGLES):
            if (k, t) in known:
                full, points = known[k, t]
                n, rank = n + 1, (bool(full), -1 if points is None else points, -place)
                best = max(best or (rank, t), (rank, t))
                if full:
                    break
        assert (best is None) == (k not in got)
        if best:
            assert (got[k]["turn"], got[k]["readings"], got[k]["complete"]) == (best[1], n, best[0][0])
    assert asked[0] == 62 and asked == sorted(asked, reverse=True) and asked[-1] < 62


def test_scores_of_receipts(spark):
    row = spark.createDataFrame([(70, True, "1", None, "", "01-01-2024"), (None, False, None, None, None, None)], "confidence int, is_recognized boolean, issuer_inn string, issuer_name string, total_amount string, document_date string")
    assert [r[0] for r in row.select(settling.receipt_reading_score()).collect()] == [70 + 1000 + 120 + 30, 0]


@pytest.mark.parametrize("parts", [None, 4])
def test_rereading_equals_a_loop(spark, parts):
    rng = random.Random(6)
    kinds = ["primary", "continuation", "unrecognized", "unrecognized", "unrecognized", "error"]
    rows = [(i, rng.choice("fg"), rng.choice(kinds), rng.random() < 0.6, f"n{i}" if rng.random() < 0.3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, f string, kind string, again boolean, document_number string")
    read = lambda p: p.select("i", F.col("again").alias("is_continuation"))
    got = {r["i"]: r for r in settling.reread_continuations(df, ["i"], ["f"], ["i"], read, ["document_number"], parts=parts).collect()}
    assert len(got) == 300
    open_ = {"f": None, "g": None}
    for i, f, kind, again, number in rows:
        active, attached = open_[f], False
        if active and kind == "unrecognized" and again:
            kind = "continuation"
        if kind == "primary":
            open_[f] = (1, number)
        elif kind == "continuation" and active:
            attached, open_[f] = True, (active[0] + 1, active[1])
        elif kind != "continuation":
            open_[f] = None
        r = got[i]
        assert (r["kind"], r["attached"]) == (kind, attached), i
        assert r["page_number"] == (open_[f][0] if attached else 1 if kind == "primary" else None)
        assert r["document_number"] == (number or active[1] if attached else number)
        assert not attached or kind != "continuation" or rows[i][2] == "continuation" or r["re_read"]
