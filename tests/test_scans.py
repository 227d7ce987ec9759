"""Order-dependent operators against plain loops, at any number of ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veilmark.operators import ordered, planning, scans


def plain_names(rows):
    """Destinations of (order, folder, name), given out one by one."""
    taken, out = {}, {}
    for i, folder, name in sorted(rows):
        own = taken.setdefault(folder, set())
        made, k = name, 2
        if name is not None:
            stem, dot, suffix = name.rpartition(".")
            stem, suffix = (stem, dot + suffix) if dot else (name, "")
            while made.lower() in own:
                made, k = f"{stem}_{k}{suffix}", k + 1
            own.add(made.lower())
        out[i] = made
    return out


CASES = {
    "one name": ["a.txt"] * 40,
    "planted": ["a.txt"] * 5 + ["a_2.txt", "a_7.txt", "A_9.txt"] + ["a.txt"] * 12,
    "planted first": ["a_7.txt", "a_2.txt", "a_3.txt"] + ["a.txt"] * 12 + ["a_4.txt"],
    "levels": ["a.txt", "a.txt", "a_2.txt", "a_2_2.txt", "a_2.txt", "a_2.txt", "a_2_2.txt", "a_2_3_2.txt", "a_2_3.txt", "a_2_3.txt", "a.txt"],
    "odd": ["a_1.txt", "a_02.txt", "a_1.txt", ".x", ".x", "a", "a", "a_2", None, None, "a_2.b.c", "a.b.c", "a.b.c", "", "", "_2", "a_99999999999.txt"],
}


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("parts", [None, 5])
def test_numbering(spark, case, parts):
    rows = [(i, "f", n) for i, n in enumerate(CASES[case])] + [(100 + i, None, n) for i, n in enumerate(CASES[case][::-1])]
    df = spark.createDataFrame(rows, "i int, folder string, name string").repartition(3)
    got = {r["i"]: r["destination"] for r in planning.number_collisions(df, "folder", "name", "i", parts=parts).collect()}
    assert got == plain_names(rows)


@pytest.mark.parametrize("seed", range(4))
def test_numbering_of_random_names(spark, seed):
    rng = random.Random(seed)
    names = ["a.t", "A.t", "a_2.t", "a_3.t", "a_4.t", "a_5.t", "a_2_2.t", "a_3_2.t", "b.t", "b_2.t", "a_2_2_2.t"]
    weights = [rng.choice([1, 1, 4, 9]) for _ in names]
    rows = [(i, rng.choice("fg"), rng.choices(names, weights)[0]) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, folder string, name string")
    got = {r["i"]: r["destination"] for r in planning.number_collisions(df, "folder", "name", "i", parts=3).collect()}
    assert got == plain_names(rows)


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_runs(spark, parts):
    """Runs over range borders, inherited values, null folders and kinds, empty tables."""
    rng = random.Random(9)
    rows = [(rng.choice(["f", "g", "f", None]), i, rng.choice(["primary", "continuation", "continuation", "continuation", "unrecognized", None]), rng.choice([None, f"n{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "f string, i int, kind string, document_number string").withColumn("extra", F.create_map(F.lit("k"), "document_number", F.col("i").cast("string"), F.lit("x")))
    found = {r["i"]: r for r in ordered.continue_runs(df, ["f"], ["i"], ["document_number"], "extra", parts=parts).collect()}
    state = {}
    for f, i, kind, number in rows:
        run, head, place = state.get(f, (0, None, 0))
        if kind not in ("continuation", None):
            run, head, place = run + 1, (kind, number, i), 0
        place += 1
        state[f] = run, head, place
        r, attached = found[i], kind == "continuation" and head is not None and head[0] == "primary"
        assert (r["run_no"], r["attached"]) == (run, attached)
        assert r["page_number"] == (place if attached else 1 if kind == "primary" else None)
        assert r["document_number"] == (number or head[1] if attached else number)
        assert r["extra"] == ({str(head[2]): "x", str(i): "x", "k": number} if attached else {"k": number, str(i): "x"})
    assert ordered.continue_runs(df.limit(0), ["f"], ["i"]).collect() == []


def test_ranges_share_one_key(spark):
    """One key on all rows is dealt over all ranges; sums equal a plain window's."""
    df = spark.range(20_000).select(F.lit("all").alias("key"), F.col("id").alias("i"), (F.col("id") % 7).alias("v"))
    held = scans.ranged(df, ["key"], ["i"], 10)
    sizes = sorted(r["count"] for r in held.groupBy("_part").count().collect())
    assert len(sizes) == 10 and sizes[-1] <= 2 * sizes[5]
    found = scans.running_sum(df, ["key"], ["i"], F.col("v"), "s", 10)
    assert found.where(F.expr("s != i div 7 * 21 + (i % 7) * (i % 7 + 1) div 2")).isEmpty() and found.count() == 20_000
