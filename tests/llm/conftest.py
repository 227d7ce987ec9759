"""Small tables for the operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz la le li lo lu ra re ri ro ru".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with copies, near copies, nulls, blanks, a long one and odd characters."""
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(3, 90))) for _ in range(60)]
    rows = []
    for k, t in enumerate(base):
        rows.append((k, t, rng.choice(["en", "fr"]), f"src{k % 4}", 7))
        for c in range(rng.randint(0, 3)):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["new", "NEW", "x"])
            rows.append((1000 + 10 * k + c, " ".join(w), rng.choice(["en", None]), None if c else "src0", None))
    rows += [(5000, None, None, None, None), (5001, "", "en", "src1", 0), (5002, " \n\t", "en", "src1", 3), (5003, "solo", "fr", "src2", 4), (5004, "SOLO ", "fr", "src2", 5)]
    rows += [(5005, "long " + " ".join(WORDS * 1500), "en", "src3", 1), (5006, "дом Ω don't \x00 a  b", "fr", "src3", 1), (5006, "дом Ω don't \x00 a  b", "fr", "src3", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("length", F.lit("extra")).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
