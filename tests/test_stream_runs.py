from __future__ import annotations

import random

from veilmark.operators.ordered import continue_runs
from veilmark.streaming.runs import continue_stream

SCHEMA = "folder string, i long, kind string, document_number string, seen timestamp"


def test_three_triggers_equal_the_batch(spark, tmp_path):
    """Pages that come in three triggers give what one batch gives; runs stay open between triggers."""
    rng = random.Random(3)
    kinds = ["primary", "continuation", "continuation", "unrecognized", None]
    rows = [(rng.choice(["f", "g", None]), i, rng.choice(kinds), rng.choice([None, f"n{i}"]), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(120)]
    df = spark.createDataFrame(rows, "folder string, i long, kind string, document_number string, seen string").selectExpr("folder", "i", "kind", "document_number", "cast(seen as timestamp) seen")
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    for n in range(3):  # one file a trigger
        df.where(f"i div 40 = {n}").coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
        found = continue_stream(stream, "folder", "i", "seen", "1 day", ["document_number"])
        q = found.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{state}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    want = continue_runs(df, ["folder"], ["i"], ["document_number"])
    columns = ["folder", "i", "kind", "document_number", "run_no", "attached", "page_number"]
    got = spark.read.parquet(f"file://{out}").select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(columns).collect())) and got.count() == 120


def test_a_silent_folder_is_closed(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    batches = [[("f", 1, "primary", "a", "2024-01-01 00:00:00")], [("g", 2, "primary", "b", "2024-01-05 00:00:00")], [("g", 3, "continuation", None, "2024-01-05 00:00:01")], [("f", 4, "continuation", None, "2024-01-09 00:00:00")]]
    for rows in batches:
        df = spark.createDataFrame(rows, "folder string, i long, kind string, document_number string, seen string").selectExpr("folder", "i", "kind", "document_number", "cast(seen as timestamp) seen")
        df.coalesce(1).write.mode("append").parquet(f"file://{source}")
        found = continue_stream(spark.readStream.schema(SCHEMA).parquet(f"file://{source}"), "folder", "i", "seen", "1 day", ["document_number"])
        q = found.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{state}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {r["i"]: (r["attached"], r["document_number"], r["run_no"]) for r in spark.read.parquet(f"file://{out}").collect()}
    assert got == {1: (False, "a", 1), 2: (False, "b", 1), 3: (True, "b", 1), 4: (False, None, 0)}
