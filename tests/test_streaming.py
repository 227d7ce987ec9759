from __future__ import annotations

from veilmark.streaming.anonymize import anonymized_text_files, write_parquet


def test_files_are_masked_once(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    for k, t in enumerate(["mail a@b.example.com here", "nothing"]):
        (source / f"{k}.txt").write_text(t)
        write_parquet(anonymized_text_files(spark, f"file://{source}"), f"file://{out}", f"file://{state}").awaitTermination(60)
    rows = {r.path[-5:]: (r.masked, r.entity_count) for r in spark.read.parquet(f"file://{out}").collect()}
    assert rows == {"0.txt": ("mail ███████████████ here", 1), "1.txt": ("nothing", 0)}
