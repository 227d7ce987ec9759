"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from veilmark import catalog

DATA = Path("/root/testdata/sf0.001")


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def show(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return repr(round(float(x), 9))
        return str(x)

    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, str(DATA)).toPandas(), db.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


ADJACENT = "a@b.co c@d.co, e@f.co;x@y.z. 1.2.3.4 5.6.7.8;9.9.9.9, 1.2.3.4.5.6.7.8 +1 (826) 555-4081 190.1 +7 1234567 +44 2079461234567890 \u00a0+1\u00a0234 567 89 01\n"


@pytest.mark.parametrize("name", ["spans_email", "spans_ipv4", "spans_phone"])
def test_spans_equal_sql_side_by_side(spark, tmp_path, name):
    spark.createDataFrame([(1, ADJACENT), (2, "1.2.3.4"), (3, "a@b.co"), (4, "+1 (826) 555-4081"), (5, "a@b.co\n"), (6, None), (7, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert canonical(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(con.sql(catalog.ORACLES[name]).df())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
