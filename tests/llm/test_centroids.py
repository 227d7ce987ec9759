from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from veilmark.llm.centroids import OP12_SQL, distances, kmeans, op12_centroid_clustering, whole_numbers

SCHEMA = "vec_id long, cluster string, embedding array<double>, distance int"


def brute(rows, k, dim, scale, rounds, seed):
    """(key, cluster, distance, cluster_inertia, inertia) and centroids, in Python integers."""
    kept = [(key, [math.floor(Fraction(x) * scale) for x in v]) for key, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    own = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(own(v), []).append(v)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c[j] for j in range(len(c))]
    at = [(key, own(v), far(v, c[own(v)])) for key, v in kept]
    cap = lambda n: n if n < 1 << 63 else None
    total = sum(d for _, _, d in at)
    return [(key, j, cap(d), cap(sum(e for _, i, e in at if i == j)), cap(total)) for key, j, d in at], c


def rows_of(kind):
    rng = random.Random(kind)
    size = {"plain": 3, "large": 3e7, "huge": 1e18, "mixed": 1}[kind]
    rows = [(i, [rng.gauss(i % 3, 1) * size for _ in range(4)]) for i in range(60)]
    rows += [(100, [0.5] * 4), (100, [0.5] * 4), (100, [0.25] * 4), (None, [1.0] * 4), (None, [2.0] * 4), (-7, [-0.1, -1e-300, 1e-300, 0.0])]
    rows += [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 1.0, 1.0]), (204, [math.nan] * 4), (205, [math.inf] * 4)]
    return rows + ([(300, [1e300, -1e300, 1e17, 3e9]), (301, [1.7e308] * 4)] if kind == "mixed" else [])


@pytest.mark.parametrize("kind", ["plain", "large", "huge", "mixed"])
@pytest.mark.parametrize("scale", [1024, 10])
def test_equals_plain_clustering(spark, kind, scale):
    """Null keys and vectors, wrong sizes, repeated rows, ties, odd columns, any magnitude."""
    rows = rows_of(kind)
    df = spark.createDataFrame([(key, "own", v, 1) for key, v in rows], SCHEMA).repartition(3)
    found, c = kmeans(df, "vec_id", "embedding", k=5, dim=4, scale=scale, rounds=4, seed=3)
    want, centroids = brute(rows, 5, 4, scale, 4, 3)
    assert c == centroids
    order = lambda r: str(tuple(r))
    assert sorted(map(tuple, found.collect()), key=order) == sorted(want, key=order)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, "x", [1.0, 2.0], 1), (2, "x", [1.0, 2.0], 1), (3, None, None, 1)], SCHEMA)
    found, c = kmeans(df, "vec_id", "embedding", dim=2)  # equal centroids: the first takes all
    assert {tuple(r) for r in found.collect()} == {(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)} and c == [[1024, 2048]] * 2
    found, c = kmeans(df.limit(0), "vec_id", "embedding", dim=2)
    assert found.collect() == [] and c == [] and dict(found.dtypes)["inertia"] == "bigint"


def test_bounds_of_double_precision():
    """Just within and just beyond the bound under which the matrix product is exact."""
    for top in (2**24, 2**26, 2**31, 2**40):
        x = np.array([[top - 1.0, -top + 1.0], [1.0, 2.0]])
        c = np.array([[-top, top], [3, -5]], dtype=object)
        want = [[sum((int(a) - b) ** 2 for a, b in zip(r, row, strict=True)) for row in c.tolist()] for r in x.tolist()]
        assert [[int(v) for v in r] for r in distances(x, c)] == want
    assert whole_numbers(np.array([[0.1, -0.1, 1e305]]), 1024).tolist() == [[102, -103, int(1e305) * 1024]]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(OP12_SQL).df().sort_values("vec_id").reset_index(drop=True)
    got = op12_centroid_clustering(spark, sf).toPandas().sort_values("vec_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all() and len(got) == len(want)
