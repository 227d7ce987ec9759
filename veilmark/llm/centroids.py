"""Centroid clustering (k-means) of integer vectors, exact on any machine.

Components become integers floor(scale * x), so every sum and distance is a whole
number and the result does not depend on the order of rows, blocks or tasks.  Distances
are |x|^2 - 2 x.c + |c|^2 with one matrix product a block in double precision.  That is
exact while dim * (max|x| + max|c|)^2 < 2^53, as no partial sum in any order can
be larger; the rows for which it isn't get integer arithmetic instead, 64 bits wide
or unbounded.  A round broadcasts the k centroids and sums members by
``treeAggregate``: what moves is k * dim numbers a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.shared import in_arrow, stash, table

CLUSTERS, DIM, SCALE, ROUNDS, SEED = 8, 64, 1024, 10, 3
#: Vectors of a block; with |x| below 2^26 their sum stays below 2^53.
BLOCK_ROWS = 4_096
#: Integers up to here are exact in double precision.
EXACT = 1 << 53
#: Depth of the tree that adds the sums of tasks.
DEPTH = 3
_LONG = (1 << 63) - 1
_ADDED = [("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long")]


def complete(column: str, dim: int) -> Column:
    """True for vectors of ``dim`` components, none of them null or non-finite."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dim) & finite, F.lit(False))


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): as doubles where all are below 2^53, else as Python integers."""
    with np.errstate(over="ignore"):
        near = np.floor(x * scale)
    if scale & (scale - 1) == 0 and (np.abs(near) < EXACT).all():
        return near  # a power of two shifts the exponent only, so the product is exact
    return np.frompyfunc(lambda v: math.floor(Fraction(v) * scale), 1, 1)(x.astype(object))


def _integers(x: np.ndarray) -> np.ndarray:
    """Python integers of whole numbers."""
    return np.frompyfunc(int, 1, 1)(x.astype(object))


def _squares(x: np.ndarray, c: np.ndarray, kind: type) -> np.ndarray:
    """Squared distances by differences, in integers of ``kind``."""
    x = _integers(x) if kind is object else x.astype(kind)
    return np.stack([((x - row.astype(kind)) ** 2).sum(axis=1) for row in c], axis=1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows ``x`` to centroids ``c`` (integers).

    Double precision where the bound allows for all rows, else object integers
    with each row computed in the narrowest exact way.
    """
    dim = x.shape[1]
    own = np.abs(x).max(axis=1) if dim else np.zeros(len(x))
    top = int(np.abs(c).max()) if c.size else 0
    reach = np.array([dim * (int(v) + top) ** 2 for v in own], dtype=object) if x.dtype == object or top >= EXACT else dim * (own + top) ** 2
    quick = np.asarray(reach < EXACT, dtype=bool)
    if quick.all():
        return _product(x.astype(np.float64), c.astype(np.float64))
    out = np.empty((len(x), len(c)), dtype=object)
    fits = ~quick & np.asarray(reach < 1 << 62, dtype=bool)
    rest = ~quick & ~fits
    if quick.any():
        out[quick] = _product(x[quick].astype(np.float64), c.astype(np.float64)).astype(np.int64)
    if fits.any():
        out[fits] = _squares(x[fits], c, np.int64)
    if rest.any():
        out[rest] = _squares(x[rest], c, object)
    return out


def _product(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the smaller number of equals."""
    d = distances(x, c)
    own = d.argmin(axis=1)
    return own, d[np.arange(len(x)), own]


def member_sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Exact sums of the members of each centroid, as Python integers."""
    if x.dtype != object and np.abs(x).max(initial=0) * len(x) < EXACT:
        return (np.eye(k)[:, own] @ x).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), dtype=object)
    np.add.at(out, own, _integers(x))
    return out


def blocks_of(vectors: DataFrame, column: str) -> DataFrame:
    """The vectors as rows of one binary block each: doubles, ``BLOCK_ROWS`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), BLOCK_ROWS):
                part = b.column(0).slice(k, BLOCK_ROWS).flatten().cast(pa.float64())
                blob = part.to_numpy(zero_copy_only=False).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["block"])

    return in_arrow(vectors.select(column), run, "block binary")


def kmeans(
    vectors: DataFrame, key: str, column: str, k: int = CLUSTERS, dim: int = DIM, scale: int = SCALE, rounds: int = ROUNDS,
    seed: int = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """Clusters the rows of ``vectors``; returns rows (key, cluster, distance, cluster_inertia, inertia) and the centroids.

    Only vectors of ``dim`` components, none null or non-finite, take part; others have no
    row.  Centroids start as the ``k`` vectors (all, if fewer) whose sha256 of
    ``seed:key`` is smallest; keys that repeat go by their components, null
    keys come last.  ``rounds`` times each vector goes to its nearest centroid (the
    smaller number of equals) and each centroid that has members to the floor of their
    mean.  Repeated rows count as often as they occur.  Distances and sums of
    distances beyond 64 bits are null.  No vectors: no rows, no centroids.  ``vectors`` is
    read three times; other columns are ignored.
    """
    spark = vectors.sparkSession
    good = vectors.where(complete(column, dim)).select(key, column)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    first = good.orderBy(rank.asc_nulls_last(), column).limit(k).select(column).collect()  # k rows
    schema = ", ".join([f"`{key}` {vectors.schema[key].dataType.simpleString()}", *map(" ".join, _ADDED)])
    if not first:
        return good.limit(0).select(key, *(F.lit(None).cast(t).alias(n) for n, t in _ADDED)), []
    start = whole_numbers(np.array([r[0] for r in first], dtype=np.float64).reshape(len(first), dim), scale)
    c = _integers(start)
    stored = stash(blocks_of(good, column), "vector-blocks")
    rows = stored.rdd.map(lambda r: np.frombuffer(r[0], dtype=np.float64).reshape(-1, dim))
    for _ in range(rounds):
        sums, counts, _ = _pass(spark, rows, c, scale)
        c = np.array([[s // int(n) for s in row] if n else old for row, n, old in zip(sums, counts, c, strict=True)], dtype=object)
    _, _, inertia = _pass(spark, rows, c, scale)
    shared = spark.sparkContext.broadcast((c, inertia))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, inertia = shared.value
        by = pa.array([_long(v) for v in inertia], pa.int64())
        every = _long(sum(inertia))
        for b in batches:
            x = b.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            own, far = nearest(whole_numbers(x, scale), c)
            long = pa.array([_long(int(v)) for v in far], pa.int64())
            number = pa.array(own.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), number, long, by.take(number), pa.array([every] * len(b), pa.int64())],
                [key, "cluster", "distance", "cluster_inertia", "inertia"],
            )

    return in_arrow(good, assign, schema), [[int(v) for v in row] for row in c]


def _long(v: int) -> int | None:
    return v if v <= _LONG else None


def _pass(spark: SparkSession, rows, c: np.ndarray, scale: int) -> tuple[list, list, list]:
    """Sums, counts and summed distances of the members of each centroid."""
    shared, k = spark.sparkContext.broadcast(c), len(c)

    def add(total: tuple, block: np.ndarray) -> tuple:
        x = whole_numbers(block, scale)
        own, far = nearest(x, shared.value)
        spent = np.zeros(k, dtype=object)
        np.add.at(spent, own, _integers(far))
        return total[0] + member_sums(x, own, k), total[1] + np.bincount(own, minlength=k), total[2] + spent

    zero = (np.zeros(c.shape, dtype=object), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=object))
    sums, counts, spent = rows.treeAggregate(zero, add, lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)), DEPTH)
    shared.unpersist()
    return sums.tolist(), counts.tolist(), spent.tolist()


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = kmeans(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    name = F.element_at(F.array(*map(F.lit, names)), F.col("cluster") + 1) if names else F.lit(None).cast("string")
    return found.withColumn("centroid_sha256", name)


def _rounds_sql(names: Sequence[str]) -> str:
    steps = []
    for n, m in zip(names, names[1:], strict=False):
        steps.append(
            f"""a{n} AS MATERIALIZED (
                SELECT row, arg_min(cluster, d * 16 + cluster) AS cluster FROM (
                    SELECT v.row, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
                    FROM vectors v, c{n} c) GROUP BY row),
            s{n} AS MATERIALIZED (
                SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (
                    SELECT a.cluster, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM a{n} a JOIN vectors v USING (row))
                GROUP BY cluster, i),
            m{n} AS MATERIALIZED (
                SELECT cluster, list(((s - ((s % n) + n) % n) // n)::HUGEINT ORDER BY i) AS q FROM s{n} GROUP BY cluster),
            c{m} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m USING (cluster))"""
        )
    return ",\n".join(steps)


#: The whole of it in SQL, round by round (vectors of ordinary size).
OP12_SQL = f"""
WITH kept AS (
    SELECT vec_id, embedding FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
vectors AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, embedding) - 1 AS row, vec_id,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS q
    FROM kept),
c0 AS MATERIALIZED (SELECT row AS cluster, q FROM vectors WHERE row < {CLUSTERS}),
{_rounds_sql([str(i) for i in range(ROUNDS + 1)])},
far AS MATERIALIZED (
    SELECT row, arg_min(cluster, d * 16 + cluster) AS cluster, min(d) AS distance FROM (
        SELECT v.row, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM vectors v, c{ROUNDS} c) GROUP BY row)
SELECT v.vec_id, f.cluster::INTEGER AS cluster, f.distance::BIGINT AS distance,
    sum(f.distance) OVER (PARTITION BY f.cluster)::BIGINT AS cluster_inertia, sum(f.distance) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM far f JOIN vectors v USING (row) JOIN c{ROUNDS} c ON c.cluster = f.cluster
"""
