"""Nearest neighbours by inner product with an adaptive scan of dimensions.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries a
zero: then the nearest by distance are those with the largest inner product.  (Few vectors
with norms far beyond the others' are cut to M for the lists and never abandoned.)  So the
coarse lists (spherical k-means on a bounded sample of such vectors) know norms, too.  How many
lists a query probes is measured on the sample: enough to hold ``RECALL`` of the sample's own
best pairs.  Within a probed list, randomly rotated vectors stand in blocks of columns.  After
d of D columns the squared distance is estimated as D/d times the partial one, whose relative
error is about 1/sqrt(d); the hypothesis that a candidate is within the query's bound
is rejected, and the candidate abandoned, when the estimate exceeds the bound by the factor
(1 + EPSILON / sqrt(d))^2.  What survives is scored exactly on the original vectors.  The
bound is the 2k-th best of those sample rows that lie in the lists a query probes, so enough
candidates reach it and most don't.  It rises with what a task finds: a task has several
lists of a shard, scans those a query probes from the nearest on, and returns the query's
best of them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.llm.shared import stash, table
from veilmark.llm.vectors import centroids, matrix, rotation, sample, unit, usable

NEAREST = 20
MAX_LISTS = 1_024
#: Share of the sample's best pairs that the probed lists hold, and sample rows that ask.
RECALL, MEASURED = 0.96, 512
#: Errors of the estimated distance that a candidate may exceed the bound by.
EPSILON = 2.1
#: Norms beyond so many medians don't count for the largest.
FAR = 4.0
#: Lists lie together in shards of about so many rows; queries meet them in blocks.
SHARD_ROWS = 40_000
QUERY_BLOCK = 2_048
COLUMNS = 16


def norms(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1)  # so that squares neither over- nor underflow
    return np.sqrt(((x / scale[:, None]) ** 2).sum(axis=1)) * scale


def common_top(x: np.ndarray) -> float:
    """The largest norm, or ``FAR`` times the median one where some are larger."""
    size = norms(x)
    return float(min(size.max(), FAR * np.median(size)))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors over ``top`` with the component that makes them unit vectors; longer ones are cut to ``top``."""
    x = x / (np.maximum(norms(x) / top, 1.0) * top)[:, None]
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))])


class ListBlock:
    """A block of a list: lifted and rotated vectors by column blocks, and the originals."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.dim = x.shape[1] + 1
        self.top = common_top(x)
        self.longer = norms(x) > self.top * (1 + 1e-9)  # these are scored without a test
        turned = lifted(x, self.top) @ rotation(self.dim).T
        self.cuts = [*range(0, self.dim, COLUMNS), self.dim]
        self.parts = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.squares = [(p * p).sum(axis=1) for p in self.parts]

    def search(self, query_id: int, q: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the block's candidates for the best ``k``."""
        alive = np.arange(len(self.ids))
        over = q / self.top
        turned = rotation(self.dim)[:, :-1] @ over
        radius = max(0.0, float(over @ over) + 1.0 - 2.0 * (bound / self.top / self.top)) + 1e-9
        partial = np.zeros(len(alive))
        for n, part in enumerate(self.parts):
            a, b = self.cuts[n], self.cuts[n + 1]
            aim = turned[a:b]
            every = len(alive) == len(part)
            inner, own = (part @ aim, self.squares[n]) if every else (part[alive] @ aim, self.squares[n][alive])
            partial = partial + own - 2.0 * inner + aim @ aim
            keep = partial * (self.dim / b) <= radius * (1.0 + EPSILON / np.sqrt(b)) ** 2
            keep |= self.longer[alive]
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        alive = alive[self.ids[alive] != query_id]
        score = (self.x[alive] * q).sum(axis=1)
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best]


def measured_probes(some: np.ndarray, home: np.ndarray, lists: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Lists that queries must probe so that ``recall`` of the sample's best pairs lie in them.

    Evenly spread sample rows ask for their ``k`` best others in the sample; such pairs are
    further apart than those of the whole table, so they need rather more lists.
    """
    asked = np.linspace(0, len(some) - 1, min(len(some), MEASURED)).astype(int)
    score = some[asked] @ some.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(some) - 1)
    if k < 1:
        return len(lists)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.argsort(-(unit(some[asked]) @ lists[:, :-1].T), axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(len(lists))[None, :].repeat(len(asked), axis=0), axis=1)
    needed = np.sort(np.take_along_axis(turn, home[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def lay_shards(counted: dict[int, tuple[int, int]]) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """Puts lists with (rows, queries) into shards of about ``SHARD_ROWS`` rows.

    Returns each list's first shard and number of shards (a large list has several of
    its own), and for each shard in how many blocks its queries come.  Lists of one
    dimension share shards; others stay apart.
    """
    place: dict[int, tuple[int, int]] = {}
    rows: list[int] = []
    queries: list[int] = []
    for cell in sorted(counted):
        n, q = counted[cell]
        parts = max(1, -(-n // SHARD_ROWS))
        if parts == 1 and rows and cell > 0 and rows[-1] + n <= SHARD_ROWS:
            place[cell] = (len(rows) - 1, 1)
            rows[-1] += n
            queries[-1] = max(queries[-1], q)
            continue
        place[cell] = (len(rows), parts)
        rows += [n if parts == 1 else SHARD_ROWS] * parts
        queries += [q] * parts
    return place, [max(1, -(-q // QUERY_BLOCK)) for q in queries]


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", column: str = "embedding", k: int = NEAREST, probed: float | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` best candidates found.

    Queries are the rows where ``is_query`` holds, candidates every row but the
    query itself.  Vectors that are null, zero or hold null or non-finite
    components take no part; vectors of another length than most have a list of
    their own, which only queries of that length probe.  Fewer than ``k``
    candidates: all of them.  Ties go to the smaller key, a unique integer; rows
    without it take no part.  ``probed``: the share of lists that a query probes, measured
    where it isn't given.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(key).alias("id"), F.col(column).alias("v"), is_query.alias("ask")).where(usable("v") & F.col("id").isNotNull())
    n = good.count()
    ids, some = sample(good, "id", "v")
    dim, top = some.shape[1], common_top(some) if len(some) else 1.0
    lists = centroids(lifted(some, top), min(MAX_LISTS, max(1, int(np.sqrt(n) / 4)))) if len(some) else np.zeros((1, dim + 1))
    home = (lifted(some, top) @ lists.T).argmax(axis=1) if len(some) else np.zeros(0, dtype=np.int64)
    share = measured_probes(some, home, lists, k) if probed is None and len(some) else int(np.ceil(len(lists) * (probed or 1.0)))
    probes = min(len(lists), max(1, share))
    shared = spark.sparkContext.broadcast((lists, some, home))

    def own_list(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Each row's list, and how a query ranks the lists."""
        size = b["v"].map(len).to_numpy()
        own, score = -size, np.full((len(b), len(shared.value[0])), -np.inf)
        main = np.flatnonzero(size == dim)
        if len(main):
            x = matrix(b["v"].iloc[main])
            own = own.copy()
            own[main] = (lifted(x, top) @ shared.value[0].T).argmax(axis=1)
            score[main] = unit(x) @ shared.value[0][:, :-1].T
        return own, score

    def probe(own: np.ndarray, score: np.ndarray) -> list[list[int]]:
        every = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        return [[int(o)] if o < 0 else every[r].tolist() for r, o in enumerate(own)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, score = own_list(b)
            ask = b["ask"].to_numpy(bool)
            cell, rows = np.unique(own, return_counts=True)
            asked = [c for p in probe(own[ask], score[ask]) for c in p]
            qcell, qrows = np.unique(np.asarray(asked, dtype=np.int64), return_counts=True)
            yield pd.DataFrame({"cell": [*cell, *qcell], "rows": [*rows, *[0] * len(qcell)], "asks": [*[0] * len(cell), *qrows]})

    counted = {
        r["cell"]: (r["n"], r["q"])
        for r in good.mapInPandas(count, "cell long, rows long, asks long")
        .groupBy("cell").agg(F.sum("rows").alias("n"), F.sum("asks").alias("q")).collect()  # one row a list
    }
    place, asks = lay_shards(counted)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["shard", "block", "id", "cell", "bound", "cells", "x"]
        for b in batches:
            own, score = own_list(b)
            ask = b["ask"].to_numpy(bool)
            x = [np.asarray(v, dtype=np.float64) for v in b["v"]]
            rows = []
            for r, (i, c) in enumerate(zip(b["id"].tolist(), own.tolist(), strict=True)):
                first, parts = place[c]
                shard = first + i * 2654435761 % 4294967291 % parts
                rows += [(shard, k, i, c, None, None, x[r].tobytes()) for k in range(asks[shard])]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            asking = np.flatnonzero(ask)
            for a in range(0, len(asking), 256):
                part = asking[a : a + 256]
                probing = probe(own[part], score[part])
                main = [n for n, r in enumerate(part) if own[r] >= 0]
                bound = {}
                if main and len(shared.value[1]) > 2 * k:  # more than k: the query is among them
                    got = np.array([x[part[n]] for n in main]) @ shared.value[1].T
                    open_ = np.zeros((len(main), len(lists)), dtype=bool)
                    for m, n in enumerate(main):
                        open_[m, probing[n]] = True
                    got[~open_[:, shared.value[2]]] = -np.inf
                    kth = -np.partition(-got, 2 * k, axis=1)[:, 2 * k]
                    bound = dict(zip((int(part[n]) for n in main), kth.tolist(), strict=True))
                for r, cells in zip(part, probing, strict=True):
                    i = int(b["id"].iloc[r])
                    by_shard: dict[int, list[int]] = {}
                    for c in cells:
                        first, parts = place.get(c, (0, 0))
                        for shard in range(first, first + parts):
                            by_shard.setdefault(shard, []).append(c)
                    for shard, cs in by_shard.items():
                        block = i * 2654435761 % 4294967279 % asks[shard]
                        rows.append((shard, block, i, None, bound.get(int(r), -np.inf), np.array(cs, dtype=np.int32).tobytes(), x[r].tobytes()))
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows["bound"].notna()
        c, q = rows[~asked], rows[asked]
        found: list[tuple] = []
        if len(c) and len(q):
            blocks = {
                int(cell): ListBlock(g["id"].to_numpy(np.int64), np.array([np.frombuffer(v) for v in g["x"]]))
                for cell, g in c.groupby("cell")
            }
            for i, bound, cells, raw in zip(q["id"].tolist(), q["bound"].tolist(), q["cells"], q["x"], strict=True):
                v = np.frombuffer(raw)
                ids, scores = np.empty(0, np.int64), np.empty(0)
                for cell in np.frombuffer(cells, np.int32).tolist():
                    if cell in blocks:
                        got, score = blocks[cell].search(i, v, bound, k)
                        ids, scores = np.concatenate([ids, got]), np.concatenate([scores, score])
                        best = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[best], scores[best]
                        if len(ids) == k:
                            bound = max(bound, float(scores[-1]))
                found += [(i, int(g), float(s)) for g, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    hits = good.mapInPandas(
        deal, "shard long, block long, id long, cell long, bound double, cells binary, x binary"
    ).groupBy("shard", "block").applyInPandas(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = stash(hits, "hits").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
