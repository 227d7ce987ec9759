"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector o is rotated and kept as the signs of its components, x = signs /
sqrt(D), with the correction factor f = <o, x>.  For a unit vector q, <q, x> / f is
an unbiased estimate of <q, o>; its error beside the true cosine c is about
sqrt(1 - c^2) * sqrt(1 / f^2 - 1) / sqrt(D - 1).  A pair with c at the threshold or
above so lies above a known bound but with a tiny probability (``SIGMAS``
standard errors); pairs below it are dropped, the rest recomputed exactly.

Each vector is encoded once: its packed signs (a bit a dimension) and factor are kept in
a table.  Pairs to estimate come from coarse cells: each vector has a home cell and its
code is posted to all cells whose border it is so near that a vector linked with it could
lie beyond (Cauchy-Schwarz: no link is lost, however the vectors lie).  A vector's links
are counted in its home cell.  Small cells lie together in shards, which a code is
posted to once; shards are cut into blocks on both sides.

The first pass sees codes and names the vectors of a block that have a pair above the
bound; only theirs are fetched in full for the second, which recomputes those pairs.
Tasks return names, counts a vector and edges that span what is linked, never the pairs.
Equal vectors are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.shared import components, discard, stash, table
from veilmark.llm.vectors import centroids, matrix, rotation, sample, unit, usable

THRESHOLD = 0.9
SIGMAS = 6.0
CELL_ROWS = 1_024
MAX_CELLS = 256
HOME_BLOCK = 8_192
POSTED_BLOCK = 16_384
_CHUNK = 128
_CODES = 4_096


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of rotated unit vectors, a row each, and their correction factors."""
    turned = x @ rotation(x.shape[1]).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def decode(bits: np.ndarray, factor: np.ndarray, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Corrected codes, whose products with rotated vectors estimate cosines, and the
    estimates below which a pair lies surely below the threshold."""
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    spread = np.sqrt(np.maximum(1 / factor**2 - 1, 0)) / np.sqrt(max(1, dim - 1))
    bound = threshold - np.sqrt(1 - threshold**2) * SIGMAS * spread - 1e-6
    return signs / (factor * np.sqrt(dim)).astype(np.float32)[:, None], bound.astype(np.float32)


def screen(queries: np.ndarray, bits: np.ndarray, factor: np.ndarray, same: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rotated home vectors and which posted codes have a pair above its bound.

    ``same[i]`` is the place of home vector i among the codes, or -1; it is no pair.
    """
    asked, met = np.zeros(len(queries), dtype=bool), np.zeros(len(bits), dtype=bool)
    for c in range(0, len(bits), _CODES):
        scaled, bound = decode(bits[c : c + _CODES], factor[c : c + _CODES], queries.shape[1], threshold)
        for a in range(0, len(queries), _CHUNK):
            hit = queries[a : a + _CHUNK] @ scaled.T >= bound
            own = same[a : a + _CHUNK] - c
            here = np.flatnonzero((own >= 0) & (own < len(scaled)))
            hit[here, own[here]] = False
            asked[a : a + _CHUNK] |= hit.any(axis=1)
            met[c : c + _CODES] |= hit.any(axis=0)
    return asked, met


def count_links(
    home: np.ndarray, posted: np.ndarray, bits: np.ndarray, factor: np.ndarray, weights: np.ndarray, same: np.ndarray, threshold: float
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted links of each home row, and (home, posted) edges that span them.

    Rows are unit vectors, ``bits`` and ``factor`` the codes of the posted ones;
    ``same[i]`` is the place of home row i among the posted ones, or -1.
    """
    scaled, bound = decode(bits, factor, home.shape[1], threshold)
    queries = (home @ rotation(home.shape[1]).T).astype(np.float32)
    links = np.zeros(len(home), dtype=np.int64)
    label = np.arange(len(home) + len(posted))
    for i in np.flatnonzero(same >= 0):
        label[len(home) + same[i]] = i
    edges = []
    for a in range(0, len(home), _CHUNK):
        i, j = np.nonzero(queries[a : a + _CHUNK] @ scaled.T >= bound)
        i += a
        for k in range(0, len(i), 200_000):
            x, y = i[k : k + 200_000], j[k : k + 200_000]
            sure = ((home[x] * posted[y]).sum(axis=1) >= threshold) & (same[x] != y)
            x, y = x[sure], y[sure]
            np.add.at(links, x, weights[y])
            while True:
                lx, ly = label[x], label[len(home) + y]
                new = np.flatnonzero(lx != ly)
                if not len(new):
                    break
                # each tree of ly joins one tree of lx in a round
                _, pick = np.unique(np.maximum(lx[new], ly[new]), return_index=True)
                new = new[pick]
                to = np.arange(len(label))
                to[np.maximum(lx[new], ly[new])] = np.minimum(lx[new], ly[new])
                while (to[to] != to).any():
                    to = to[to]
                label = to[label]
                edges += zip(x[new].tolist(), y[new].tolist(), strict=True)
    return links, edges


def lay_cells(counted: dict[int, tuple[int, int]]) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Puts cells with (home rows, posted rows) into shards of up to ``HOME_BLOCK`` home rows.

    Returns each cell's shard, consecutive cells in consecutive shards, and for each
    shard the numbers of its home blocks and posted blocks.  Cells below 0, of other
    dimensions, stay apart.
    """
    place: dict[int, int] = {}
    homes: dict[int, int] = {}
    posts: dict[int, int] = {}
    total = sum(h for cell, (h, _) in counted.items() if cell >= 0)
    last = -1
    for cell in sorted(counted):
        h, p = counted[cell]
        if cell < 0:
            shard = cell
        elif last >= 0 and homes[last] + h <= HOME_BLOCK:
            shard = last
        else:
            shard = last = last + 1
        place[cell] = shard
        homes[shard] = homes.get(shard, 0) + h
        posts[shard] = posts.get(shard, 0) + p
    most = {s: p if s < 0 else min(p, total) for s, p in posts.items()}
    return place, {s: (max(1, -(-homes[s] // HOME_BLOCK)), max(1, -(-most[s] // POSTED_BLOCK))) for s in homes}


def embedding_near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per vector: key, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components have no links
    and are their own component.  Vectors of different length don't link.  Each
    row gives a row; ``key`` is a unique integer, rows without it link with nothing,
    have no component and are not kept.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col(key).alias("id"), F.col(column).alias("v"))
    fit = usable("v") & F.col("id").isNotNull()
    good = every.where(fit)
    classes = stash(
        good.groupBy("v").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies")), "vector-classes"
    )
    _, some = sample(classes, "head", "v")
    n = classes.count()
    cells = centroids(some, min(MAX_CELLS, max(1, n // CELL_ROWS))) if len(some) else np.zeros((1, 1))
    dim = cells.shape[1]
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))  # the distance of linked vectors, at most
    apart = np.sqrt(np.maximum(2 - 2 * cells @ cells.T, 1e-12))
    shared = spark.sparkContext.broadcast(cells)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["v"].map(len).to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = unit(matrix(b["v"].iloc[at]))
                home, close = np.full(len(x), -int(d)), np.zeros((len(x), 1), dtype=bool)
                if d == dim:
                    score = x @ shared.value.T
                    home = score.argmax(axis=1)
                    own = np.take_along_axis(score, home[:, None], axis=1)
                    close = (own - score) <= reach * apart[home] + 1e-9
                bits, factor = encode(x)
                yield pd.DataFrame(
                    {
                        "head": b["head"].to_numpy()[at], "copies": b["copies"].to_numpy()[at], "home": home,
                        "near": [r.tobytes() for r in np.packbits(close, axis=1)],
                        "bits": [r.tobytes() for r in bits], "factor": factor, "u": [r.tobytes() for r in x],
                    }
                )

    coded = stash(
        classes.select("head", "copies", "v").mapInPandas(
            code, "head long, copies long, home long, near binary, bits binary, factor double, u binary"
        ),
        "vector-codes",
    )

    def cells_near(b: pd.DataFrame) -> np.ndarray:
        """Marks of the cells each vector is posted to; vectors of other dimensions lie in none."""
        close = np.zeros((len(b), len(shared.value)), dtype=bool)
        main = np.flatnonzero(b["home"].to_numpy() >= 0)
        if len(main):
            packed = np.array([np.frombuffer(r, np.uint8) for r in b["near"].iloc[main]])
            close[main] = np.unpackbits(packed, axis=1, count=close.shape[1]).astype(bool)
        return close

    def count_posts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            home, close = b["home"].to_numpy(), cells_near(b)
            odd, rows = np.unique(home[home < 0], return_counts=True)
            yield pd.DataFrame(
                {
                    "cell": [*range(close.shape[1]), *odd],
                    "homes": [*np.bincount(home[home >= 0], minlength=close.shape[1]), *rows],
                    "posts": [*close.sum(axis=0), *rows],
                }
            )

    cell_rows = {
        r["cell"]: (r["h"], r["p"])
        for r in coded.select("home", "near").mapInPandas(count_posts, "cell long, homes long, posts long")
        .groupBy("cell").agg(F.sum("homes").alias("h"), F.sum("posts").alias("p")).collect()  # one row a cell
    }
    place, sizes = lay_cells(cell_rows)
    main_place = np.array([place[c] for c in sorted(place) if c >= 0], dtype=np.int64)
    first = np.flatnonzero(np.diff(main_place, prepend=-1))  # a shard's first cell

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Codes to the shards they are posted to, rotated vectors to their home shards."""
        step = max(64, 100_000 // max(1, len(first)))
        for whole in batches:
            for a in range(0, len(whole), step):
                b = whole.iloc[a : a + step]
                home, close = b["home"].to_numpy(), cells_near(b)
                close = np.logical_or.reduceat(close, first, axis=1) if len(first) else close
                mixed = b["head"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                row, shard = np.nonzero(close)
                odd = np.flatnonzero(home < 0)
                row, shard = np.concatenate([row, odd]), np.concatenate([shard, home[odd]])
                hs, ps = np.array([sizes[c] for c in shard.tolist()], dtype=np.int64).reshape(-1, 2).T
                ends = np.cumsum(hs)
                r = np.repeat(row, hs)
                yield pd.DataFrame(
                    {
                        "shard": np.repeat(shard, hs), "i": np.arange(len(r)) - np.repeat(ends - hs, hs),
                        "j": np.repeat((mixed[row] >> np.uint64(40)).astype(np.int64) % ps, hs),
                        "head": b["head"].to_numpy()[r], "bits": b["bits"].to_numpy()[r], "factor": b["factor"].to_numpy()[r],
                        "q": None,
                    }
                )
                own = np.array([place[c] for c in home.tolist()])
                hs, ps = np.array([sizes[c] for c in own.tolist()], dtype=np.int64).T
                queries = []
                for u in b["u"]:
                    x = np.frombuffer(u)
                    queries.append((rotation(len(x)) @ x).astype(np.float32).tobytes())
                ends = np.cumsum(ps)
                r = np.repeat(np.arange(len(b)), ps)
                yield pd.DataFrame(
                    {
                        "shard": own[r], "i": ((mixed >> np.uint64(16)).astype(np.int64) % (1 << 24) % hs)[r],
                        "j": np.arange(len(r)) - np.repeat(ends - ps, ps), "head": b["head"].to_numpy()[r],
                        "bits": None, "factor": None, "q": np.array(queries, dtype=object)[r],
                    }
                )

    def places(h: pd.Series, p: pd.Series) -> np.ndarray:
        at = {int(k): n for n, k in enumerate(p)}
        return np.array([at.get(int(k), -1) for k in h])

    def packed(b: pd.Series) -> np.ndarray:
        return np.array([np.frombuffer(x, np.uint8) for x in b])

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["q"].notna().to_numpy()
        h, p = rows[asks], rows[~asks]
        if not len(h) or not len(p):
            return pd.DataFrame({"shard": [], "i": [], "j": [], "head": [], "asks": []})
        queries = np.array([np.frombuffer(q, np.float32) for q in h["q"]])
        asked, met = screen(queries, packed(p["bits"]), p["factor"].to_numpy(), places(h["head"], p["head"]), threshold)
        out = pd.concat([h[asked].assign(asks=True), p[met].assign(asks=False)])
        return out[["shard", "i", "j", "head", "asks"]]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        h, p = rows[rows["asks"]], rows[~rows["asks"]]
        x, y = (np.array([np.frombuffer(u) for u in t["u"]]) for t in (h, p))
        links, edges = count_links(
            x, y, packed(p["bits"]), p["factor"].to_numpy(), p["copies"].to_numpy(), places(h["head"], p["head"]), threshold
        )
        ids, others = h["head"].tolist(), p["head"].tolist()
        out = [(k, int(n), None) for k, n in zip(ids, links, strict=True) if n]
        out += [(ids[a], None, others[b]) for a, b in edges]
        return pd.DataFrame(out, columns=["head", "links", "other"]).astype({"links": "Int64", "other": "Int64"})

    block = ("shard", "i", "j")
    picked = stash(
        coded.select("head", "home", "near", "bits", "factor", "u")
        .mapInPandas(deal, "shard long, i long, j long, head long, bits binary, factor double, q binary")
        .groupBy(*block).applyInPandas(pick, "shard long, i long, j long, head long, asks boolean"),
        "vectors-picked",
    )
    found = stash(
        picked.join(coded.select("head", "copies", "bits", "factor", "u"), "head")
        .groupBy(*block).applyInPandas(compare, "head long, links long, other long"),
        "vector-links",
    )
    discard(picked, coded)
    counted = found.where("links is not null").groupBy("head").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("head").alias("src"), F.col("other").alias("dst")))
    named = (
        classes.join(counted, "head", "left")
        .join(joined.withColumnRenamed("node", "head"), "head", "left")
        .select(
            "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "head").alias("component_id"),
        )
    )
    ok = good.join(named, "v").select(F.col("id").alias(key), "n_links", "component_id")
    bad = every.where(~fit).select(
        F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return ok.union(bad).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))
