"""Quality classifier: naive Bayes features in a linear support vector machine.

Indicators of hashed n-grams are scaled by the log ratio of their counts in the
two classes, and a hinge-loss model is fitted on them by dual coordinate descent.
N-grams are of words (one and two) and of word shapes (one to three): a shape is a
word's case, length class and trailing marks, and whether it repeats the word before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.llm.shared import crc_bucket, in_batches, table
from veilmark.llm.texthash import blocks, mix, slice_hashes

BITS = 18
#: Labelled documents learnt from, at most.
TRAIN_ROWS = 6_000
#: Features of all of them, at most (160 MB).
FEATURES = 40_000_000
EPOCHS = 15
COST = 0.1
SMOOTHING = 1.0
CUT = 0.3
_TAIL = 3


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, in one array, and their counts."""
    parts, counts = [], []
    U = np.uint64
    for a, b in blocks(texts):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
        data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        bounds = np.cumsum([0, *[len(r) + 1 for r in raw]])
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            parts.append(np.empty(0, np.int64))
            counts.append(np.zeros(b - a, np.int64))
            continue
        at = np.searchsorted(starts, bounds)
        owner = np.repeat(np.arange(b - a), np.diff(at))
        upper = (data >= 65) & (data <= 90)
        letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
        word = slice_hashes(np.where(upper, data + 32, data).astype(np.uint8), starts, ends)
        size = ends - starts
        tail = np.zeros(len(starts), dtype=np.uint64)
        open_ = np.ones(len(starts), dtype=bool)
        for k in range(1, _TAIL + 1):
            place = np.maximum(ends - k, starts)
            open_ &= (size >= k) & ~letter[place]
            tail = tail * U(256) + np.where(open_, data[place], 0).astype(np.uint64)
        ups = np.concatenate([[0], np.cumsum(upper)])
        many = (ups[ends] - ups[starts]) * 2 > size
        again = np.concatenate([[False], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])])
        shape = mix(
            tail * U(64) + np.minimum(size // 4, 7).astype(np.uint64) * U(8)
            + upper[starts].astype(np.uint64) * U(4) + many.astype(np.uint64) * U(2) + again.astype(np.uint64)
        )
        grams = [(word, owner), (shape + U(1), owner)]
        same = owner[1:] == owner[:-1]
        grams.append((mix(word[:-1] * U(3) + word[1:])[same], owner[1:][same]))
        pair = mix(shape[:-1] * U(5) + shape[1:])
        grams.append((pair[same], owner[1:][same]))
        if len(pair) > 1:
            three = owner[2:] == owner[:-2]
            grams.append((mix(pair[:-1] * U(7) + shape[2:])[three], owner[2:][three]))
        both = np.concatenate([(o.astype(np.uint64) << U(bits)) | (mix(h) >> U(64 - bits)) for h, o in grams])
        both = np.unique(both)
        parts.append((both & U((1 << bits) - 1)).astype(np.int64))
        counts.append(np.bincount((both >> U(bits)).astype(np.int64), minlength=b - a))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(parts), np.concatenate(counts)


def fit_hinge(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float, epochs: int, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of the linear hinge-loss model.

    Dual coordinate descent over rows of indicator features with ``values``.
    Costs are weighted so that the classes count alike.
    """
    weight = np.zeros(len(values) + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([(values[r] ** 2).sum() + 1.0 for r in rows])
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    top = cost * 0.5 / np.maximum(share, 1e-9)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            scaled = values[r]
            slope = y[i] * (weight[r] @ scaled + weight[-1]) - 1
            then = min(max(alpha[i] - slope / norm[i], 0.0), top[i])
            if then != alpha[i]:
                step = (then - alpha[i]) * y[i]
                weight[r] += step * scaled
                weight[-1] += step
                alpha[i] = then
    return weight


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn decision values into probabilities (Newton steps)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    aim = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - aim) + 1e-3 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(hess, grad)
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Weights by feature, then bias, slope and shift of the probability.

    With labels of one class only, every score is that class's share.
    """
    n = 1 << bits

    def scaled(part: np.ndarray) -> np.ndarray:
        sums = [
            SMOOTHING + np.bincount(np.concatenate([rows[i] for i in part if y[i] == s] or [np.empty(0, np.int64)]), minlength=n)
            for s in (1, -1)
        ]
        return np.log(sums[0] / sums[0].sum()) - np.log(sums[1] / sums[1].sum())

    every = np.arange(len(rows))
    if len(set(y.tolist())) < 2:
        sure = 0.5 if not len(y) else float((y > 0).mean())
        return np.concatenate([np.zeros(n + 1), [0.0, np.log((sure + 1e-3) / (1 - sure + 1e-3))]])
    inner, outer = every[every % 4 != 0], every[every % 4 == 0]
    ratio = scaled(inner)
    trial = fit_hinge([rows[i] for i in inner], ratio, y[inner], COST, EPOCHS)
    at = np.array([(trial[rows[i]] * ratio[rows[i]]).sum() + trial[-1] for i in outer])
    slope, shift = fit_logistic(at, y[outer])
    ratio = scaled(every)
    weight = fit_hinge(rows, ratio, y, COST, EPOCHS)
    return np.concatenate([weight[:-1] * ratio, [weight[-1], slope, shift]])


def train(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_ROWS) -> np.ndarray:
    """Fits on at most ``limit`` labelled documents with ``FEATURES`` features in all.

    They come in an order fixed by a hash of doc_id.  Repeated labels of a document count
    by their mean; null ones don't.  Of rows that repeat a doc_id, the text that is first in
    the alphabet counts; a null text is empty.  Rows are turned into features on
    the executors, the bounded sample is fitted here.
    """
    one = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).alias("y"))
    rank = F.xxhash64("doc_id", F.lit("quality"))
    drawn = one.where("doc_id is not null").orderBy(rank, "doc_id").limit(limit)
    every = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # `limit` rows at most
    some = every.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, count = features([t if isinstance(t, str) else "" for t in b["text"].tolist()])
            ends = np.cumsum(count)
            rows = [found[e - c : e].astype(np.int32).tobytes() for e, c in zip(ends, count, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "f": rows})

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = in_batches(some, run, f"doc_id {kind}, y boolean, f binary")
    upto = F.sum(F.length("f")).over(Window.orderBy(rank, "doc_id"))  # of `limit` rows
    got = made.withColumn("upto", upto).where(F.col("upto") <= 4 * FEATURES).orderBy("doc_id").collect()
    rows = [np.frombuffer(r["f"], np.int32).astype(np.int64) for r in got]
    return fit(rows, np.array([1 if r["y"] else -1 for r in got]))


def score_documents(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """Adds ``score`` to ``docs`` (any columns, one named text), from 0 to 1.

    Whole texts are scored; null and empty ones get the score of no features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    keep = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        bias, slope, shift = w[-3:]
        for b in batches:
            found, count = features([t if isinstance(t, str) else "" for t in b["text"].tolist()], bits)
            owner = np.repeat(np.arange(len(count)), count)
            value = np.bincount(owner, weights=w[found], minlength=len(count)) + bias
            yield b[keep].assign(score=1 / (1 + np.exp(-np.clip(slope * value + shift, -30, 30))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return in_batches(docs.select(*keep), run, f"{schema}, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_bucket("doc_id", 5)
    weights = train(docs, labels.where(fold != 0), "quality")
    scored = score_documents(docs.select("doc_id", (fold == 0).alias("held_out"), "text"), weights)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
