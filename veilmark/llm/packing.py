"""Best-fit packing of documents into sequences by minimum bin slack.

Lengths are integers up to the capacity, so the packing needs only how many
pieces have each length: at most ``capacity`` numbers, whatever the corpus.  On
that histogram each bin is filled in turn: the longest piece left is taken, and a
bitset subset-sum over the lengths left finds the fullest combination that fits
beside it.  A combination is removed as often as the histogram allows, so the
plan is a bounded list of patterns.  Executors then hand the pieces to the places
of the plan by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.llm.shared import in_batches, stash, table
from veilmark.llm.tokens import encoder, vocabulary

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Rows of a length are ranked in buckets of about so many, 16 at least.
BUCKET_ROWS = 2_000
#: Rows a Python worker gets at once; bounds its memory with long texts.
BATCH_CHARS = 2_000_000


def fullest(free: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """The pieces with the largest sum up to ``free``, longer ones preferred.

    ``lengths`` falls.  Bit s of a layer says that sum s can be reached with the
    lengths up to it; the layers lead back from the best sum to its pieces.
    """
    usable = [x for x in lengths if x <= free and counts[x] > 0]
    mask = (1 << (free + 1)) - 1
    layers, reach = [], 1
    for x in usable:  # a sum is reached with the longest pieces that can make it
        layers.append(reach)
        left, step = min(counts[x], free // x), 1
        while left > 0 and not reach >> free & 1:
            take = min(step, left)
            reach |= (reach << (take * x)) & mask
            left, step = left - take, step * 2
        if reach >> free & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for x, before in zip(reversed(usable[: len(layers)]), reversed(layers), strict=True):
        while not before >> total & 1:
            chosen.append(x)
            total -= x
    return chosen


def slack_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack: (pieces of each length in a bin, number of such bins)."""
    counts = dict(histogram)
    order = sorted(counts, reverse=True)
    out = []
    while order:
        seed = order[0]
        counts[seed] -= 1
        chosen = [seed, *fullest(capacity - seed, order, counts)]
        counts[seed] += 1
        need = {x: chosen.count(x) for x in chosen}
        times = min(counts[x] // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= k * times
        out.append((need, times))
        order = [x for x in order if counts[x] > 0]
    return out


def decreasing_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on the histogram: bins of equal content are handled as one.

    A length goes into the bins with the least room that holds it, as often as
    it fits, then into new bins.
    """
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}  # by room left
    done = []
    for x in sorted(histogram, reverse=True):
        left, room = histogram[x], x
        while left:
            room = next((r for r in range(room, capacity + 1) if open_.get(r)), capacity)
            content, times = open_[room].pop() if open_.get(room) else ({}, left)
            per = min(room // x, left)
            used = min(times, left // per)
            if times > used and content:
                open_.setdefault(room, []).append((content, times - used))
            left -= used * per
            after = room - per * x
            (open_.setdefault(after, []) if after else done).append((content | {x: content.get(x, 0) + per}, used))
    return done + [p for rest in open_.values() for p in rest]


def plan_bins(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Rows (length, low, high, per_bin, first_bin, offset) of the packing.

    Pieces of a length with ranks in [low, high) go, ``per_bin`` at a time, into
    the bins from ``first_bin``, one behind the other from ``offset``.  Minimum bin slack
    makes the plan; where best fit decreasing needs fewer bins, its plan is taken.
    """
    counts = {x: n for x, n in histogram.items() if n > 0}
    size = lambda patterns: sum(times for _, times in patterns)
    patterns = min(slack_patterns(counts, capacity), decreasing_patterns(counts, capacity), key=size)
    given = dict.fromkeys(counts, 0)
    rows, bins = [], 0
    for need, times in patterns:
        offset = 0
        for x in sorted(need, reverse=True):
            k = need[x]
            rows.append((x, given[x], given[x] + k * times, k, bins, offset))
            given[x] += k * times
            offset += k * x
        bins += times
    return pd.DataFrame(rows, columns=["length", "low", "high", "per_bin", "first_bin", "offset"])


def rank_within(pieces: DataFrame, length: str, keys: list[str], most: int) -> DataFrame:
    """Adds ``rank`` from 0 within each length, without gathering a length.

    Rows are counted by (length, bucket) first; a row's rank is the rows in the
    buckets before plus its place in its own.  ``most``: rows of the commonest length.
    """
    buckets = max(16, -(-most // BUCKET_ROWS))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = bucketed.groupBy(length, "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(
        Window.partitionBy(length).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(length, "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(length, "bucket").orderBy(*keys)) - 1
    return (
        bucketed.withColumn("within", within)
        .join(starts, [length, "bucket"])
        .withColumn("rank", F.col("before") + F.col("within"))
        .drop("bucket", "within", "before")
    )


def pack(pieces: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with lengths 1..capacity.

    ``pieces`` is read three times: give a table.  ``keys`` name a row; rows that
    repeat a key are packed as well, each in a place of its own.  Null or
    non-positive lengths get null places; longer ones than ``capacity`` fail.
    """
    spark = pieces.sparkSession
    fit = F.col(length) > 0
    histogram = {
        int(r[0]): int(r[1])  # at most `capacity` rows
        for r in pieces.where(fit).groupBy(length).agg(F.count(F.lit(1))).collect()
    }
    if histogram and max(histogram) > capacity:
        raise ValueError(f"a piece is longer than {capacity}")
    plan = plan_bins(histogram, capacity).sort_values(["length", "low"], kind="stable")
    shared = spark.sparkContext.broadcast({c: plan[c].to_numpy(np.int64) for c in plan})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        code = p["length"] << 44 | p["low"]
        for b in batches:
            at = np.searchsorted(code, b[length].to_numpy(np.int64) << 44 | b["rank"].to_numpy(np.int64), side="right") - 1
            turn = b["rank"].to_numpy(np.int64) - p["low"][at]
            b["sequence_id"] = p["first_bin"][at] + turn // p["per_bin"][at]
            b["offset"] = p["offset"][at] + turn % p["per_bin"][at] * p["length"][at]
            yield b.drop(columns="rank")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    ranked = rank_within(pieces.where(fit), length, keys, max(histogram.values(), default=0)).select(*pieces.columns, "rank")
    placed = in_batches(ranked, place, f"{schema}, sequence_id long, offset long")
    unfit = pieces.where(~F.coalesce(fit, F.lit(False)))
    nothing = F.lit(None).cast("long")
    return placed.unionByName(unfit.withColumns({"sequence_id": nothing, "offset": nothing}))


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenises ``docs`` (doc_id, text) into pieces of at most ``capacity`` ids.

    A null text counts as empty and an empty one has the end id alone.  Longer
    documents are cut so that only the first piece may be shorter.  Rows:
    doc_id, piece, start, length, ids_crc32.  Other columns are ignored.
    """
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, drops_space=False)
        for b in batches:
            texts, doc_ids = b["text"].fillna("").tolist(), b["doc_id"].tolist()
            rows, begin = [], 0
            while begin < len(texts):
                stop, chars = begin, 0
                while stop < len(texts) and (stop == begin or chars + len(texts[stop]) <= BATCH_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                ids, counts = enc.encode(texts[begin:stop])
                upto = 0
                for doc_id, n in zip(doc_ids[begin:stop], counts.tolist(), strict=True):
                    own = np.append(ids[upto : upto + n], end_id).astype("<u4")
                    upto += n
                    start, piece = 0, 0
                    while start < len(own):
                        end = start + ((len(own) - start - 1) % capacity + 1)
                        rows.append((doc_id, piece, start, end - start, zlib.crc32(own[start:end].tobytes())))
                        start, piece = end, piece + 1
                begin = stop
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack whole documents; see :func:`cut_pieces`, :func:`pack`."""
    return pack(stash(cut_pieces(docs, capacity, path), "pieces"), ["doc_id", "piece"], capacity=capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


