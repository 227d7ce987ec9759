"""Similarity join on word shingles with token-combination prefixes.

Two documents link when the Jaccard similarity of their shingle sets reaches the
threshold.  Sets that are equal are one class; only a class's smallest document (its
head) is compared.  Shingles ("tokens") are ordered by class and then by their hash:
rare ones first, frequent ones last.

The index.  Of two linked sets x and y, the first |x| - ceil(t|x|) + 1 tokens of x (its
prefix) and those of y share a token.  A set whose prefix holds rare tokens only
posts these, one by one.  A set whose prefix reaches into the frequent class holds all
its rare tokens there and posts them; and the prefix is extended over its frequent
tokens, of which neighbours in the order are posted as pairs.  Either a rare token is
shared, or all that x and y share is frequent.  Then at most U = |x| + |y| - 2 * overlap
tokens of either stand between the shared ones, so among the first U + 2 shared ones two
are neighbours in both sets; they lie within the first 2 (1 - t) |x| + 2 tokens less
twice the rare ones.  The index is linear in the tokens, and one very common token alone
makes no candidates.

Verification.  Sets that share an index entry are candidates.  Each is first paired
with one leader of each of its entries, which is linear in the index and joins large
groups of near copies.  Entries whose sets are by then in one component are done; of the
others only pairs of sets in different components count, after further leaders while
these entries are large.  For each pair the entries that it shares are counted; of
the tokens that both hold, all but the last ones of one set are among them, so a low count
rules the pair out.  What is left is compared whole.  Shingles are known by keyed hashes
of 64 bits, sets by two sums of 64 bits and their size.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.llm.shared import components, discard, in_batches, release, stash, table
from veilmark.llm.texthash import mix, shingle_sets

SIZE = 5
#: The similarity as a ratio of integers.
THRESHOLD = (75, 100)
#: A token of more sets than this is of the frequent class ...
FREQUENT = 64
#: ... at least if it makes up more than this share (one in so many) of all tokens,
#: which bounds the number of frequent tokens, too: 8 MB of hashes.
SHARE = 1_000_000
#: Characters of a block of texts.
BLOCK_CHARS = 2_000_000
#: Pairs that open entries may hold in all, by postings; above it, more leaders come first.
PAIRS_PER_POSTING = 4
#: Candidates' ids are broadcast up to this number (16 MB), joined by a shuffle beyond.
BROADCAST_IDS = 500_000
#: Postings, pairs with a leader, pairs of open entries and pairs of whole sets that are shuffled at once; more
#: are worked on in slices.
POSTINGS_AT_ONCE, LEADERS_AT_ONCE, PAIRS_AT_ONCE, COMPARED_AT_ONCE = 10_000_000, 1_000_000, 20_000_000, 200_000
KEY = ["mark_a", "mark_b", "n_shingles"]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, chars = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
            t = t or ""
            if chars + len(t) > BLOCK_CHARS and ids:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(i)
            texts.append(t)
            chars += len(t)
    if ids:
        yield ids, texts


def _marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums that name each set."""
    n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    tokens = np.concatenate([*sets, np.zeros(1, np.uint64)])
    at = np.append(np.cumsum(n) - n, len(tokens) - 1)
    a, b = np.add.reduceat(tokens, at)[:-1], np.add.reduceat(mix(tokens + np.uint64(1)), at)[:-1]
    a[n == 0] = b[n == 0] = 0
    return n, a.view(np.int64), b.view(np.int64)


def _distinct(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the non-empty sets of a block, one of each class."""
    _, first = np.unique(np.stack([a, b, n]), axis=1, return_index=True)
    return np.sort(first[n[first] > 0])


def in_slices(spark: SparkSession, rows: int, at_once: int, make: Callable[[Callable[[str], Column]], DataFrame], name: str) -> DataFrame:
    """The union of ``make(chosen)`` for slices of keys, each written before the next is shuffled.

    ``chosen`` gives, for a column, whether its value is in the slice; so the disk that
    shuffles need at once doesn't grow with ``rows``.
    """
    n = 1 + rows // at_once
    parts = []
    for k in range(n):
        parts.append(stash(make(lambda c, k=k: F.pmod(F.xxhash64(c), F.lit(n)) == k if n > 1 else F.lit(True)), name))
        release(spark)
    return functools.reduce(DataFrame.union, parts)


def set_marks(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows of two kinds: sets and tokens heavy in a block of texts.

    Sets: doc_id, n_shingles, mark_a, mark_b.  Tokens (``token`` not null): a token that
    two or more sets of a block hold, and their number.  These numbers only choose the
    class of a token; whatever they are, no link is lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _blocks(batches):
            sets = shingle_sets(texts, size)
            n, a, b = _marks(sets)
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_shingles": pd.array(n, "Int64"), "mark_a": a, "mark_b": b, "token": pd.array([None] * len(n), "Int64")})
            tokens, count = np.unique(np.concatenate([np.empty(0, np.uint64), *[sets[k] for k in _distinct(n, a, b)]]), return_counts=True)
            heavy = count > 1
            yield pd.DataFrame({"doc_id": pd.array([None] * heavy.sum(), "Int64"), "n_shingles": pd.array(count[heavy], "Int64"), "mark_a": 0, "mark_b": 0, "token": pd.array(tokens[heavy].view(np.int64), "Int64")})

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, mark_a long, mark_b long, token long")


def index_entries(sets: list[np.ndarray], frequent: np.ndarray, ratio: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """(entry, place of its set) of sets of sorted tokens; for each set the number of
    tokens that it doesn't post one by one, and whether these are all its frequent ones.

    ``frequent``: the sorted tokens of the frequent class.  Entries of pairs are odd.
    """
    num, den = ratio
    n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    tokens = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), n)
    often = np.zeros(len(tokens), dtype=bool)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    if often.any():
        order = np.argsort(owner * 2 + often, kind="stable")
        tokens, often = tokens[order], often[order]
    rare = np.bincount(owner[~often], minlength=len(sets))
    need = -(-n * num // den)
    prefix = np.where(need < 2, 0, n - need + 1)  # a set of one token has only copies
    mixed = rare < prefix
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
    alone = np.where(mixed, rare, prefix)
    single = place < alone[owner]
    # pairs (i, i + 1) of frequent tokens among the first `reach` of them
    reach = 2 * (den - num) * n // den + 2 - 2 * rare
    upto = np.where(mixed, np.minimum(rare + reach - 1, n - 1), 0)
    first = np.flatnonzero((place >= rare[owner]) & (place < upto[owner]))
    pairs = mix(mix(tokens[first]) + tokens[np.minimum(first + 1, len(tokens) - 1)] * np.uint64(3))
    entry = np.concatenate([mix(tokens[single]) & ~np.uint64(1), pairs | np.uint64(1)]).view(np.int64)
    return entry, np.concatenate([owner[single], owner[first]]), n - alone, mixed


def postings(docs: DataFrame, frequent, size: int, ratio: tuple[int, int]) -> DataFrame:
    """(entry, doc_id, n, rest, mixed) of the index: the size of the set, and what
    :func:`index_entries` says of it.  Of equal sets in a block one is posted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _blocks(batches):
            sets = shingle_sets(texts, size)
            taken = _distinct(*_marks(sets))
            sets = [sets[k] for k in taken]
            entry, owner, rest, mixed = index_entries(sets, frequent.value, ratio)
            doc_ids, n = np.asarray(ids, dtype=np.int64)[taken], np.array([len(s) for s in sets], dtype=np.int64)
            for k in range(0, len(entry), 200_000):
                at = slice(k, k + 200_000)
                own = owner[at]
                yield pd.DataFrame({"entry": entry[at], "doc_id": doc_ids[own], "n": n[own], "rest": rest[own], "mixed": mixed[own]})

    return in_batches(docs.select("doc_id", "text"), run, "entry long, doc_id long, n int, rest int, mixed boolean")


def token_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, tokens) of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _blocks(batches):
            yield pd.DataFrame({"doc_id": ids, "tokens": [s.view(np.int64) for s in shingle_sets(texts, size)]})

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, tokens array<long>")


def shared_entries(posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of entries with two or more of them, and the table that holds a part.

    Tokens one by one are counted in a window, one shuffle; a rare one has few
    postings.  Pairs, few but perhaps of very many sets, are counted with a combine before the
    shuffle and joined back, a join whose skewed keys are split.
    """
    single = posted.where("entry % 2 = 0").withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("entry")))
    kept = stash(single.where("rows > 1").drop("rows"), "shared-tokens")
    release(posted.sparkSession)
    pairs = posted.where("entry % 2 != 0")
    often = pairs.groupBy("entry").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("entry")
    return kept.union(pairs.join(often, "entry")), kept


def linked(pairs: DataFrame, docs: DataFrame, size: int, ratio: tuple[int, int]) -> DataFrame:
    """The pairs (src, dst) whose sets reach the similarity, compared whole; a table."""
    num, den = ratio
    pairs = stash(pairs, "candidates")
    release(docs.sparkSession)
    wanted = stash(pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = stash(token_sets(docs.join(few, "doc_id", "left_semi"), size).distinct(), "sets")
    a = sets.select(F.col("doc_id").alias("src"), F.col("tokens").alias("a"))
    b = sets.select(F.col("doc_id").alias("dst"), F.col("tokens").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    total = F.size("a") + F.size("b")

    def some(chosen: Callable[[str], Column]) -> DataFrame:
        met = pairs.where(chosen("src")).join(a.where(chosen("src")), "src").join(b, "dst")
        return met.where(den * both >= num * (total - both)).select("src", "dst")

    found = in_slices(docs.sparkSession, pairs.count(), COMPARED_AT_ONCE, some, "links")
    discard(pairs, wanted, sets)
    release(docs.sparkSession)
    return found


def _meet(ratio: tuple[int, int]):
    """Whether sets that share an entry can be similar enough.

    Their sizes must be close.  An entry of a pair of frequent tokens matters only to
    sets that share no rare one, so their frequent ones (``rest``) must be enough.
    """
    num, den = ratio
    n, n2 = F.col("n"), F.col("n2")
    close = (n * den >= n2 * num) & (n2 * den >= n * num)
    return close & ((F.col("entry") % 2 == 0) | (F.least("rest", "rest2") * (num + den) >= num * (n + n2)))


def _other(members: DataFrame, *columns: str) -> DataFrame:
    return members.select("entry", *[F.col(c).alias(f"{c}2") for c in ("doc_id", "n", "rest", "mixed", *columns)])


def leader_pairs(members: DataFrame, ratio: tuple[int, int], turn: int) -> DataFrame:
    """Pairs (src, dst) of each set with the leaders of its entries, the smallest by a hash
    that differs by ``turn``; ``members``: entry, doc_id, n, rest, mixed, component."""
    rank = F.col("doc_id") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))
    fields = [c for c in members.columns if c != "entry"]
    lead = F.min(F.struct(rank.alias("rank"), *fields)).alias("lead")
    leaders = members.groupBy("entry").agg(lead).select("entry", *[F.col(f"lead.{c}").alias(f"{c}2") for c in fields])
    met = members.join(leaders, "entry").where((F.col("component") != F.col("component2")) & _meet(ratio))
    return met.select(F.col("doc_id2").alias("src"), F.col("doc_id").alias("dst")).distinct()


_BOTH = ["n", "n2", "rest", "rest2", "mixed", "mixed2"]


def _suffice(shared: Column, ratio: tuple[int, int]) -> Column:
    """Whether two sets that post so many common tokens one by one can be similar enough.

    The tokens that a set posts come before the rest of it in the order of all.  So of
    what two sets share, at most the rest of one of them isn't posted by both; where both
    post all their rare tokens, at most the smaller rest.
    """
    num, den = ratio
    rest = F.when(F.col("mixed") & F.col("mixed2"), F.least("rest", "rest2")).otherwise(F.greatest("rest", "rest2"))
    return (num + den) * (shared + rest) >= num * (F.col("n") + F.col("n2"))


def _enough(met: DataFrame, ids: list[str], ratio: tuple[int, int]) -> DataFrame:
    """The pairs of sets, a row for each entry that they share, that share enough rare tokens."""
    shared = met.groupBy(*ids, *_BOTH).agg(F.count(F.when(F.col("entry") % 2 == 0, 1)).alias("shared"))
    return shared.where(_suffice(F.col("shared"), ratio)).select(*ids).distinct()


def likely_pairs(pairs: DataFrame, members: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """The pairs (src, dst) that share enough entries, by a count of these.

    A set's entries meet another's as one array, not as a row for each of a pair's entries.
    """
    spark = pairs.sparkSession
    own = members.groupBy("doc_id").agg(F.collect_list(F.when(F.col("entry") % 2 == 0, F.col("entry"))).alias("own"), *[F.max(c).alias(c) for c in ("n", "rest", "mixed")])
    own, pairs = stash(own, "own-entries"), stash(pairs, "leader-pairs")
    release(spark)

    def some(chosen: Callable[[str], Column]) -> DataFrame:
        a = own.where(chosen("doc_id")).withColumnRenamed("doc_id", "src")
        b = own.select(F.col("doc_id").alias("dst"), *[F.col(c).alias(f"{c}2") for c in ("own", "n", "rest", "mixed")])
        met = pairs.where(chosen("src")).join(a, "src").join(b, "dst")
        return met.where(_suffice(F.size(F.array_intersect("own", "own2")), ratio)).select("src", "dst")

    out = in_slices(spark, pairs.count(), LEADERS_AT_ONCE, some, "likely-pairs")
    discard(own, pairs)
    return out


def left_pairs(members: DataFrame, ratio: tuple[int, int], rows: int) -> DataFrame:
    """All pairs of sets in different components that share enough entries; ``rows``: how many meet."""
    apart = (F.col("doc_id") < F.col("doc_id2")) & (F.col("component") != F.col("component2"))

    def some(chosen: Callable[[str], Column]) -> DataFrame:
        met = members.where(chosen("doc_id")).join(_other(members, "component"), "entry").where(apart & _meet(ratio))
        return _enough(met, ["doc_id", "doc_id2"], ratio).toDF("src", "dst")

    return in_slices(members.sparkSession, rows, PAIRS_AT_ONCE, some, "left-pairs")


def verified_links(members: DataFrame, docs: DataFrame, size: int, ratio: tuple[int, int], per_posting: int) -> DataFrame:
    """Links (src, dst) that connect whatever the links among candidates connect.

    ``members``: entry, doc_id, n, rest, mixed.  See the module's text.
    """
    found = docs.sparkSession.createDataFrame([], "src long, dst long")
    # The driver sees a few sums.
    squares = lambda df: df.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    now, turn, before = members.withColumn("component", F.col("doc_id")), 0, float("inf")
    rows, pairs = squares(now)
    most = 2 * per_posting * (rows or 0)
    while pairs:
        # More leaders come while there are many pairs and the last leaders settled a quarter of them.
        if turn and (pairs <= most or pairs > 0.75 * before):
            return found.union(linked(left_pairs(now, ratio, pairs // 2), docs, size, ratio))
        some = likely_pairs(leader_pairs(now, ratio, turn), members, ratio)
        found, before = found.union(linked(some, docs, size, ratio)), pairs
        group = components(found)
        group = stash(group.select(F.col("node").alias("doc_id"), F.col("component").alias("joined")), "joined")
        tagged = members.join(group, "doc_id", "left").select(*members.columns, F.coalesce("joined", "doc_id").alias("component"))
        # An entry of two sets was decided by its leader.
        lo, hi = F.min("component").alias("lo"), F.max("component").alias("hi")
        open_ = tagged.groupBy("entry").agg(lo, hi, F.count(F.lit(1)).alias("rows")).where("lo < hi and rows > 2")
        then = stash(tagged.join(open_.select("entry"), "entry"), "open")
        discard(group, *([now] if turn else []))
        release(docs.sparkSession)
        now, turn = then, turn + 1
        pairs = squares(now)[1]
    return found


def ngram_jaccard_join(
    docs: DataFrame, size: int = SIZE, ratio: tuple[int, int] = THRESHOLD, frequent: int = FREQUENT, share: int = SHARE,
    per_posting: int = PAIRS_PER_POSTING,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Texts are whole; A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.  A
    document without words (null, empty or blank text) has no shingles and links
    with nothing.  ``ratio`` must be three quarters or more.  Every input row gives a
    row; rows that repeat a doc_id count as linked with each other, those without words
    excepted.  Rows without a doc_id stay alone, with component null; no other row's
    component depends on them.  Other columns are ignored.
    """
    if 4 * ratio[0] < 3 * ratio[1]:
        raise ValueError("the similarity must be 0.75 or more")
    spark = docs.sparkSession
    marks = stash(set_marks(docs, size), "shingle-marks")
    rows = marks.where("token is null").drop("token")
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = stash(named.groupBy(*KEY).agg(F.min("doc_id").alias("head")), "shingle-classes")
    heads = stash(named.join(classes, KEY).select("doc_id", "head").distinct(), "shingle-heads")
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    # At most `share` tokens can make up so much of the total each.
    heavy = marks.where("token is not null").groupBy("token").agg(F.sum("n_shingles").alias("rows"))
    often = heavy.where(F.col("rows") > max(frequent, total // share)).select("token").toPandas()["token"]
    shared = spark.sparkContext.broadcast(np.sort(often.to_numpy(np.int64).view(np.uint64)))

    some = docs.select("doc_id", "text").where("doc_id is not null")
    posted = stash(postings(some, shared, size, ratio), "postings")

    used: list[DataFrame] = []

    def met(chosen: Callable[[str], Column]) -> DataFrame:
        discard(*used)  # the tables of the slice before
        entries, kept = shared_entries(posted.where(chosen("entry")))
        named = stash(entries.join(heads, "doc_id").drop("doc_id").withColumnRenamed("head", "doc_id").distinct(), "met")
        discard(kept)
        used[:] = [named]
        release(spark)
        several = named.groupBy("entry").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("entry")
        return named.join(several, "entry")

    members = in_slices(spark, posted.count(), POSTINGS_AT_ONCE, met, "members")
    discard(posted, *used)
    release(spark)
    links = verified_links(members, some, size, ratio, per_posting)
    # Rows that repeat a doc_id connect their classes.
    again = heads.groupBy("doc_id").agg(F.min("head").alias("src"), F.max("head").alias("dst")).where("src < dst")
    again = again.select("doc_id").join(heads, "doc_id").select(F.col("doc_id").alias("src"), F.col("head").alias("dst"))
    found = components(links.union(again))
    discard(members)
    group = classes.join(found, classes["head"] == found["node"], "left").select(*KEY, F.coalesce("component", "head").alias("of"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
    return rows.join(group, KEY, "left").select("doc_id", "n_shingles", own.alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
