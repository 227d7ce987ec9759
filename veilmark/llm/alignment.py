"""Alignment of two tokenizers by the bytes that their tokens share.

Both write the same bytes, a blank and the text.  Each run of bytes between two ends of
tokens (of either side) lies in one token of each side: such a run is a link, and places
where tokens of both sides end cut a document into groups.  All of it is a few array
operations a block of texts.

How often an id pair is linked in the whole corpus, and which partners of an id of side B
are the commonest, takes all documents.  A document gives the multiplicities of its
pairs; those of a block of documents are one posting row a pair.  Totals of pairs are summed
with a combine before the shuffle.  Totals and postings are then shuffled by the id of side B and
sorted in each partition, which spills: a stream brings first an id's totals, of
which the maximum is taken, then its postings, whose contributions to documents are
summed as they pass, a row for each block of documents.  An id with very many postings is dealt over slots, each of which
gets its totals, so no task reads all of it.  Contributions are summed by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.pieces import MODEL, piece_encoder
from veilmark.llm.shared import in_arrow, stash, table
from veilmark.llm.texthash import blocks
from veilmark.llm.tokens import _BYTE_CHARS, _gather, encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
#: Characters of the texts that are aligned at once.
BLOCK_CHARS = 1_000_000
#: Documents whose postings share rows; places in them take 16 bits.
BLOCK_ROWS = 1 << 16
#: Posting rows of an id of side B that one slot gets, about.
SLOT_ROWS = 20_000
#: Contributions that a task holds before it hands them on.
HELD = 1 << 21
_SUMS = ["block", "places", "n_best", "count_sum"]
_FACTS = "n_a long, n_b long, n_groups long, n_links long"


class ByteTable:
    """The bytes that ids stand for."""

    def __init__(self, shown: list[bytes]) -> None:
        self.length = np.fromiter(map(len, shown), dtype=np.int64, count=len(shown))
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(shown), dtype=np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.bytes, self.begin[ids], self.length[ids])


class Aligner:
    """Both tokenizers of a process."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = encoder(path_a, False, plain=True), piece_encoder(path_b)
        byte = {shown: b for b, shown in _BYTE_CHARS.items()}
        size = self.a.tok.get_vocab_size()
        shown = [self.a.tok.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = ByteTable([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in shown])
        self.bytes_b = ByteTable([self.b._bytes(i) for i in range(self.b.sp.vocab_size())])
        most = max(size, self.b.sp.vocab_size())
        if most > 1 << 19:
            raise ValueError("an id takes 19 bits at most")
        self.width = len(str(most))
        digits = np.array([list(str(i).encode().ljust(self.width, b"0")) for i in range(most)], dtype=np.uint8)
        self.digits, self.sizes = digits, np.array([len(str(i)) for i in range(most)])

    def align(self, texts: list[str]) -> Alignment:
        return Alignment(self, texts)


class Alignment:
    """Tokens, groups and links of a block of texts.

    Texts that are empty, or whose tokens don't spell a blank and the text on both sides,
    have none.
    """

    def __init__(self, by: Aligner, texts: list[str]) -> None:
        self.by = by
        a, count_a = by.a.encode([" " + t if t else "" for t in texts])
        b, count_b = by.b.encode(texts)
        raw = [(" " + t).encode() if t else b"" for t in texts]
        kept = self._same(by.bytes_a, a, count_a, raw) & self._same(by.bytes_b, b, count_b, raw)
        if not kept.all():
            a, b = a[np.repeat(kept, count_a)], b[np.repeat(kept, count_b)]
            count_a, count_b = np.where(kept, count_a, 0), np.where(kept, count_b, 0)
        self.a, self.b, self.n_a, self.n_b = a.astype(np.int64), b.astype(np.int64), count_a, count_b
        end_a, end_b = np.cumsum(by.bytes_a.length[a]), np.cumsum(by.bytes_b.length[b])
        self.common = np.intersect1d(end_a, end_b, assume_unique=True)
        cuts = np.union1d(end_a, end_b)
        self.link_a, self.link_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        self.group_a, self.group_b = np.searchsorted(self.common, end_a), np.searchsorted(self.common, end_b)
        stops = np.cumsum(np.where(kept, [len(r) for r in raw], 0)) if raw else np.empty(0, np.int64)
        upto = lambda x: np.diff(np.searchsorted(x, stops, side="right"), prepend=0)
        self.n_groups, self.n_links = upto(self.common), upto(cuts)

    @staticmethod
    def _same(known: ByteTable, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether each text's tokens spell its bytes."""
        found = known.of(ids)
        every = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if np.array_equal(found, every) and np.array_equal(np.diff(np.append(0, np.cumsum(known.length[ids]))[np.cumsum(counts)], prepend=0), [len(r) for r in raw]):
            return np.ones(len(raw), dtype=bool)
        ends = np.append(0, np.cumsum(known.length[ids]))[np.append(0, np.cumsum(counts))]
        flat = found.tobytes()
        return np.array([flat[i:j] == r for i, j, r in zip(ends[:-1].tolist(), ends[1:].tolist(), raw, strict=True)], dtype=bool)

    def groups(self) -> list[bytes]:
        """Each text's groups, written ``a1,a2|b1;a3|b2,b3``."""
        n, m = len(self.a), len(self.b)
        if not n:
            return [b""] * len(self.n_a)
        number = np.arange(len(self.common))
        place_a = np.arange(n) + np.searchsorted(self.group_b, number)[self.group_a]
        place_b = np.arange(m) + np.searchsorted(self.group_a, number, side="right")[self.group_b]
        ids, mark = np.empty(n + m, dtype=np.int64), np.empty(n + m, dtype=np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        again = lambda g: np.append(g[1:] == g[:-1], False)
        mark[place_a] = np.where(again(self.group_a), ord(","), ord("|"))
        mark[place_b] = np.where(again(self.group_b), ord(","), ord(";"))
        size = self.by.sizes[ids]
        out = np.empty((n + m, self.by.width + 1), dtype=np.uint8)
        out[:, :-1] = self.by.digits[ids]
        out[np.arange(n + m), size] = mark
        flat = out[np.arange(self.by.width + 1) <= size[:, None]].tobytes()
        ends = np.append(0, np.cumsum(size + 1))[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        return [flat[i : max(i, j - 1)] for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def pairs(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys (b, a, document's place from ``first``) in order, and how often each is linked."""
        owner = np.repeat(np.arange(len(self.n_links)) + first, self.n_links)
        key = self.b[self.link_b] << 44 | self.a[self.link_a] << 24 | owner
        return np.unique(key, return_counts=True)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(path_a, path_b)
    return _ALIGNERS[key]


def _packed(values: np.ndarray, ends: np.ndarray, kind: str = "<u2") -> pa.Array:
    """Runs of numbers up to ``ends`` as binary values."""
    at = pa.py_buffer(np.append(0, np.dtype(kind).itemsize * ends).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, at, pa.py_buffer(values.astype(kind).tobytes())])


def posting_rows(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """(b, a, places, times, links) a row for each pair, from keys of :meth:`Alignment.pairs`.

    Multiplicities beyond 16 bits are split over entries of the same place.
    """
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    if (times > 0xFFFF).any():
        parts = -(-times // 0xFFFF)
        last = np.cumsum(parts) - 1
        keys, rest = np.repeat(keys, parts), times - (parts - 1) * 0xFFFF
        times = np.full(len(keys), 0xFFFF, dtype=np.int64)
        times[last] = rest
    pair = keys >> 24
    heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, dtype=np.int64)
    ends = np.append(heads[1:], len(pair)) if len(heads) else heads
    links = np.add.reduceat(times, heads) if len(heads) else heads
    return pair[heads] >> 20, pair[heads] & 0xFFFFF, _packed(keys & 0xFFFFFF, ends), _packed(times, ends), links


def link_postings(docs: DataFrame, path_a: str, path_b: str, groups: bool) -> DataFrame:
    """Rows of two kinds, one pass over the texts.

    Documents (``row`` not null): row, doc_id, facts, groups (or their sha256).
    Postings: b, a, block (the row number of its first document), places, times, links.
    """
    shown = "groups" if groups else "groups_sha256"
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, {_FACTS}, {shown} string, b int, a int, block long, places binary, times binary, links long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(path_a, path_b)
        at = TaskContext.get().partitionId() << 40
        for whole in batches:
            for k in range(0, len(whole), BLOCK_ROWS):
                batch = whole.slice(k, BLOCK_ROWS)
                n, texts = len(batch), [t or "" for t in batch.column(1).to_pylist()]
                facts, written, keys, times = [], [], [], []
                for i, j in blocks(texts, BLOCK_CHARS):
                    found = by.align(texts[i:j])
                    facts.append(np.stack([found.n_a, found.n_b, found.n_groups, found.n_links]))
                    text = found.groups()
                    written += [g.decode() for g in text] if groups else [hashlib.sha256(g).hexdigest() if g else "" for g in text]
                    for x, part in zip((keys, times), found.pairs(i), strict=True):
                        x.append(part)
                none = lambda size, t: pa.nulls(size, t)
                tail = [(pa.int32(), 2), (pa.int64(), 1), (pa.binary(), 2), (pa.int64(), 1)]
                columns = [pa.array(np.arange(at, at + n)), batch.column(0), *map(pa.array, np.concatenate(facts, axis=1)), pa.array(written, pa.string())]
                columns += [none(n, t) for t, m in tail for _ in range(m)]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", shown, "b", "a", "block", "places", "times", "links"]
                yield pa.RecordBatch.from_arrays(columns, names)
                b, a, places, often, links = posting_rows(np.concatenate(keys), np.concatenate(times))
                m = len(b)
                head = [none(m, pa.int64()), none(m, batch.column(0).type), *[none(m, pa.int64())] * 4, none(m, pa.string())]
                own = [pa.array(b.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(np.full(m, at)), places, often, pa.array(links.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*head, *own], names)
                at += n

    return in_arrow(docs.select("doc_id", "text"), run, schema)


class Contributions:
    """What the pairs of documents add to them, summed by document as far as memory goes."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, block: np.ndarray, row: np.ndarray, best: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((block, row, best, total))
        self.size += len(row)
        if self.size >= HELD:
            self._sum()
            if self.size >= HELD // 2:
                yield from self.close()

    def _sum(self) -> None:
        block, row, best, total = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(row, kind="stable")
        row = row[order]
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        self.parts = [(block[order][heads], row[heads], np.add.reduceat(best[order], heads), np.add.reduceat(total[order], heads))]
        self.size = len(heads)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._sum()
            block, row, best, total = self.parts[0]
            heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            ends = np.append(heads[1:], len(block))
            columns = [pa.array(block[heads]), *(_packed(x, ends, kind) for x, kind in ((row - block, "<u2"), (best, "<i8"), (total, "<i8")))]
            yield pa.RecordBatch.from_arrays(columns, _SUMS)
        self.parts, self.size = [], 0


def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contributions to documents from a stream sorted by b, slot, kind, a.

    Kind 0 is a pair's total (``links``), kind 1 a posting row.  Of the totals only those of
    the id at hand are kept, which are no more than side A has ids.
    """
    code, count = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    held = Contributions()
    for batch in batches:
        b, slot, kind, a = (batch.column(i).to_numpy().astype(np.uint64) for i in range(4))
        key = b << np.uint64(44) | slot << np.uint64(20) | a
        total = kind == 0
        code = np.append(code, key[total])
        count = np.append(count, batch.column(4).to_numpy()[total])
        group = code >> np.uint64(20)
        if not total.all():
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            top = np.repeat(np.maximum.reduceat(count, heads), np.diff(np.append(heads, len(group))))
            rows = batch.filter(pa.array(~total))
            found = np.searchsorted(code, key[~total])
            places, times = rows.column(6), rows.column(7)
            n = np.diff(np.frombuffer(places.buffers()[1], np.int32)[places.offset : places.offset + len(rows) + 1]) // 2
            flat = lambda x: np.frombuffer(b"".join(x.to_pylist()), "<u2").astype(np.int64)
            often = flat(times)
            sure = np.repeat(count[found] == top[found], n)
            block = np.repeat(rows.column(5).to_numpy(), n)
            yield from held.add(block, block + flat(places), np.where(sure, often, 0), often * np.repeat(count[found], n))
        last = group == group[-1]
        code, count = code[last], count[last]
    yield from held.close()


def sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by document from contributions sorted by block; one block is held at a time."""
    now, best, total = None, np.zeros(BLOCK_ROWS, dtype=np.int64), np.zeros(BLOCK_ROWS, dtype=np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(total)  # a document with links has a sum
        yield pa.RecordBatch.from_arrays([pa.array(at + now), pa.array(best[at]), pa.array(total[at])], ["row", "n_best", "count_sum"])
        best[at] = total[at] = 0

    for batch in batches:
        for block, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and block != now:
                yield from out()
            now = block
            at = np.frombuffer(parts[0], "<u2")  # each place once in a row
            best[at] += np.frombuffer(parts[1], "<i8")
            total[at] += np.frombuffer(parts[2], "<i8")
    if now is not None:
        yield from out()


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: bool = True, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    Side A is a byte-level vocabulary, side B a SentencePiece model.  ``groups`` is written
    ``a1,a2|b1;a3|b2,b3``; with ``groups=False`` its sha256 comes instead as
    ``groups_sha256``, and whole groups aren't stored.  Null and empty texts, and texts whose
    tokens don't spell a blank and the text on both sides, have zeros and ''.  Rows that
    repeat a doc_id, or have none, each count and get their own row.  Of partners with
    equal counts all are best.  Other columns are ignored.
    """
    shown = "groups" if groups else "groups_sha256"
    path_a, path_b = path_a or vocabulary(VOCABULARY), path_b or vocabulary(MODEL)
    made = stash(link_postings(docs, path_a, path_b, groups), "alignments")
    facts = made.where("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", shown)
    posted = made.where("row is null")
    totals = posted.groupBy("b", "a").agg(F.sum("links").alias("links"), F.count(F.lit(1)).alias("rows"))
    totals = stash(totals, "pair-totals")
    # A row for each id of side B at most.
    slots = totals.groupBy("b").agg(F.ceil(F.sum("rows") / slot_rows).cast("int").alias("slots")).where("slots > 1")
    dealt = lambda df: df.join(F.broadcast(slots), "b", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    every = dealt(totals).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    every = every.select("b", "slot", F.lit(0).alias("kind"), "a", "links", none("long").alias("block"), none("binary").alias("places"), none("binary").alias("times"))
    own = dealt(posted).withColumn("slot", F.pmod(F.xxhash64("block", "a"), F.col("slots")).cast("int"))
    own = own.select("b", "slot", F.lit(1).alias("kind"), "a", "links", "block", "places", "times")
    stream = every.unionByName(own).repartition("b", "slot").sortWithinPartitions("b", "slot", "kind", "a")
    added = in_arrow(stream, contribute, "block long, places binary, n_best binary, count_sum binary")
    sums = in_arrow(added.repartition("block").sortWithinPartitions("block"), sum_blocks, "row long, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return facts.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), shown)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), groups=False)
