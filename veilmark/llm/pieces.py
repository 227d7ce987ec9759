"""SentencePiece encoding and decoding over a table of distinct marked words.

The library writes a blank as the marker U+2581 and puts one before each text.  Where no
piece of the vocabulary holds a marker behind another character, no merge crosses from
a word into the marker that follows; so a text is cut before each run of markers, and
its ids are those of its marked words, one behind the other.  The distinct words of
all texts are counted; those that occur more than once, by frequency up to a bound,
are segmented once by the library and their ids go to the workers as one table.  Workers
join the ids back by position.  A word beyond the table is segmented where it stands:
most such words occur once, so there is nothing to share.  Texts themselves are
never shuffled.

A model of another kind (unigram, other normalisation, pieces across markers) is given
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.shared import discard, in_arrow, stash, table
from veilmark.llm.texthash import blocks, same_slices, slice_hashes
from veilmark.llm.tokens import MEMO_WORDS, Encoder, _gather, vocabulary

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words of the table, at most, and bytes of each of them: so at most 16 MB of words.
TABLE_WORDS = 250_000
WORD_BYTES = 64
#: Ids that are decoded at once, or one text's.
DECODE_IDS = 400_000
_BLANK = 32


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = blob[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, blob[at : at + size]
        at += size


def words_stand_alone(model) -> bool:
    """Whether the ids of a text are those of its marked words, one behind the other.

    That takes a BPE model that normalises nothing, puts a marker first and keeps all
    blanks, with a piece for the marker and no piece with a marker behind another
    character.
    """
    spec = dict(_fields(model.serialized_model_proto()))
    train, norm = dict(_fields(spec.get(2, b""))), dict(_fields(spec.get(3, b"")))
    plain = train.get(3) == 2 and not train.get(24) and not norm.get(2)
    marks = norm.get(3, 1) == 1 and norm.get(4, 1) == 0 and norm.get(5, 1) == 1
    if not (plain and marks) or model.piece_to_id(MARK) == model.unk_id():
        return False
    shown = [model.id_to_piece(i) for i in range(model.vocab_size())]
    return not any(MARK in p.lstrip(MARK) for p in shown)


class PieceEncoder(Encoder):
    """Encodes and decodes with a model file; ``words``: the table of :func:`word_table`."""

    def __init__(self, path: str, words: tuple | None = None) -> None:
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        self.apart = words_stand_alone(self.sp)
        self.drops_space, self.special, self.fixed = False, [], 0
        self._empty()
        if words is not None:
            text, size, self.count, self.pool = words
            ends = np.cumsum(size)
            raw = [text[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
            self.place = {p: k for k, p in enumerate(raw)}
            self.first = np.cumsum(self.count) - self.count
            self.used = np.zeros(len(raw), dtype=bool)
            self.fixed, self.fixed_ids = len(raw), len(self.pool)
        size = self.sp.vocab_size()
        shown = [self._bytes(i) for i in range(size)]
        self.length = np.fromiter(map(len, shown), dtype=np.int64, count=size)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.marked = np.array([p.startswith(b" ") and not self.sp.is_byte(i) and not self.sp.is_unknown(i) for i, p in enumerate(shown)])

    def _bytes(self, i: int) -> bytes:
        """What a piece stands for in a text."""
        if self.sp.is_control(i):
            return b""
        if self.sp.is_unknown(i):
            return b" \xe2\x81\x87 "
        piece = self.sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.sp.is_byte(i) else piece.replace(MARK, " ").encode()

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.sp.encode(text), dtype=np.uint32)

    def _trim(self) -> None:
        if not self.fixed:
            super()._trim()
        elif len(self.place) - self.fixed >= MEMO_WORDS:
            for p in list(self.place)[self.fixed :]:
                del self.place[p]
            self.first, self.count, self.used = (x[: self.fixed] for x in (self.first, self.count, self.used))
            self.pool = self.pool[: self.fixed_ids]

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return marked_words(data, bounds)

    def _ids_of(self, pieces: list[bytes]) -> Iterator[list[int]]:
        mark = self.sp.piece_to_id(MARK)
        found = self.sp.encode([p[1:].decode() for p in pieces], num_threads=1)  # it puts the marker back
        return (ids if len(p) > 1 else [mark] for p, ids in zip(pieces, found, strict=True))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        parts, counts = [np.empty(0, dtype=np.uint32)], [np.empty(0, dtype=np.int64)]
        for a, b in blocks(texts):
            if self.apart:
                ids, count, odd = self._block([marked(t) for t in texts[a:b]])
            else:
                ids, count, odd = parts[0], np.zeros(b - a, dtype=np.int64), range(b - a)
            whole = {k: self.whole(texts[a + k]) for k in odd}
            if whole:
                at = np.concatenate([[0], np.cumsum(count)])
                pieces = [whole[k] if k in whole else ids[at[k] : at[k + 1]] for k in range(b - a)]
                ids, count = np.concatenate(pieces), np.array([len(p) for p in pieces], dtype=np.int64)
            parts.append(ids)
            counts.append(count)
        return np.concatenate(parts), np.concatenate(counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids, as the library's decode gives them; in blocks of runs."""
        ends, out, begin = np.cumsum(counts), [], 0
        while begin < len(counts):
            base = int(ends[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + DECODE_IDS, side="right")))
            out += self._decode(ids[base : ends[stop - 1]], counts[begin:stop])
            begin = stop
        return out

    def _decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        ends = np.cumsum(counts)
        length = self.length[ids]
        raw = _gather(self.bytes, self.begin[ids], length).tobytes() if len(ids) else b""
        stop = np.concatenate([[0], np.cumsum(length)])
        real = np.append(np.flatnonzero(length), len(ids))  # the marker of the first piece with bytes goes
        first = real[np.searchsorted(real, ends - counts)]
        bare = (first < ends) & np.append(self.marked[ids], False)[first]
        last = np.append(-1, np.flatnonzero(length))[np.searchsorted(np.flatnonzero(length), ends)]
        mute = np.concatenate([[0], np.cumsum(length == 0)])
        split = (first < last) & (mute[np.maximum(last, 0)] > mute[np.minimum(first, len(ids))])  # a control id parts bytes
        out = []
        for a, b, skip, parted in zip((ends - counts).tolist(), ends.tolist(), bare.tolist(), split.tolist(), strict=True):
            try:
                out.append(self.sp.decode(ids[a:b].tolist()) if parted else raw[stop[a] + skip : stop[b]].decode())
            except UnicodeDecodeError:
                out.append(self.sp.decode(ids[a:b].tolist()))
        return out


def marked(text: str) -> bytes:
    """A text with blanks for markers, one before it; nothing for an empty text."""
    return (" " + text.replace(MARK, " ")).encode() if text else b""


def marked_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts (from ``bounds``), each with the blanks before it."""
    blank = data == _BLANK
    opens = np.append(blank, False)
    opens[1:-1] &= ~blank[:-1]
    opens[bounds] = True
    starts = np.flatnonzero(opens[:-1])
    return starts, np.append(starts[1:], len(data))


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the marked words of all texts, of ``WORD_BYTES`` at most, and how often they occur.

    Words are counted in blocks of texts, then in each task, then over all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for a, b in blocks(texts):
                raw = [marked(t) for t in texts[a:b]]
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                starts, ends = marked_words(data, np.cumsum([0, *map(len, raw)]))
                some = ends - starts <= WORD_BYTES
                starts, ends = starts[some], ends[some]
                _, head, back, n = np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
                other = np.flatnonzero(~same_slices(data, starts, ends, head[back]))
                n = np.append(n - np.bincount(back[other], minlength=len(n)), np.ones(len(other), dtype=np.int64))
                head, whole = np.append(head, other), data.tobytes()
                words = pa.array([whole[i:j] for i, j in zip(starts[head].tolist(), ends[head].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])

    return in_arrow(docs.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str, text: str = "text", most: int = TABLE_WORDS) -> tuple:
    """The segmented words that occur more than once, the most frequent ``most`` of them.

    They are chosen by a count from which on no more than ``most`` words are left, in
    steps of an eighth of a doubling; so no task orders all words.
    """
    counted = stash(distinct_words(docs, text).where("n > 1"), "words")
    step = F.floor(F.log2("n") * 8)
    held, least = 0, float("inf")
    for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():  # 512 rows
        held += r["words"]
        if held > most:
            break
        least = r["step"]

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder(path)
        for b in batches:
            ids = [np.array(x, dtype="<u4").tobytes() for x in enc._ids_of(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    found = in_arrow(counted.where(step >= F.lit(least)).select("word"), segment, "word binary, ids binary").toArrow()  # `most` rows
    discard(counted)
    words, ids = found["word"].to_pylist(), found["ids"].to_pylist()
    size = np.array([len(w) for w in words], dtype=np.int64)
    count = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    return b"".join(words), size, count, np.frombuffer(b"".join(ids), dtype="<u4").astype(np.uint32)


_LOADED: dict[tuple[str, bool], tuple[Broadcast | None, PieceEncoder]] = {}


def piece_encoder(path: str, shared: Broadcast | None = None) -> PieceEncoder:
    """This process's encoder of a model file, with the table that ``shared`` holds.

    A process keeps one encoder without a table and one with the table used last.
    """
    key = (path, shared is not None)
    if key not in _LOADED or _LOADED[key][0] is not shared:
        _LOADED[key] = shared, PieceEncoder(path, None if shared is None else shared.value)
    return _LOADED[key][1]


def _columns(df: DataFrame, out: str, kind: str) -> tuple[list[str], str]:
    kept = [c for c in df.columns if c != out]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out]
    return kept, ", ".join([*schema, f"`{out}` {kind}"])


def encode_pieces(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids", end: bool = True, most: int = TABLE_WORDS, decoded: str | None = None) -> DataFrame:
    """Adds ``out``, the ids of each whole text, to ``docs``; ``docs`` is read twice.

    With ``decoded`` a column of that name holds what :func:`decode_pieces` would give for
    the ids, without another Python stage.

    A null text counts as empty; with ``end`` each text gets the model's end id, so an empty
    one has that alone.  The marker itself in a text counts as a blank, as in the
    library.  All other columns are kept, a column named ``out`` is replaced; rows that repeat
    are encoded alike.
    """
    path = path or vocabulary(MODEL)
    apart = PieceEncoder(path).apart
    shared = docs.sparkSession.sparkContext.broadcast(word_table(docs, path, text, most)) if apart else None
    kept, schema = _columns(docs.drop(decoded) if decoded else docs, out, "array<int>")
    schema += f", `{decoded}` string" if decoded else ""
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(path, shared)
        for b in batches:
            ids, counts = enc.encode([t or "" for t in b.column(place).to_pylist()])
            if end:
                ids, counts = np.insert(ids, np.cumsum(counts), enc.sp.eos_id()), counts + 1
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            added = [pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32)))]
            added += [pa.array(enc.decode(ids, counts), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*kept, out, *([decoded] if decoded else [])])

    return in_arrow(docs.select(*kept), run, schema)


def decode_pieces(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text that the library decodes from a list of ids.

    A null list, or one that holds null or a number that is no id, gives null; an empty
    list or one of control ids only gives an empty text.  Other columns are kept, a
    column named ``out`` is replaced.
    """
    path = path or vocabulary(MODEL)
    kept, schema = _columns(rows, out, "string")
    place = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(path)
        size = len(enc.length)
        for b in batches:
            column = b.column(place)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) if column.flatten().null_count else column.flatten().to_numpy()
            counts = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            wrong = ~((flat >= 0) & (flat < size))
            texts: list = enc.decode(np.where(wrong, 0, flat).astype(np.int64), counts)
            bad = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=wrong, minlength=len(counts)) > 0
            bad |= column.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string(), mask=bad)], [*kept, out])

    return in_arrow(rows.select(*kept), run, schema)


def _digest(value: Column) -> Column:
    return F.sha2(value, 256)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _digest(ids).alias("ids_sha256"), _digest(F.col("decoded")).alias("decoded_sha256"))
