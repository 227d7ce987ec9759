"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring
of it.  A text is parsed from left to right into the longest phrases that occur in
a language's text; the fewer phrases, the closer the language.  The number of
phrases is normalised to bits a character, ``phrases * log2(n) / characters`` with n
the length of the language's text, and the least wins.

Segments of ``SEGMENT`` characters are parsed side by side, with one table look-up a
character and language for all segments of a batch at once.  A segment's parse
begins in the state in which the one before it ended: where that turns out to be another
one than was assumed, the segment is parsed again.  Parses of natural text meet
after a few characters, so that one repetition settles nearly all; what a few don't settle
is parsed character by character.  The parse is that of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.llm.shared import crc_bucket, held, in_batches, table

#: Labelled text learnt from: characters a language, and of one document.
TRAIN_CHARS = 30_000
TRAIN_DOC_CHARS = 1_000
SEGMENT = 256
#: Times that segments are parsed side by side.
ROUNDS = 6
UNKNOWN = "und"
#: Characters handled at once in a worker.
BATCH_CHARS = 1_500_000
#: Codes: white space and other non-letters, letters of no alphabet, padding.
GAP, STRANGE, PAD, FIRST = 0, 1, 2, 3
_RESTART = 1 << 30
#: Bits a character that a language must lie behind for e times less belief.
SHARPNESS = 0.25


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of ``codes``."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


def parse_table(codes: list[int], alphabet: int) -> np.ndarray:
    """Flat table of next states, with the restart flag where a phrase ends.

    The last state has no transitions: it stands after a character that the
    language's text lacks, which is a phrase of its own.
    """
    go = suffix_automaton(codes)
    lost = len(go)
    out = np.empty((lost + 1, alphabet), dtype=np.int32)
    out[:] = np.array([go[0].get(c, lost) for c in range(alphabet)], dtype=np.int32) | _RESTART
    for s, moves in enumerate(go):
        if moves:
            out[s, list(moves)] = list(moves.values())
    out[:, PAD] = np.arange(lost + 1)
    return out.ravel()


class Model:
    """Alphabet and tables, built in each worker from the learnt texts."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.languages = sorted(texts)
        counts: dict[str, int] = {}
        for t in texts.values():
            for ch in t.lower():
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + 1
        letters = sorted(counts, key=lambda ch: (-counts[ch], ch))[:4000]
        self.size = FIRST + len(letters)
        self.code = np.zeros(0x110000, dtype=np.uint16)
        self.code[[c for c in range(0x110000) if chr(c).isalpha()]] = STRANGE
        for k, ch in enumerate(letters):
            self.code[ord(ch)] = FIRST + k
        self.tables, self.bits = [], []
        for name in self.languages:
            codes = self.codes(texts[name]).tolist()
            self.tables.append(parse_table(codes, self.size))
            self.bits.append(np.log2(max(2, len(codes))))

    def codes(self, text: str) -> np.ndarray:
        """Lower-cased letters as codes; each run of other characters is one gap."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = self.code[raw]
        gap = code == GAP
        return code[~(gap & np.concatenate([[True], gap[:-1]]))] if len(code) else code

    def rates(self, texts: list[str]) -> np.ndarray:
        """Bits a character for each text (row) and language; NaN without letters."""
        codes = [self.codes(t) for t in texts]
        n = np.array([len(c) for c in codes])
        letters = np.array([bool((c != GAP).any()) for c in codes])
        segments = -(-n // SEGMENT)
        flat = np.full((int(segments.sum()), SEGMENT), PAD, dtype=np.uint16)
        at = 0
        for c, s in zip(codes, segments.tolist(), strict=True):
            flat[at : at + s].reshape(-1)[: len(c)] = c
            at += s
        columns = np.ascontiguousarray(flat.T)
        owner = np.repeat(np.arange(len(texts)), segments)
        out = np.full((len(texts), len(self.languages)), np.nan)
        opens = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.empty(0, bool)
        for k, moves in enumerate(self.tables):
            phrases = self._phrases(moves, columns, opens)
            total = np.bincount(owner, weights=phrases, minlength=len(texts))
            out[:, k] = np.where(letters, total * self.bits[k] / np.maximum(n, 1), np.nan)
        return out


    def _phrases(self, moves: np.ndarray, columns: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Phrases that begin in each segment; ``opens``: it is its text's first one."""
        lost = len(moves) // self.size - 1  # from here the first character begins a phrase
        entry = np.full(len(opens), lost, dtype=np.int32)
        leaves, phrases = np.empty(len(opens), dtype=np.int32), np.zeros(len(opens), dtype=np.int64)
        todo = np.arange(len(opens))
        for _ in range(ROUNDS):
            state, count = entry[todo], np.zeros(len(todo), dtype=np.int32)
            for column in columns[:, todo]:
                state = moves[state * self.size + column]
                count += state >> 30
                state &= _RESTART - 1
            leaves[todo], phrases[todo] = state, count
            true = np.where(opens, lost, np.roll(leaves, 1))
            todo = np.flatnonzero(true != entry)
            entry[todo] = true[todo]
            if not len(todo):
                return phrases
        table_, begin = memoryview(moves), -1
        for first in todo.tolist():
            k = first
            while k > begin and k < len(opens) and (k == first or not opens[k]):
                state, count = lost if opens[k] else int(leaves[k - 1]), 0
                if k > first and state == entry[k]:
                    break
                entry[k] = state
                for c in columns[:, k].tolist():
                    state = table_[state * self.size + c]
                    count += state >> 30
                    state &= _RESTART - 1
                leaves[k], phrases[k] = state, count
                k += 1
            begin = max(begin, k - 1)
        return phrases


def _model(texts: dict[str, str]) -> Model:
    key = hashlib.md5(repr(sorted(texts.items())).encode("utf-8", "surrogatepass")).hexdigest()
    return held(("language", key), lambda: Model(texts))


def learn(labelled: DataFrame, chars: int = TRAIN_CHARS, doc_chars: int = TRAIN_DOC_CHARS) -> dict[str, str]:
    """Text by language from a bounded sample of ``labelled`` (doc_id, text, lang).

    About ``chars`` characters a language, ``doc_chars`` at most of a document: of a
    longer text a window whose place a hash of doc_id and text draws from all of it.
    Documents come in an order fixed by a hash of doc_id (of the text where that is
    null).  Rows with a null text or language are left out.
    """
    wanted = -(-4 * chars // doc_chars)
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    unnamed = F.when(F.col("doc_id").isNull(), F.col("text"))  # drawn by its text
    drawn = F.pmod(F.xxhash64("doc_id", unnamed, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    places = F.greatest(F.length("text") - F.lit(doc_chars - 1), F.lit(1))
    start = F.pmod(F.xxhash64("doc_id", "text", F.lit("window")), places) + 1
    window = F.col("text").substr(start.cast("int"), F.lit(doc_chars))
    few = (
        usable.join(F.broadcast(sizes), "lang")  # one row per language
        .where(drawn < F.lit(2.0 * wanted) / F.col("rows"))
        .select("lang", "doc_id", window.alias("text"), drawn.alias("drawn"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id", "text"))
    out: dict[str, str] = {}
    for r in few.withColumn("place", place).where(F.col("place") <= wanted).orderBy("lang", "place").collect():
        have = out.get(r["lang"], "")
        if len(have) < chars:
            out[r["lang"]] = have + " " + r["text"]
    return {k: t[: chars + 1] for k, t in out.items()}


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds lang_pred and score to ``docs`` (any columns, one named text).

    ``und`` with score 0 for a null text, one without letters, or where
    nothing was learnt.  Whole texts are parsed.  Equal rates go to the
    language first in the alphabet.  The score is the winner's share of
    ``exp(-rate / SHARPNESS)`` over all languages.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(shared.value) if shared.value else None
        for b in batches:
            every = [t if isinstance(t, str) else "" for t in b["text"].tolist()]
            names, scores, begin = [], [], 0
            while begin < len(every):
                stop, room = begin, 0
                while stop < len(every) and (stop == begin or room + len(every[stop]) <= BATCH_CHARS):
                    room += len(every[stop])
                    stop += 1
                part = every[begin:stop]
                begin = stop
                if model is None:
                    names += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                rate = model.rates(part)
                none = np.isnan(rate).any(axis=1)
                rate[none] = 0
                best = rate.argmin(axis=1)
                least = rate.min(axis=1, keepdims=True)
                share = 1 / np.exp((least - rate) / SHARPNESS).sum(axis=1)
                names += [UNKNOWN if x else model.languages[k] for x, k in zip(none, best, strict=True)]
                scores += np.where(none, 0.0, share).tolist()
            yield b[keep].assign(lang_pred=names, score=scores)

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return in_batches(docs.select(*keep), run, f"{schema}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_bucket("doc_id", 4)
    texts = learn(docs.where(fold != 2))
    found = identify(docs.select("doc_id", (fold == 2).alias("held_out"), "text"), texts)
    return found.select("doc_id", "held_out", "lang_pred", "score")
