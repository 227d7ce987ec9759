"""Encoding with the tokenizers library, memoised word by word.

The library needs about a microsecond a character here, while words repeat.  So
each worker process keeps the ids of the pre-tokens it has met, keyed by their
bytes; only new pre-tokens go to the library's model.  Within a block of texts equal
pre-tokens are found by a 64-bit hash and then compared byte by byte: a text
with a pre-token that only hashes like another one is given to the library whole.  This holds for texts of Latin-1
characters without apostrophes and unusual blanks, where the pre-tokeniser's cuts
are simple rules on character classes; any other text is given to the library
whole.  A full memo keeps what was used again since it was last full, which bounds
a worker's memory at any input size.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import regex

from veilmark.llm.shared import held
from veilmark.llm.texthash import blocks, same_slices, slice_hashes

MEMO_WORDS = 250_000
BLANK, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[str, str]:
    """Byte-level vocabularies write each byte as a visible character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {chr(b): chr(256 + k) for k, b in enumerate(rest)}


_BYTE_CHARS = str.maketrans(_byte_chars())
_CLASS = np.array(
    [
        LETTER if regex.match(r"\p{L}", c) else DIGIT if regex.match(r"\p{N}", c) else BLANK if c in "\t\n\v\f\r " else OTHER
        for c in map(chr, range(256))
    ],
    dtype=np.uint8,
)
_LOWER = np.array([ord(x) if len(x := chr(b).lower()) == 1 and ord(x) < 256 else b for b in range(256)], dtype=np.uint8)
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
#: Normalizer and pre-tokenizer whose cuts are known here, by ``drops_space`` (fixed values).
_KNOWN = {
    False: (None, _BYTE_LEVEL | {"use_regex": True}),
    True: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            _BYTE_LEVEL | {"use_regex": False},
        ]},
    ),
}
#: Texts with these go to the library: contractions, and blanks beyond the usual.
_WHOLE = regex.compile("['\x00-\x08\x1c-\x1f\x85\xa0]")


class Encoder:
    """Encodes texts with a vocabulary file.

    ``drops_space``: the vocabulary lower-cases and drops white space;
    otherwise it is byte-level and keeps every character.  ``plain``: strings of
    special tokens in texts are ordinary text.  A file with another normalizer or
    pre-tokenizer than is known here gets whole texts.
    """

    def __init__(self, path: str, drops_space: bool, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known = (spec.get("normalizer"), spec.get("pre_tokenizer")) == _KNOWN[drops_space]
        self.model = self.tok.model
        self.tok.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.drops_space = drops_space
        self._empty()

    def _empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.first = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int64)
        self.used = np.empty(0, dtype=bool)
        self.pool = np.empty(0, dtype=np.uint32)

    def _trim(self) -> None:
        if len(self.place) < MEMO_WORDS:
            return
        keep = np.flatnonzero(self.used)
        if len(keep) > MEMO_WORDS // 2:
            self._empty()
            return
        count = self.count[keep]
        self.pool = _gather(self.pool, self.first[keep], count)
        pieces = list(self.place)  # in the order of their places
        self.place = {pieces[k]: n for n, k in enumerate(keep.tolist())}
        self.count = count
        self.first = np.cumsum(count) - count
        self.used = np.zeros(len(keep), dtype=bool)

    def whole(self, text: str) -> np.ndarray:
        found = self.tok.encode_batch_fast([text], add_special_tokens=False)
        return np.asarray(found[0].ids, dtype=np.uint32)

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens in a block of texts."""
        kind = _CLASS[data]
        opens = np.empty(len(data) + 1, dtype=bool)
        same = kind[1:] == kind[:-1]
        head = np.zeros(len(data) + 1, dtype=bool)
        head[bounds] = True
        if self.drops_space:
            opens[1:-1] = ~same | (kind[1:] == DIGIT)
            opens[bounds] = True
            starts = np.flatnonzero(opens)
            starts, ends = starts[:-1], starts[1:]
            solid = kind[starts] != BLANK
            return starts[solid], ends[solid]
        blank = kind == BLANK
        before, here = blank[:-1], blank[1:]
        opens[1:-1] = np.where(
            here,
            # a blank after a blank is cut off if it is the last one before a non-blank
            ~before | np.append(~here[1:] & ~head[2:-1], False),
            np.where(before, data[:-1] != 32, ~same),
        )
        opens[bounds] = True
        starts = np.flatnonzero(opens)
        return starts[:-1], starts[1:]

    def _ids_of(self, pieces: list[bytes]) -> Iterator[list[int]]:
        tokenize = self.model.tokenize
        for p in pieces:
            shown = (p if p.isascii() else p.decode("latin-1").encode()).decode("latin-1").translate(_BYTE_CHARS)
            yield [t.id for t in tokenize(shown)]

    def _learn(self, pieces: list[bytes]) -> None:
        ids: list[int] = []
        count = np.empty(len(pieces), dtype=np.int64)
        for k, (p, found) in enumerate(zip(pieces, self._ids_of(pieces), strict=True)):
            count[k] = len(found)
            ids += found
            self.place[p] = len(self.place)
        first = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, np.asarray(ids, dtype=np.uint32)])
        self.first = np.concatenate([self.first, first])
        self.count = np.concatenate([self.count, count])
        self.used = np.concatenate([self.used, np.zeros(len(pieces), dtype=bool)])

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids, their number for each text, and the texts that must be encoded whole."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if self.drops_space:
            data = _LOWER[data]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not len(data):
            return np.empty(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64), []
        starts, ends = self._cut(data, bounds)
        _, head, back = np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True)
        other = np.flatnonzero(~same_slices(data, starts, ends, head[back]))
        self._trim()
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[head].tolist(), ends[head].tolist(), strict=True)]
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        self.used[at[at >= 0]] = True
        fresh = np.flatnonzero(at < 0)
        at[fresh] = len(self.place) + np.arange(len(fresh))
        self._learn([pieces[k] for k in fresh.tolist()])
        at = at[back]
        count = self.count[at]
        ids = _gather(self.pool, self.first[at], count)
        upto = np.concatenate([[0], np.cumsum(count)])
        edge = upto[np.searchsorted(starts, bounds)]
        return ids, np.diff(edge), np.unique(np.searchsorted(bounds, starts[other], side="right") - 1).tolist()

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for a, b in blocks(texts):
            block: list[bytes] = []
            whole: dict[int, np.ndarray] = {}
            for k, t in enumerate(texts[a:b]):
                try:
                    raw = t.encode("latin-1")
                except UnicodeEncodeError:
                    raw = None
                if raw is None or not self.known or _WHOLE.search(t) or any(s in t for s in self.special):
                    whole[k], raw = self.whole(t), b""
                block.append(raw)
            ids, count, odd = self._block(block)
            whole |= {k: self.whole(texts[a + k]) for k in odd}
            if whole:
                at = np.concatenate([[0], np.cumsum(count)])
                pieces = [whole.get(k, ids[at[k] : at[k + 1]]) for k in range(len(block))]
                ids, count = np.concatenate(pieces), np.array([len(p) for p in pieces], dtype=np.int64)
            parts.append(ids)
            counts.append(count)
        if not parts:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        return np.concatenate(parts), np.concatenate(counts)


def _gather(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``pool[first[i]:first[i] + count[i]]`` for all i, in one array."""
    shift = first - (np.cumsum(count) - count)
    return pool[np.repeat(shift, count) + np.arange(int(count.sum()))]


def encoder(path: str, drops_space: bool, plain: bool = False) -> Encoder:
    """This process's encoder of a vocabulary file."""
    return held(("tokens", path, drops_space, plain), lambda: Encoder(path, drops_space, plain))
