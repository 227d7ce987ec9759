"""Headings found in spite of reading errors.

A window of words is like a heading if twice the characters that a longest-match comparison
pairs, over the characters of both, reaches the least similarity.  That can't exceed what the
two have in common as bags of characters.  So the bags of all windows of a text are compared
first: the count of each of the heading's characters up to each word is a running sum,
a window's count the difference of two, and a few array operations give the bound of every
window of many texts.  Only windows whose bound reaches the least similarity are compared in full.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings of fewer words are matched exactly; the least similarity of others (fixed values).
FUZZY_WORDS, SIMILARITY = 3, 0.84
#: Characters of texts that are compared at once.
CHARACTERS = 1 << 18
_WORD = re.compile(r"[^\W_]+")


def folded(word: str) -> str:
    """A word's letters and digits with case and ё folded."""
    return "".join(filter(str.isalnum, word.casefold().replace("ё", "е")))


_TABLES: list[tuple[np.ndarray, np.ndarray, dict[int, str]]] = []


def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """Which characters are letters or digits; which change that when their case is folded, and what words have for these."""
    if not _TABLES:
        every = [chr(c) for c in range(0x110000)]
        word = np.fromiter(map(str.isalnum, every), dtype=bool, count=len(every))
        odd = {ord(c): folded(c) if c.isalnum() else " " for c in every if (f := c.casefold()) != c and not all(x.isalnum() == c.isalnum() for x in f)}
        changed = np.zeros(len(every), dtype=bool)
        changed[list(odd)] = True
        _TABLES.append((word, changed, odd))
    return _TABLES[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Words:
    """The words of some texts, joined by blanks, and where they stand."""

    def __init__(self, *texts: str) -> None:
        alnum, changed, odd = _tables()
        whole = "\n".join(texts)
        code = _codes(whole)
        edge = np.flatnonzero(np.diff(alnum[code], prepend=False, append=False))
        begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.text = np.searchsorted(begin, edge[::2], "right") - 1  # of each word
        self.starts, self.ends = edge[::2] - begin[self.text], edge[1::2] - begin[self.text]
        # Folded at once: case is folded character by character, and the same runs stay words.
        low = _codes((whole.translate(odd) if changed[code].any() else whole).casefold().replace("ё", "е"))
        word = alnum[low]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        word[edge[1::2][edge[1::2] < len(word)]] = True  # a blank behind each word
        low = np.where(alnum[low], low, np.uint32(32))[word]
        self.at = np.append(0, np.cumsum(edge[1::2] - edge[::2] + 1))  # of each word in the line
        self.codes = low[: max(self.at[-1] - 1, 0)]
        self.line = self.codes.tobytes().decode("utf-32-le", "surrogatepass")
        self._upto: dict[str, np.ndarray] = {}

    @property
    def words(self) -> list[str]:
        return self.line.split()

    def window(self, i: int, size: int) -> str:
        return self.line[self.at[i] : self.at[i + size] - 1]

    def upto(self, ch: str) -> np.ndarray:
        """How often a character stands before each word, and in all."""
        if ch not in self._upto:
            count = np.zeros(len(self.codes) + 2, dtype=np.int32)
            np.cumsum(self.codes == ord(ch), out=count[1:-1])
            count[-1] = count[-2]
            self._upto[ch] = count[self.at]
        return self._upto[ch]


class Heading:
    """A heading's words and its bag of characters."""

    def __init__(self, heading: str) -> None:
        self.words = [w for m in _WORD.finditer(heading) if (w := folded(m.group()))]
        self.target = " ".join(self.words)
        n = len(self.words)
        self.sizes = [n] if n < FUZZY_WORDS else [n - 1, n, n + 1]
        self.bag = Counter(self.target)

    def likely(self, text: Words, size: int) -> np.ndarray:
        """First words of the windows of ``size`` words whose bound reaches the least similarity."""
        n = len(text.starts) - size + 1
        if n <= 0 or not self.words:
            return np.empty(0, dtype=np.int64)
        length = text.at[size:] - text.at[:n] - 1
        common = np.full(n, min(self.bag[" "], size - 1))
        for ch, count in self.bag.items():
            if ch != " ":
                upto = text.upto(ch)
                common += np.minimum(upto[size:] - upto[:n], count)
        # Rounded up a little, so that no window is lost.
        near = 2.0 * common >= (SIMILARITY - 1e-9) * (length + len(self.target))
        return np.flatnonzero(near & (text.text[:n] == text.text[size - 1 :]))

    def matches(self, text: Words) -> Iterator[tuple[int, tuple[float, int, int]]]:
        """Number of a text, and (similarity, -start, end) of the windows that are like the heading."""
        compare = SequenceMatcher(None, "", self.target) if len(self.words) >= FUZZY_WORDS else None
        for size in self.sizes:
            for i in self.likely(text, size).tolist():
                window = text.window(i, size)
                if window == self.target:
                    score = 1.0
                elif compare is None:
                    continue
                else:
                    compare.set_seq1(window)
                    score = compare.ratio()
                if score >= SIMILARITY:
                    yield int(text.text[i]), (score, -int(text.starts[i]), int(text.ends[i + size - 1]))


def best_of_texts(texts: list[str], headings: list[Heading]) -> dict[int, tuple[float, int, int]]:
    """(score, -start, end) of the window most like a heading by the text's number, where there is one."""
    words, best = Words(*texts), {}
    for h in headings:
        for k, found in h.matches(words):
            best[k] = max(best.get(k, found), found)
    return best


def best_heading(text: str, *headings: str) -> tuple[float, int, int] | None:
    """(score, start, end) of the window most like a heading: the first, then the longer one of equals."""
    found = best_of_texts([text], [Heading(h) for h in headings]).get(0)
    return (found[0], -found[1], found[2]) if found else None


def fuzzy_heading_end(text: Column, headings: tuple[str, ...]) -> Column:
    """End of the best heading in a text, or null; similarity has no built-in form."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        own, out, some, size = [Heading(h) for h in headings], [], [], 0
        last = len(texts) - 1
        for k, t in enumerate(texts):
            some.append(t if isinstance(t, str) else "")
            size += len(some[-1])
            if size >= CHARACTERS or k == last:
                best = best_of_texts(some, own)
                out += [best[j][2] if j in best else None for j in range(len(some))]
                some, size = [], 0
        return pd.Series(out, dtype="Int64")

    return run(text)
