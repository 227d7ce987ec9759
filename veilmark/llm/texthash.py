"""Vectorised hashing of words and word shingles over buffers of many texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
#: The key of all word hashes.
KEY = b"veilmark words 1"
#: Longer slices are hashed one by one; shorter ones together, eight bytes at a time.
LONG_BYTES = 256
_SEED = U64(int.from_bytes(hashlib.blake2b(KEY, digest_size=8).digest(), "little"))
_STEP = U64(0x9E3779B97F4A7C15)
#: Texts are handled in blocks of about so many characters.
BLOCK_CHARS = 1_500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """At each place of ``data`` the eight bytes from there as a number, zeros behind."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def lane(window: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first ``left`` (at most eight) bytes from each start, as numbers."""
    found = window[starts]
    short = left < 8
    found[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
    return found


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keyed 64-bit hashes of ``data[starts[i]:ends[i]]`` (non-empty slices of bytes).

    Each step mixes eight bytes into the state by a bijection that isn't linear, so
    no words collide by their form.  Slices over ``LONG_BYTES`` get BLAKE2b.
    """
    size = ends - starts
    out = mix(size.astype(U64) * _STEP + _SEED)
    window, here = lanes(data), np.flatnonzero(size <= LONG_BYTES)
    done = 0
    while len(here):
        out[here] = mix((out[here] ^ lane(window, starts[here] + done, size[here] - done)) + _STEP)
        done += 8
        here = here[size[here] > done]
    for k in np.flatnonzero(size > LONG_BYTES).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=KEY).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def same_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether slice i has the very bytes of slice ``like[i]``."""
    size = ends - starts
    same = size == size[like]
    window, here = lanes(data), np.flatnonzero(same & (size <= LONG_BYTES) & (like != np.arange(len(like))))
    done = 0
    while len(here):
        left = size[here] - done
        same[here] &= lane(window, starts[here] + done, left) == lane(window, starts[like[here]] + done, left)
        done += 8
        here = here[size[here] > done]
    for k in np.flatnonzero(same & (size > LONG_BYTES)).tolist():
        m = like[k]
        same[k] = np.array_equal(data[starts[k] : ends[k]], data[starts[m] : ends[m]])
    return same


def blocks(texts: Sequence[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` characters each."""
    begin = chars = 0
    for k, t in enumerate(texts):
        if chars and chars + len(t) > limit:
            yield begin, k
            begin, chars = k, 0
        chars += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and the
    number of words before each text (one entry more than texts)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]).lower(), dtype=np.uint8)
    lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    found = slice_hashes(data, starts, ends) if len(starts) else np.empty(0, dtype=U64)
    return found, np.searchsorted(starts, bounds)


def shingle_sets(texts: Sequence[str], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles.

    A text with fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    out: list[np.ndarray] = []
    odd = mix(np.arange(1, size + 1, dtype=U64)) | U64(1)
    for a, b in blocks(texts):
        hashes, at = words(texts[a:b])
        n = len(hashes)
        rolled = np.zeros(max(0, n - size + 1), dtype=U64)
        for k in range(size if n >= size else 0):
            rolled += hashes[k : n - size + 1 + k] * odd[k]
        rolled = mix(rolled)
        for i in range(b - a):
            lo, hi = int(at[i]), int(at[i + 1])
            if hi - lo >= size:
                out.append(np.unique(rolled[lo : hi - size + 1]))
            elif hi > lo:
                short = (hashes[lo:hi] * odd[: hi - lo]).sum(dtype=U64) + U64(hi - lo)
                out.append(mix(np.array([short ^ U64(0xA5A5A5A5A5A5A5A5)], dtype=U64)))
            else:
                out.append(np.empty(0, dtype=U64))
    return out
