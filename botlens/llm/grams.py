"""Hashes of words and word windows, shared by winnowing and phrase search."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word -> 64-bit hash, forgetting all when it has grown large."""

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    n = max(0, len(hashes) - k + 1)
    grams = np.full(n, np.uint64(seed))
    for i in range(k):
        grams = (grams ^ hashes[i:i + n]) * MIX
        grams ^= grams >> np.uint64(29)
    return grams


BASE = 0xD6E8FEB86659FD93                         # odd, so it has an inverse modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64; at least n of them, grown by doubling."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << max(10, n.bit_length())
        held = np.full(size, np.uint64(base))
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes by prefix sums."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, n), out=sums[1:])
    grams = (sums[k:] - sums[:-k]) * powers(INVERSE, n - k + 1)
    grams ^= grams >> np.uint64(32)
    grams *= MIX
    grams ^= grams >> np.uint64(29)
    return grams


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LONG = 64              # bytes of a word from which it is hashed on its own


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, in order.

    A word's hash is a polynomial of its bytes, taken from prefix sums over the
    whole text, without a loop over the words.  Long words, for which a
    polynomial modulo 2 ** 64 has known collisions, are hashed by xxHash.
    """
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~BLANK[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    out = (sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i]:ends[i]])
    return out


def sliding(values: np.ndarray, span: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``span`` consecutive values, by doubling."""
    width = 1
    while 2 * width <= span:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[:len(values) - (span - width)], values[span - width:]) if span > width else values


def least_in_windows(grams: np.ndarray, span: int) -> np.ndarray:
    """Indices of the grams that are least in some window of ``span`` grams.

    All ties are kept, so two texts that share a window keep the same grams of it.
    """
    if len(grams) < span:
        return np.empty(0, np.int64)
    least = sliding(grams, span, np.minimum)
    # a gram is kept if the greatest least of the windows that hold it is its own
    edge = np.zeros(span - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), span, np.maximum) == grams)
