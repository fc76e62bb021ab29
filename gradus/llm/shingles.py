"""Word shingles as 64-bit hashes (numpy), shared by the operators that compare word sets."""

from __future__ import annotations

import numpy as np
import xxhash

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROLL = np.uint64(0x100000001B3)


def scramble(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes of words; remembers some of them, since words repeat."""

    def __init__(self, remember: int = 200_000):
        self.remember, self.known = remember, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.remember:
            known.clear()
        out = np.empty(len(words), dtype=np.uint64)
        get, make = known.get, xxhash.xxh3_64_intdigest
        for i, w in enumerate(words):
            h = get(w)
            if h is None:
                h = known[w] = make(w)
            out[i] = h
        return out


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of width words; all words as one run, if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - width + 1, dtype=np.uint64)
        for k in range(width):
            h = scramble(h * _ROLL + hashes[k : n - width + 1 + k])
        # A shorter text is no shingle of a longer one.
        return np.unique(h + np.uint64(width))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set, as two signed numbers."""
    with np.errstate(over="ignore"):
        a = scramble(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        b = scramble(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def parity(s: np.ndarray, least: int = 256) -> np.ndarray:
    """Of how many elements fall to each bit, the lowest digit, as signed 64-bit numbers. There are
    as many bits as elements, rounded up to a power of 2, and at least `least`.

    An element in one of two sets only flips one bit, so two sets differ in at least as many
    elements as their parities differ in bits. Halves, one xor the other, make the parity of half
    the bits, so sets of different sizes can be compared.
    """
    bits = max(least, 1 << int(len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def folded(par: np.ndarray, words: int = 4) -> np.ndarray:
    """A parity of as many bits as words hold, from one of at least as many."""
    return np.bitwise_xor.reduce(par.reshape(-1, words), axis=0)
