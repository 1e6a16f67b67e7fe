"""Word shingles of texts as sets of 64-bit codes, MinHash samples of them and odd sketches of the samples.

Words are runs of bytes other than ASCII white space, with A-Z in lower case. A shingle is coded by the codes
of its words, so that a text's whole set is found by a few array operations; two different shingles of a text
share a code with a probability of about 2**-64. Everything is computed from fixed constants: tasks, sessions
and reruns agree.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit (xor-shift and multiply rounds)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=None)
def constants(name: str, n: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the name only."""
    return np.array([xxhash.xxh3_64_intdigest(f"{name} {i}") | 1 for i in range(n)], U)


class WordCodes(dict):
    """64-bit codes of words, emptied when the words have more than max_bytes bytes together."""

    def __init__(self, max_bytes: int = 2_000_000) -> None:
        self.max_bytes, self.bytes = max_bytes, 0

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 100:
            self[word] = code
            self.bytes += len(word)
        return code

    def of(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # of bytes, lower() changes A-Z only and split() takes ASCII white space only
        if self.bytes > self.max_bytes:
            self.clear()
            self.bytes = 0
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def shingle_set(codes: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of a sequence of word codes, in order. Fewer words than size are one shingle; no words, none."""
    n = len(codes)
    if n == 0:
        return codes
    k = constants("place", size)
    if n < size:
        return mixed((codes * k[:n]).sum(dtype=U, keepdims=True) + U(n))
    m = n - size + 1
    total = codes[:m] * k[0]
    for j in range(1, size):
        total = total + codes[j : j + m] * k[j]
    return np.unique(mixed(total))


class Sketcher:
    """MinHash samples of a set in bands, and the odd sketch of all samples: the parity of the number of samples that fall on each of its bits."""

    def __init__(self, bands: int, rows: int, bits: int) -> None:
        self.bands, self.rows, self.bits = bands, rows, bits
        n = bands * rows
        self.flip, self.factor, self.salt = constants("flip", n), constants("factor", n), constants("salt", n)
        self.row, self.band = constants("row", rows), constants("band", bands)

    def samples(self, codes: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, ~U(0))
        for i in range(0, len(codes), 128):
            np.minimum(least, ((codes[i : i + 128, None] ^ self.flip) * self.factor).min(axis=0), out=least)
        return least

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One key for each band: equal where all samples of the band are."""
        return mixed((samples.reshape(self.bands, self.rows) * self.row).sum(axis=1, dtype=U) + self.band).view(np.int64)

    def odd(self, samples: np.ndarray) -> np.ndarray:
        """The odd sketch as 64-bit numbers."""
        place = mixed(samples + self.salt) % U(self.bits)
        return np.packbits((np.bincount(place.astype(np.int64), minlength=self.bits) & 1).astype(np.uint8)).view(np.int64)


def digest(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=None)
def most_odd_bits(samples: int, bits: int, percent: int, miss: float = 1e-9) -> int:
    """The number of bits by which the sketches of two sets of a similarity of percent/100 differ at most, but for a chance of miss.

    Samples differ independently with probability 1 - percent/100; each that differs throws two balls on the
    bits. The parities of t balls are a Markov chain; its tail is taken over the binomial number of balls.
    """
    p = 1 - percent / 100
    chance = np.zeros(bits + 1)  # of the number of odd bits after t balls
    chance[0] = 1.0
    odd = np.arange(bits + 1)
    weight = (1 - p) ** samples  # of 0 samples that differ
    total = np.zeros(bits + 1)
    for d in range(samples + 1):
        total += weight * chance
        for _ in range(2):
            up = chance * (bits - odd) / bits
            down = chance * odd / bits
            chance = np.roll(up, 1) + np.roll(down, -1)
        weight *= (samples - d) / (d + 1) * p / (1 - p) if p < 1 else 0
    tail = np.cumsum(total[::-1])[::-1]
    return int(np.searchsorted(-tail, -miss))
