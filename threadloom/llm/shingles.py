"""Hashed word sequences of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from threadloom.llm.common import held

#: Bytes with A-Z lower-cased.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 300_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hashes() -> WordHashes:
    """The hashes that this worker remembers."""
    return held("hashes", WordHashes)


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text, as UTF-8: runs of anything but ASCII white space."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.translate(LOWER) if lower else data).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """One hash for every run of ``size`` words: a polynomial over their hashes, scrambled."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(base | 1)
    for k in range(size):
        out = out * factor + hashes[k : k + n]
    return mixed(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    words = hashes().of(split(text, lower=True))
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < size:
        return mixed(windows(words, n) + np.uint64(n))
    return np.unique(windows(words, size))
