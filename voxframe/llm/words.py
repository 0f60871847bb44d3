"""Words of many texts as numbers, for work on whole arrays inside a task."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import xxhash

# Words a worker remembers before it starts anew; a new word costs time, never a result
REMEMBERED = 400_000


class Words(dict):
    """Place of each word in arrays that grow with the words seen; `make(new words)` gives the new rows.

    Each distinct word is worked out once, then every occurrence is a lookup.
    """

    def __init__(self, make: Callable[[list[bytes]], list[np.ndarray]]):
        self.make, self.new, self.rows = make, [], None

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place

    def places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place of every word of all texts, number of words of each); words stand between ASCII white space."""
        if len(self) > REMEMBERED:
            self.clear()
            self.rows = None
        split = [t.split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        if self.new or self.rows is None:
            made = self.make(self.new)
            self.rows = made if self.rows is None else [np.concatenate(p) for p in zip(self.rows, made)]
            self.new = []
        return flat, lengths


def hashed(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: every bit of the result hangs on every bit of the value."""
    v = values ^ np.uint64(int(seed) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    v = (v ^ (v >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    v = (v ^ (v >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return v ^ (v >> np.uint64(33))


def shingled(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` values from each place on; the last width - 1 places are left out."""
    n = max(0, len(ids) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + n]
    return mixed(out, width)


def owners(lengths: np.ndarray) -> np.ndarray:
    """Number of the text of each word."""
    return np.repeat(np.arange(len(lengths)), lengths)


def normal(word: bytes) -> bytes:
    """Case folded, without punctuation at the ends; may be empty."""
    return word.decode("utf-8", "replace").casefold().strip("""!"#$%&'()*+,-./:;<=>?@[]^_`{|}~""").encode()
