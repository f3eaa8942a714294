"""Small text helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words are runs of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split()`` yields.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets everything at ``most`` entries, so memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all ``width``-word windows; a shorter text is one window."""
    n = len(hashes)
    if n == 0:
        return hashes
    w = min(width, n)
    out = np.full(n - w + 1, n if n < width else 0, np.uint64)
    for i in range(w):
        out = mix(out * M3 + hashes[i : n - w + 1 + i])
    return np.unique(out)


def rows(batches: Iterable[pa.RecordBatch], *columns: str, slice_rows: int = 512) -> Iterator[list[list]]:
    """The named columns as Python lists, a few hundred rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, slice_rows):
            part = batch.slice(at, slice_rows)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
