"""Vectorised word arrays: the shared numpy kernel of the text operators.

Texts are handled as UTF-8 bytes. A group of texts is joined into one buffer, split at separator
bytes, and every word and every run of k words gets a 64-bit hash by prefix sums of a polynomial
modulo 2**64. Two independent multipliers give 128 bits where equality has to be exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is a group of its own.
GROUP_BYTES = 1_000_000
#: Bytes, or words, that are hashed at once: tables of powers and passing arrays stay that small in each Python worker.
HASHED = 1 << 16
#: Multipliers of the two word polynomials and of the two window polynomials (odd, hence invertible).
WORD_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
RUN_MULT = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_M64 = (1 << 64) - 1


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: True for the bytes in the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words are runs of anything but a blank and the five ASCII controls 9 to 13.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII digits, small letters and all beyond ASCII.
NOT_WORD = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


@lru_cache(maxsize=16)
def _powers(mult: int, size: int) -> np.ndarray:
    out = np.full(size, mult, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of mult and of its inverse modulo 2**64."""
    size = max(2 * HASHED, 1 << int(n).bit_length())  # one size serves nearly all
    return _powers(mult, size)[:n], _powers(pow(mult, -1, 1 << 64), size)[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xE9846AF9B1A615D)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E6C63D0876A9A35)
    h ^= h >> np.uint64(32)
    return h


def _spanned(values: np.ndarray, start: np.ndarray, end: np.ndarray, mult: int) -> np.ndarray:
    """The polynomial hash of the values in each span [start, end)."""
    up, down = powers(mult, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


@dataclass
class Words:
    """Words of a group of texts: byte spans, text number of each word, first word of each text."""

    raw: bytes
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """One 64-bit hash a word."""
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        out = np.empty(len(self), dtype=np.uint64)
        lo = 0
        while lo < len(self):  # a hash does not depend on its place, so whole words are taken up to HASHED bytes, one at least
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + HASHED, side="right")))
            at = int(self.start[lo])
            start, end = self.start[lo:hi] - at, self.end[lo:hi] - at
            out[lo:hi] = _spanned(self.buf[at : at + int(end[-1])].astype(np.uint64) + np.uint64(1), start, end, WORD_MULT[which])
            lo = hi
        return out

    def runs(self, k: int) -> np.ndarray:
        """Starts (word numbers) of all runs of k words that lie in one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.text[:n] == self.text[k - 1 :])


def run_hashes(word_hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive words (those across texts are to be ignored)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    step = max(HASHED, k)
    for lo in range(0, n, step):
        m = min(step, n - lo)
        start = np.arange(m)
        out[lo : lo + m] = _spanned(word_hashes[lo : lo + m + k - 1], start, start + k, RUN_MULT[which])
    return out


def split(texts: list[bytes], seps: np.ndarray) -> Words:
    """Words of the texts; a text is whole, however long."""
    raw = b" ".join(texts) + b" "
    buf = np.frombuffer(raw, dtype=np.uint8)
    inside = ~seps[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(raw, buf, start, end, text, first)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[slice]:
    """Slices of consecutive texts of about the given number of bytes."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield slice(lo, len(texts))


def ids(column: pa.Array, missing: int = np.iinfo(np.int64).max) -> np.ndarray:
    """An integer id column; null becomes the largest id."""
    return pc.fill_null(column.cast(pa.int64()), missing).to_numpy(zero_copy_only=False)
