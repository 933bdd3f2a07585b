"""Vectorised word hashing over Arrow text columns.

A batch of texts is one UTF-8 buffer with offsets, so words, their 64-bit hashes and
their documents come out of a few array passes, with no object per word. Texts are taken
in slices of about a quarter of a megabyte, always whole texts, so that memory is bounded by the slice
or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Byte classes. White space as in the class [\x20\x09-\x0D]; or all of ASCII but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]

#: Codes of bytes in a hash; LOWER folds A-Z only.
EXACT = np.arange(1, 257, dtype=np.uint64)
LOWER = EXACT.copy()
LOWER[65:91] += np.uint64(32)


#: Powers for more bytes than this are made anew each time, so that a worker does not keep the arrays of one very long text.
_KEPT_POWERS = 1 << 21


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= _KEPT_POWERS:
        _POWERS[:] = made
    return made[0], made[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) of each pair, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a slice of texts: hashes, first and last byte, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, codes: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        gap = separators[data]
        before = np.empty(n + 1, bool)
        before[0] = True
        before[1:] = gap
        after = before[1:].copy()
        before = before[:-1]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before = before.copy()
        before[inner] = True
        ends_here = np.empty(n, bool)
        if n:
            ends_here[:-1] = gap[1:]
            ends_here[-1] = True
            ends_here[inner - 1] = True
        solid = ~after
        self.starts = np.flatnonzero(solid & before)
        self.ends = np.flatnonzero(solid & ends_here) + 1
        self.total = self.prefix(codes)
        self.hash = self.spans(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)  # text i has words first[i]:first[i + 1]
        self.n_words = np.diff(self.first)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[self.data] * _powers(n + 1)[0][:n], out=total[1:])
        return total

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        value = (self.total[ends] - self.total[starts]) * _powers(len(self.data) + 1)[1][starts]
        return mix(value ^ (ends - starts).astype(np.uint64))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte 0/1 array over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of hashes[i:i + size] for each i (fewer than len(hashes); none if that is too short)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def window_owner(first: np.ndarray, size: int, n_windows: int) -> np.ndarray:
    """The text of each window, or -1 where a window runs over the end of its text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n_windows]
    last = np.arange(n_windows) + size <= first[1:][owner]
    return np.where(last, owner, -1)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) for runs of whole texts of about limit bytes; a null text has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, where, what = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_slices(texts: pa.Array, separators: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, offsets in text_slices(texts):
        yield lo, hi, Words(data, offsets, separators, codes)
