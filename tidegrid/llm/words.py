"""Words, shingles and their 64-bit hashes for whole batches of texts, in numpy.

A batch is handled as one run of UTF-8 bytes. The hash of a word is a difference of running sums of ``T[byte] * P**place``
brought back to place 0, so no Python code runs per word. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_SHINGLE = np.uint64(0xD1342543DE82EF95)

#: Bytes handled at once (a longer text is one chunk of its own).
CHUNK_BYTES = 1 << 19


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser: neighbouring values come out unrelated."""
    out = values ^ (values >> np.uint64(30))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def _byte_table(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: is it part of a word, and its hash value (A-Z like a-z)."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
    values[65:91] = values[97:123]
    return inside, values


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < size, kept for the next batch."""
    length = max(CHUNK_BYTES * 2, 1 << max(size - 1, 1).bit_length())
    if length not in _powers:
        _powers.clear()
        up = np.full(length, _P, dtype=np.uint64)
        down = np.full(length, _P_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[length] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[length]


@dataclass
class Words:
    """The words of consecutive texts: hashes, first and last byte, the range of words and of bytes of each text."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    text_bounds: np.ndarray
    sums: np.ndarray

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of the words."""
        cut = np.minimum(self.start + size, self.end)
        down = _power_tables(len(self.data) + 1)[1]
        return mix((self.sums[cut] - self.sums[self.start]) * down[self.start] + np.uint64(1000 + size))

    def __len__(self) -> int:
        return len(self.bounds) - 1


class Splitter:
    """Cuts texts into words; ``separators`` are the single-byte characters between words."""

    def __init__(self, separators: bytes, chunk_bytes: int = CHUNK_BYTES):
        self.inside, self.values = _byte_table(separators)
        self.chunk_bytes = chunk_bytes

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, Words]]:
        """(number of the first text, words of the texts from there), in chunks of about ``chunk_bytes``; null: no words."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + self.chunk_bytes, side="right")) - 1
            last = min(max(last, first + 1), len(texts))
            yield first, self._split(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last

    def _split(self, data: np.ndarray, bounds: np.ndarray) -> Words:
        inside = self.inside[data]
        opens, closes = inside.copy(), inside.copy()
        if len(data):
            edges = np.zeros(len(data) + 1, dtype=bool)
            edges[bounds] = True
            opens[1:] &= ~inside[:-1] | edges[1:-1]
            closes[:-1] &= ~inside[1:] | edges[1:-1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * up[: len(data)], out=sums[1:], dtype=np.uint64)
        hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        return Words(hashes, start, end, np.searchsorted(start, bounds), data, bounds, sums)


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``size`` words; of fewer words, the whole run; of none, nothing."""
    hashes, bounds = words.hashes, words.bounds
    runs = np.zeros(0, dtype=np.uint64)
    if len(hashes) >= size:
        runs = hashes[: len(hashes) - size + 1].copy()
        for k in range(1, size):
            runs = runs * _SHINGLE + hashes[k : len(hashes) - size + 1 + k]
        runs = mix(runs + np.uint64(size))
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        count = last - first
        if count >= size:
            found = np.sort(runs[first : last - size + 1])
            keep = np.empty(len(found), dtype=bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif count:
            whole = np.zeros(1, dtype=np.uint64)
            for value in hashes[first:last]:
                whole = whole * _SHINGLE + value
            yield mix(whole + np.uint64(count))
        else:
            yield np.zeros(0, dtype=np.uint64)


#: White space, as in the pattern [^\x20\x09-\x0D]+.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: All of ASCII but digits and letters, as in [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
PUNCTUATION = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
