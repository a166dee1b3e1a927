"""Words of whole texts as arrays: positions and 64-bit hashes, without a loop over words.

A batch of texts is one run of UTF-8 bytes. Word borders are changes of a byte
class; the hash of a word is a difference of running sums of ``table[byte] * base**i``,
so that words of any length cost the same per byte.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # bytes of text handled at once; a longer text is a slice of its own
_BASE = np.uint64(0x9E3779B97F4A7C17)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A-Z are lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def release() -> None:
    """Give back what earlier tasks of a reused worker left unused in its heaps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * _BASE)


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, back, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@dataclass
class Words:
    """``row[i]:row[i + 1]`` are the words of text ``i``; ``start`` and ``end`` are byte positions in ``data``."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    text: np.ndarray  # byte position at which each text starts, and the end of the last one

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 positions of their borders; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(offsets):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def find(texts: pa.Array, word: np.ndarray = NOT_SPACE, lower: bool = False, hashed: bool = True) -> Words:
    """Words of every text; ``word`` marks the bytes that belong to words."""
    data, at = text_bytes(texts)
    inside = word[data]
    borders = at[:-1][at[:-1] < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[borders] = inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(start, at)
    if not hashed or not len(start):
        return Words(row, start, end, np.empty(0, np.uint64), data, at)
    up, down = _powers(max(SLICE_BYTES + 1, len(data) + 1))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[lower][data] * up[:len(data)], out=sums[1:])
    value = (sums[end] - sums[start]) * down[start]
    return Words(row, start, end, mix(value + (end - start).astype(np.uint64)), data, at)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words; entry ``i`` starts at word ``i`` (texts are not told apart)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _BASE + hashes[i:i + n]
    return mix(out)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    begin, before = 0, 0
    while begin < batch.num_rows:
        stop = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(begin, stop - begin)
        begin, before = stop, int(total[stop - 1])


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions ``start[i], start[i] + 1, ...`` (``count[i]`` of each), one after the other."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total) - np.repeat(before - start, count)


def joined(found: Words, word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words as one run of bytes, a single space behind each: the bytes, and each word's start and end in them.

    Consecutive words of a text, joined by one space, are one stretch of these bytes.
    ``word`` is the byte class by which the words were found.
    """
    length = found.end - found.start
    start = np.cumsum(length + 1) - (length + 1)
    end = start + length
    data = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
    letter = np.ones(len(data), dtype=bool)
    letter[end] = False
    letters = found.data[word[found.data]]
    data[letter] = LOWERED[letters] if lower else letters
    return data, start, end
