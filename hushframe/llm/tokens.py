"""Words of many UTF-8 texts at once, in numpy: bounds, hashes and shingles without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one round of the hash arithmetic covers; bounds its memory (8 bytes a byte of text, a few times).
BLOCK = 1 << 20
_M = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_table(separators: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of words, given the separators' byte ranges (ends included)."""
    table = np.ones(256, dtype=bool)
    for lo, hi in separators:
        table[lo : hi + 1] = False
    return table


#: Letters a-z, digits and all that is not ASCII.
ALNUM = word_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: All but ASCII white space.
NON_SPACE = word_table([(0x20, 0x20), (0x09, 0x0D)])


@lru_cache(1)
def _bytes_to_random() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_M) * _M(0xD1342543DE82EF95))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    inverse = pow(_MUL, -1, 1 << 64)
    up, down = np.full(n, _MUL, dtype=_M), np.full(n, inverse, dtype=_M)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of SplitMix64, a public generator)."""
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = pa.array([], pa.large_string()) if texts is None else texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words, and for each text the number of words before it."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = table[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = at[:-1][at[:-1] < n]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends_at = at[1:][at[1:] > 0] - 1
    after[ends_at] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased bytes: a polynomial modulo 2**64 over random byte values, mixed."""
    out = np.empty(len(starts), _M)
    i, n, random = 0, len(starts), _bytes_to_random()
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(1 << max(20, int(hi - lo).bit_length()))
        sums = np.empty(hi - lo + 1, _M)
        sums[0] = 0
        np.cumsum(random[low[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(_M)
        i = j
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``size`` words; a text with fewer words, but not none, gives one of all its words."""
    n = len(word)
    counts = np.diff(first)
    if n == 0:
        return np.zeros(0, _M), np.zeros(0, np.int64)
    h = np.zeros(max(0, n - size + 1), _M)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * _M(_MUL) + word[j : j + len(h)]
    text = owners(first)[: len(h)]
    whole = np.arange(len(h)) + size <= first[1:][text]
    h, text = mix(h[whole] + _M(size)), text[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = []
        for t in short:
            x = 0
            for w in word[first[t] : first[t + 1]]:
                x = (x * _MUL + int(w)) & 0xFFFFFFFFFFFFFFFF
            extra.append((x + int(counts[t])) & 0xFFFFFFFFFFFFFFFF)
        h, text = np.concatenate([h, mix(np.array(extra, _M))]), np.concatenate([text, short])
    return h, text


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    """The C library's call that gives freed memory back, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def release() -> None:
    """Give what this worker has freed back to the machine: workers are kept between stages, and their freed memory with them."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text, one row at least. Memory is given back after each batch."""
    texts = batch.column(column).cast(pa.large_string())
    if len(texts) == 0:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    release()
