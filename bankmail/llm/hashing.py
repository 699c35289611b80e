"""Vectorised hashes of words, runs of words and shingles, for whole Arrow batches of texts.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. Hashes are 64 bits,
equal everywhere for equal words, so they name words across all tasks without a shuffle.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII bytes that are no letter and no digit, for words without punctuation.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Sequences are hashed by a polynomial modulo this prime, at a base drawn once at random.
PRIME = (1 << 61) - 1
_BASE = 0x0B5CF1D7A93E2468 % PRIME
_INVERSE = pow(_BASE, -1, PRIME)
_powers = {base: np.ones(1, U64) for base in (_BASE, _INVERSE)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it, by halves of 31 bits."""
    low, half = U64((1 << 31) - 1), U64(31)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    return reduced((ah * bh << U64(1)) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << half) + al * bl)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0, 1, ... below n, modulo the prime."""
    have = _powers[base]
    while len(have) < n:
        have = np.append(have, product(have, np.full(1, pow(base, len(have), PRIME), U64)))
    _powers[base] = have
    return have[:n]


def prefixes(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... terms values[i] * base ** i, modulo the prime."""
    terms = product(reduced(values), powers(len(values)))
    high, low = np.cumsum(terms >> U64(32), dtype=U64), np.cumsum(terms & U64(0xFFFFFFFF), dtype=U64)
    return np.append(np.zeros(1, U64), reduced(product(reduced(high), np.full(1, 1 << 32, U64)) + reduced(low)))


def between(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """From `prefixes`, the polynomial of each stretch, wherever it stands."""
    gap = sums[end] + U64(PRIME) - sums[first]
    return product(reduced(gap), powers(len(sums), _INVERSE)[first])


def spans_hash(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[first:end] for each pair; equal content, equal hash."""
    return mix(between(prefixes(values), first, end) ^ ((end - first).astype(U64) * _MULTIPLIER))


def bytes_hash(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[first:end] for each pair: eight bytes at a time, mixed after each step."""
    length = end - first
    out = mix(length.astype(U64) * _MULTIPLIER)
    wide = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))  # the eight bytes from each place on
    long = length > LONG_WORD
    live = np.flatnonzero(~long & (length > 0))
    for at in range(0, LONG_WORD, 8):
        live = live[length[live] > at]
        if not len(live):
            break
        eight = wide[first[live] + at]
        rest = np.minimum(length[live] - at, 8).astype(U64)
        eight = eight & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * rest))
        out[live] = mix(out[live] * _MULTIPLIER + mix(eight + U64(at + 1)))
    for k in np.flatnonzero(long):
        out[k] = int.from_bytes(hashlib.blake2b(data[first[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """The words of several texts in one row: hash of each, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE):
        self.data, self.offsets = _LOWER[data] if lower else data, offsets
        solid = ~between[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        full = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[full] |= solid[full]
        last = full[full > 0] - 1
        ends[last] |= solid[last]
        self.first, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.starts = np.searchsorted(self.first, offsets)
        self.hashes = self.heads(None)

    def heads(self, most: int | None) -> np.ndarray:
        """Hash of each word's first `most` bytes, or of all."""
        return bytes_hash(self.data, self.first, self.end if most is None else np.minimum(self.end, self.first + most))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def released() -> None:
    """Hand memory that a task no longer uses back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # no such call on this system


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into some of about `size` bytes of text, so that memory is bounded by the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto
    released()


def words_of(batch: pa.RecordBatch, text: str = "text", **how) -> Words:
    return Words(*text_buffers(batch.column(text)), **how)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every run of k words; of all its words where a text has fewer; none without words."""
    n = words.counts
    each = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    of = np.repeat(np.arange(len(n)), each)
    within = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    first = words.starts[:-1][of] + within
    length = np.minimum(n[of], k)
    out = length.astype(U64)
    padded = np.concatenate([words.hashes, np.zeros(k, U64)])
    for j in range(k):
        out = out * _MULTIPLIER + np.where(j < length, padded[first + j], U64(0))
    return mix(out), of


def distinct(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and the n + 1 bounds between the texts."""
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(n + 1))
