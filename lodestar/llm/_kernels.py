"""Array kernels that turn Arrow string columns into word hashes, a slice of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_GRAM = U(0xD1342543DE82EF95)
#: Bytes of text that one slice holds at most; a longer document is a slice of its own.
SLICE_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: U) -> U:
    return U(pow(int(base), -1, 1 << 64))


_BYTES = mix((np.arange(256, dtype=U) + U(1)) * U(0xA0761D6478BD642F))
_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: U, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of base and of its inverse. One table a base is kept, of the size that a slice needs; a longer document's is dropped after it."""
    if n > 1 << 19:
        return _powers(base, n), _powers(_inverse(base), n)
    if int(base) not in _CACHE:
        _CACHE[int(base)] = _powers(base, 1 << 19), _powers(_inverse(base), 1 << 19)
    return _CACHE[int(base)]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is True for the bytes that separate words."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Separators of the word pattern [^\x20\x09-\x0D]+.
BLANKS = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Separators of the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; applied after A-Z became a-z.
SYMBOLS = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of consecutive documents. bounds[i]:bounds[i+1] are the words of document i of the slice."""

    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position, and whether they all lie in one document."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(n, dtype=U), np.zeros(n, dtype=bool)
        h = self.hashes if not salt else mix(self.hashes + U(salt))
        last = np.repeat(self.bounds[1:], self.counts)
        whole = np.arange(n) + k <= last
        if k <= 6:
            out, m = h[: n - k + 1].copy(), n - k + 1
            for j in range(1, k):
                out = out * _GRAM + h[j : j + m]
        else:
            up, down = _tables(_GRAM, n + 1)
            total = np.zeros(n + 1, dtype=U)
            np.cumsum(h * up[:n], out=total[1:])
            out = (total[k:] - total[: n - k + 1]) * down[: n - k + 1]
        return np.concatenate([mix(out), np.zeros(k - 1, dtype=U)]), whole


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, at


def word_hashes(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray, lower: bool) -> Words:
    """Hashes of all words of documents whose bytes follow one another in data."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    at = offsets - base
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~blanks[data]
    edge = np.diff(inside)
    # a document's end also ends a word
    cut = at[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    touching = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(touching):
        starts, ends = np.sort(np.concatenate([starts, touching])), np.sort(np.concatenate([ends, touching]))
    up, down = _tables(_BASE, n + 1)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    bounds = np.searchsorted(starts, at)
    return Words(bounds, hashes, starts, ends, data)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about SLICE_BYTES with their bytes and offsets."""
    raw, at = text_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, raw, at[i : j + 1]
        i = j


def hashed(column: pa.Array, blanks: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of a string column with the words of their texts."""
    for i, j, raw, at in slices(column):
        yield i, j, word_hashes(raw, at, blanks, lower)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
