"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 bytes of a slice of a batch, without a Python loop over words. A word's hash is the sum of one
64-bit value for each of its bytes, drawn for the pair of byte and position in the word, so it is one subtraction from a
prefix sum; a finaliser spreads the bits. The values follow no rule that texts could meet by their structure: two different
words have equal hashes with a probability of 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Bytes that lower-case A-Z and leave all others.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Letters, digits and bytes of non-ASCII characters; the rest separates words for the lexical features.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

SLICE_BYTES = 1 << 20
_PLACES = 64
#: The values of the first positions are drawn; those of later ones are `mix` of position and byte.
_VALUES = np.random.default_rng(20240601).integers(0, 1 << 64, (_PLACES << 8), dtype=np.uint64)
_STEP = np.random.default_rng(77).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR, _PLACE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)


def tidy(run: Callable) -> Callable:
    """A function of batches that, at its task's end, gives the memory that its worker has freed back to the system."""

    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def places(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of n entries how far it lies behind the last of the sorted `starts` (0 before the first)."""
    if not len(starts):
        return np.zeros(n, np.int32)
    lens = np.diff(np.append(starts, n))
    out = np.arange(n, dtype=np.int32)
    out[starts[0] :] -= np.repeat(starts.astype(np.int32), lens)
    out[: starts[0]] = 0
    return out


def byte_sums(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes' values, with positions counted from the last of the sorted `starts`: the hash of a run of
    bytes that begins at a start is a difference of two of them."""
    place = places(starts, len(buf))
    far = np.flatnonzero(place >= _PLACES)
    v = _VALUES[(np.minimum(place, _PLACES - 1) << 8) | buf]
    if len(far):
        v[far] = mix((place[far].astype(np.uint64) << np.uint64(8) | buf[far]) * _PLACE + _FAR)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(v, out=out[1:], dtype=np.uint64)
    return out


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes from starts (sorted) to ends, which don't overlap."""
    distinct = starts if len(starts) < 2 or (starts[1:] > starts[:-1]).all() else np.unique(starts)
    distinct = distinct[: np.searchsorted(distinct, len(buf))]
    sums = byte_sums(buf, distinct)
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets, from 0; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    elif pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        col, kind = col.cast(pa.large_string()), np.int64
    if col.null_count:
        col = col.fill_null("" if "string" in str(col.type) else b"")
    _, offsets, data = col.buffers()
    n = len(col)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of a batch whose column holds about `limit` bytes, or one row if that is longer."""
    _, offs = column_bytes(batch.column(batch.schema.get_field_index(name)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


class Words:
    """The words of a slice: byte bounds, and for each document the range of its words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE):
        self.buf, self.offs = buf, offs
        n = len(buf)
        inside = ~space[buf]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        edge = np.empty(n, bool)
        if n:
            edge[0] = True
            edge[1:] = ~inside[:-1]
            edge |= first[:n]
            starts = np.flatnonzero(inside & edge)
            edge[:-1] = ~inside[1:]
            edge[:-1] |= first[1:n]
            edge[-1] = True
            ends = np.flatnonzero(inside & edge) + 1
        else:
            starts = ends = np.zeros(0, np.int64)
        self.starts, self.ends = starts, ends
        self.at = np.searchsorted(starts, offs)  # words of document d: at[d] to at[d + 1]

    def __len__(self) -> int:
        return len(self.starts)

    def prefix_sums(self, fold: np.ndarray | None = None) -> np.ndarray:
        return byte_sums(self.buf if fold is None else fold[self.buf], self.starts)

    def hashes(self, fold: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.prefix_sums(fold) if sums is None else sums
        return mix(sums[self.ends] - sums[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.at))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive entries; len(words) - size + 1 values."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += words[k : k + n] * _STEP[k]
    return mix(h)


def sequence_sums(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Prefix sums over word hashes, each mixed with its place behind the last of the sorted `starts`."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + places(starts, len(words)).astype(np.uint64) * _PLACE), out=out[1:], dtype=np.uint64)
    return out


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each document its sorted distinct shingle hashes: `size` words each, lower-cased A-Z.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    w = Words(buf, offs)
    h = w.hashes(LOWER)
    shingles = window_hashes(h, size)
    out = []
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        if b - a >= size:
            s = shingles[a : b - size + 1].copy()
            s.sort()
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif b > a:
            out.append(mix((h[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges starts[i] to starts[i] + lens[i]."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)
