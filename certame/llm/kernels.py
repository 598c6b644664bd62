"""Vectorised helpers that run inside tasks on Arrow batches of text.

Texts stay UTF-8 bytes. The hash of any substring costs two lookups in prefix sums
of a polynomial modulo the prime 2**31 - 1, kept for two bases; a power of two as modulus would let texts be built that
collide under every multiplier. Whoever takes equal hashes for equal texts holds them against the bytes (same_spans).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd multiplier and its inverse modulo 2**64: for choosing among k-grams and for joining hashes, where nothing rests on equality.
MULT = 0x9E3779B97F4A7C15
MULT_INV = pow(MULT, -1, 1 << 64)
PRIME = (1 << 31) - 1
#: The bases of the two lanes.
BASES = (0x3C6EF372, 0x1B873593)
SLICE_BYTES = 1 << 20
#: For kernels that hold many numbers for each byte.
SMALL_SLICE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 << 20:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` bytes, modulo 2**64: cheap, and only for choosing."""
    q = text_hash(data)
    return mix((q[width:] - q[:-width]) * powers(MULT_INV, len(q))[: len(q) - width])


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62 (in place)."""
    high = x >> np.uint64(31)
    x &= np.uint64(PRIME)
    x += high
    return np.minimum(x, x - np.uint64(PRIME), out=x)  # below PRIME the difference wraps around to a large number


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME, kept between calls."""
    have = _powers.get(-base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, _reduced(have * np.uint64(pow(base, len(have), PRIME)))])
        have = have.astype(np.uint32)
        if n <= 4 << 20:
            _powers[-base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """For each lane q with q[i] = sum of (data[j] + 1) * base**j for j < i, modulo PRIME."""
    q = np.zeros((len(BASES), len(data) + 1), dtype=np.uint32)
    for lane, base in enumerate(BASES):
        power = prime_powers(base, len(data))
        for lo in range(0, len(data), block):  # blocks that stay in the processor's cache
            term = data[lo : lo + block].astype(np.uint64)
            term += np.uint64(1)
            term *= power[lo : lo + block]
            term = _reduced(term)
            term[0] += q[lane, lo]
            q[lane, lo + 1 : lo + 1 + len(term)] = _reduced(np.cumsum(term))
    return q


def text_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums for quick_hash(): one lane, modulo 2**64."""
    q = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(MULT, len(data)), out=q[1:])
    return q


def quick_hash(q: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] from text_hash(), for those who compare the bytes afterwards."""
    return mix((q[end] - q[start]) * powers(MULT_INV, len(q))[start])


def span_value(q: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number below 2**62 for data[start:end], independent of where it stands."""
    out = np.zeros(len(start), dtype=np.uint64)
    for lane, base in enumerate(BASES):
        there = prime_powers(pow(base, -1, PRIME), q.shape[1])
        part = _reduced(_reduced(q[lane, end].astype(np.uint64) + np.uint64(PRIME) - q[lane, start]) * there[start])
        out = (out << np.uint64(31)) | part
    return out


def span_hash(q: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_value() and the length, spread over 64 bits."""
    return mix(span_value(q, start, end) + ((end - start).astype(np.uint64) << np.uint64(62)))


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Whether the bytes data[start:end] are those of `other` from other_start on, for each span; `most` bytes at a time."""
    size = (end - start).astype(np.int64)
    out = np.ones(len(size), dtype=bool)
    total = np.append(0, np.cumsum(size))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        own = size[lo:hi]
        span = np.repeat(np.arange(lo, hi), own)
        step = np.arange(int(own.sum())) - np.repeat(total[lo:hi] - total[lo], own)
        x, y = start[span] + step, other_start[span] + step
        inside = y < len(other)
        out[span[~inside]] = False
        x, y, span = x[inside], y[inside], span[inside]
        out[span[data[x] != other[y]]] = False
        lo = hi
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches by rows so that each slice holds about `most` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi
    # Spark keeps the process for later tasks
    pa.default_memory_pool().release_unused()


def word_spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~space[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = at[1:] > at[:-1]
    first[at[:-1][full]] = word[at[:-1][full]]
    last[at[1:][full] - 1] = word[at[1:][full] - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) and the index of each row's first word."""
    low = LOWER[data]
    start, end, rows = word_spans(low, at, space)
    return span_hash(prefix_hash(low), start, end), rows


def shingle_sets(words: np.ndarray, rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; a shorter row is one shingle, none if empty."""
    hashed = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        hashed = hashed * np.uint64(MULT) + words[k : k + len(hashed)]
    hashed = mix(hashed)
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if hi - lo >= width:
            yield np.unique(hashed[lo : hi - width + 1])
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for w in words[lo:hi]:
                whole = np.uint64((int(whole) * MULT + int(w)) & (2**64 - 1))
            yield mix(np.array([whole], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
