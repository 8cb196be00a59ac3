"""Vectorised word tools on Arrow text columns.

The texts of an Arrow batch lie in one UTF-8 buffer. Word classes here are
sets of ASCII bytes (every byte from 0x80 up is a word byte), so words are
found on bytes, for all texts of a block at once. Blocks hold about a MB of
whole texts (one text alone if it is larger), which bounds memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20


def _table(separators) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: word bytes of ``[^\x20\x09-\x0D]+``
NOT_SPACE = _table([0x20, *range(0x09, 0x0E)])
#: word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z went to a-z
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
#: Spans up to this many bytes are hashed together, longer ones by XXH64.
SHORT_SPAN = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return _LOWER[data]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's offset in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Hand memory that was freed back to the system: a Python worker stays
    for the next task, and what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), n)
            yield batch.slice(lo, hi - lo), data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
            lo = hi
    give_back()


@dataclass
class Words:
    """Words of a block: byte spans, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, seed)


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = word_bytes[data]
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a word that runs over the end of its text is cut there
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts - 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span. Short spans take in eight bytes a
    round, all spans at once, and mix after every round (spans of one length
    up to eight bytes never share a hash); longer spans are hashed one by one.
    Different seeds give independent hashes."""
    left = ends - starts
    h = (left + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    long = np.flatnonzero(left > SHORT_SPAN)
    if len(long):
        raw = memoryview(data.tobytes())
        h[long] = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    live = np.flatnonzero(left <= SHORT_SPAN)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at, left, now = starts[live], left[live], h[live]
    while len(live):
        now = mix((now + np.uint64(_BASE)) ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)]))
        last = left <= 8
        h[live[last]] = now[last]
        more = ~last
        live, at, left, now = live[more], at[more] + 8, left[more] - 8, now[more]
    return h


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct span, each span's number);
    spans of one hash are compared byte by byte."""
    _, one, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, chosen = ends - starts, one[number]
    apart = size != size[chosen]
    checked = np.where(apart, 0, size)
    offset = np.cumsum(checked) - checked
    step = np.arange(int(checked.sum()))
    differs = data[np.repeat(starts - offset, checked) + step] != data[np.repeat(starts[chosen] - offset, checked) + step]
    if differs.any():
        apart[np.repeat(np.arange(len(starts)), checked)[differs]] = True
    apart = np.flatnonzero(apart)
    number[apart] = len(one) + np.arange(len(apart))
    return np.concatenate([one, apart]), number


def window_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every ``n`` consecutive values (across texts too: the caller
    drops windows that leave a text)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    base = _BASE + 2 * seed * 0x632BE5AB
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += h[k: k + m] * np.uint64(pow(base, n - 1 - k, 1 << 64))
    return mix(out + np.uint64(n))


def joined_words(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block with one space after each: bytes, starts, ends."""
    sizes = w.ends - w.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if not len(ends):
        return np.zeros(0, np.uint8), starts, ends
    at = np.repeat(w.starts - starts, sizes + 1) + np.arange(int(ends[-1]) + 1)
    at[ends] = 0
    out = w.data[at]
    out[ends] = 0x20
    return out, starts, ends


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
