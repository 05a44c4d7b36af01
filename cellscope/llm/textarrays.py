"""Words and hashes of many texts at once, on NumPy arrays over Arrow's own buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: Bytes that a span hash reads in a vector step; longer spans go through a digest.
LONG = 64
#: Masks that keep the first bytes of eight.
LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_TOP = _U(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str | int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes of text (or one row), with their buffers."""
    if not batch.num_rows:
        return
    data, offsets = text_buffers(batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, batch.num_rows)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text, closed by their number) of runs without white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first] = word[first]
    end[last] = word[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def octets(data: np.ndarray) -> np.ndarray:
    """At each index the eight bytes from there on as one number; past the end they are zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of spans, A-Z read as a-z unless ``lower`` is off.

    Spans of at most seven bytes never share a hash. Longer ones are mixed eight bytes at a time,
    or digested beyond LONG bytes, so two share one by chance only, whatever their pattern.
    """
    if lower:
        data = LOWER[data]
    sizes = ends - starts
    view = octets(data)
    out = view[starts] & LOW_BYTES[np.minimum(sizes, 8)]
    out |= np.where(sizes <= 7, sizes, 0).astype(np.uint64) << _U(56)
    at = np.flatnonzero((sizes > 7) & (sizes <= LONG))
    h, done = mix(out[at] ^ (sizes[at].astype(np.uint64) * _STEPS[0])), 8
    while True:
        more = np.flatnonzero(sizes[at] > done)
        if not len(more):
            break
        left = at[more]
        h[more] = mix((h[more] ^ (view[starts[left] + done] & LOW_BYTES[np.minimum(sizes[left] - done, 8)])) * _STEPS[2])
        done += 8
    out[at] = h | _TOP
    far = np.flatnonzero(sizes > LONG)
    if len(far):
        raw = data.tobytes()
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True))
        out[far] = np.frombuffer(digests, "<u8") | _TOP
    return mix(out)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text) of k-word shingles; a shorter text is one shingle of all its words."""
    counts = np.diff(firsts)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    begin = np.repeat(firsts[:-1] - out_offsets[:-1], sizes) + np.arange(out_offsets[-1])
    length = np.repeat(np.minimum(counts, k), sizes)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = length.astype(np.uint64) * _STEPS[1]
    short = counts.min(initial=k) < k
    for i in range(k):
        part = mix(padded[begin + i] + _U(int(_STEPS[i % 5]) * (i + 1) % (1 << 64)))
        total += np.where(length > i, part, _U(0)) if short else part
        total *= _STEPS[2] | _U(1)
    return mix(total), out_offsets


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        s = np.sort(hashes[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out
