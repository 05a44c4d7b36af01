"""MD5 of many short keyed texts at once: the first 31 bits, as the keyed draws need them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_PLACES = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16) for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Values worked on at once, so that the state stays in the processor's cache, and the longest text of one block.
CHUNK, LONGEST = 32_768, 55


def _first_word(words: list, shape: tuple[int, ...]) -> np.ndarray:
    """The first word of the digest of one block: 16 words, each a number or an array that spreads over the shape.

    The first word is last written in step 61 of 64."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[_PLACES[i % 16][turn]]
        np.add(f, a, out=f)
        if isinstance(word, int):
            np.add(f, np.uint32((word + _SINES[i]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, np.uint32(_SINES[i]), out=f)
            np.add(f, word, out=f)
        s = _SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(s), out=g)
        np.right_shift(f, np.uint32(32 - s), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    # after 61 steps the new value stands second
    return np.add(b, np.uint32(_START[0]), out=b)


def _packed(texts: list[bytes], at: int, end: bool) -> list:
    """Little-endian words of equally long texts that begin at a byte of the block; ``end`` closes the block."""
    n, size = len(texts), len(texts[0])
    rows = np.zeros((n, 64), np.uint8)
    if size:
        rows[:, at : at + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(n, size)
    if end:
        rows[:, at + size] = 0x80
        rows[:, 56:] = np.frombuffer((8 * (at + size)).to_bytes(8, "little"), np.uint8)
    words = np.ascontiguousarray(rows.view("<u4").astype(np.uint32).T)
    return [int(w[0]) if (w == w[0]).all() else w for w in words]


def keyed_ints(name: str, first: int, last: int, units: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(replicates as a slice of first..last, indexes of units, values of shape replicates x units): the first
    eight hexadecimal digits of md5("name:replicate:unit") mod 2^31 for all replicates and units, in pieces."""
    raw = [u.encode() for u in units]
    sizes = np.array([len(r) for r in raw], np.int64)
    groups = [np.flatnonzero(sizes == s) for s in np.unique(sizes)]
    low = first
    while low < last:
        high = min(last, 10 ** len(str(low)))  # replicates with as many digits
        heads = [f"{name}:{b}:".encode() for b in range(low, high)]
        at = len(heads[0])
        for members in groups:
            size = int(sizes[members[0]])
            for i in range(0, len(members), CHUNK):
                some = members[i : i + CHUNK]
                tails = [raw[k] for k in some]
                many = max(1, CHUNK // len(some))
                tail = _packed(tails, at, True) if at + size <= LONGEST else None
                for j in range(0, len(heads), many):
                    part = heads[j : j + many]
                    if tail is None:  # more than one block
                        hashed = [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails] for h in part]
                        out = np.array(hashed, np.uint32)
                    else:
                        words = []
                        for h, t in zip(_packed(part, 0, False), tail):
                            h = h if isinstance(h, int) else h[:, None]
                            words.append((h + t) if isinstance(h, int) and isinstance(t, int) else (np.uint32(h) if isinstance(h, int) else h) + (np.uint32(t) if isinstance(t, int) else t))
                        out = _first_word(words, (len(part), len(some)))
                        out.byteswap(inplace=True)
                    out &= np.uint32(0x7FFFFFFF)
                    yield slice(low - first + j, low - first + j + len(part)), some, out
        low = high
