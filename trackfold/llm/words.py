"""Words of texts, found on the UTF-8 bytes of whole Arrow slices.

A word is a maximal run of ASCII digits, ASCII letters and non-ASCII characters; only A-Z are lower-cased.
In UTF-8 every byte of a non-ASCII character is 0x80 or more, so the runs can be found on bytes.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 3)
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_BYTE = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_STEP = np.random.default_rng(7).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
#: Bytes whose powers are kept: longer stretches of bytes are summed up in parts of this size.
_PART = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to _PART; kept by the worker."""
    if not _powers:
        for base in (_P, np.uint64(pow(int(_P), -1, 2**64))):
            table = np.full(_PART + 1, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a fixed bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), which must be sorted and not overlap; memory is bounded by _PART."""
    power, inverse = _power_tables()
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = int(np.searchsorted(ends, base + _PART, side="right"))
        if b > a:
            part = data[base : int(ends[b - 1])]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
            s, e = starts[a:b] - base, ends[a:b] - base
            out[a:b] = (total[e] - total[s]) * inverse[s]
        else:  # one range longer than a part
            b, value = a + 1, 0
            for at in range(base, int(ends[a]), _PART):
                part = data[at : min(at + _PART, int(ends[a]))]
                value += int((_BYTE[part] * power[: len(part)]).sum(dtype=np.uint64)) * pow(int(_P), at - base, 2**64)
            out[a] = np.uint64(value % 2**64)
        a = b
    return mix(out + (ends - starts).astype(np.uint64))


def word_table(data: np.ndarray, rows: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of all words, and each row's first word (with the total at the end).

    ``rows`` are byte offsets of the rows in ``data``.  A row without words has as many words as null: none.  With
    ``longest`` a word of more bytes is cut, between characters, into pieces of at most so many that follow each other.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(rows), np.int64)
    inside = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before &= ~edge[:-1]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    if longest is not None and (wide := ends - starts > longest).any():
        count = np.where(wide, -(-(ends - starts) // (longest - 3)), 1)
        number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        cut = np.repeat(starts, count) + number * (longest - 3)
        for _ in range(3):  # a piece begins with a character's first byte
            cut = cut - ((number > 0) & (data[cut] & 0xC0 == 0x80))
        starts, ends = cut, np.where(np.append(number[1:], 0) > 0, np.append(cut[1:], n), np.repeat(ends, count))
    return range_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, rows)


def shingle_table(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words within each row, and each row's first shingle.

    A row with fewer words, but not none, has one shingle of all its words.
    """
    n, counts = len(hashes), np.diff(first)
    long = np.maximum(counts - width + 1, 0)
    out = np.where((counts > 0) & (long == 0), 1, long)
    at = np.concatenate([[0], np.cumsum(out)])
    result = np.zeros(int(at[-1]), np.uint64)
    if n >= width:
        rolled = sum((hashes[k : n - width + 1 + k] * _STEP[k] for k in range(width)), np.zeros(n - width + 1, np.uint64))
        from_ = np.repeat(first[:-1] - at[:-1], out) + np.arange(len(result))
        keep = np.repeat(long > 0, out)
        result[keep] = rolled[from_[keep]]
    for r in np.flatnonzero((counts > 0) & (long == 0)):
        own = hashes[first[r] : first[r + 1]]
        result[at[r]] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(result), at
