"""Words and their hashes from whole batches of UTF-8 text, by array operations."""

from __future__ import annotations

import numpy as np

from kinmatch.llm.common import mixed

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(1, np.uint64)
        top = base
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(top)])
            top = top * top % 2**64
        _POWERS[base] = have
    return have[:n]


def table(pattern_bytes: bytes) -> np.ndarray:
    """Which bytes belong to words."""
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: Digits, letters after lower-casing, and all that is not ASCII.
ALNUM = table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: All but the space and \t to \r.
NONSPACE = table(bytes(x for x in range(256) if x != 0x20 and not 9 <= x <= 13))


#: Positions in a word with a table of their own, and the bytes that are hashed at a time.
NEAR, AT_ONCE = 256, 1 << 18
_VALUES = mixed(mixed(np.arange(NEAR * 256, dtype=np.uint64) + np.uint64(BASE)))


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word low[start:end]: the sum of a scrambled value for each byte and its place in the word, so that the bytes' order and pattern leave no structure."""
    sums = np.zeros(len(starts), np.uint64)
    for a in range(0, len(low), AT_ONCE):  # a sum may take parts of a word one by one
        b = min(a + AT_ONCE, len(low))
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if i >= j:
            continue
        first = np.maximum(starts[i:j], a)
        size = np.minimum(ends[i:j], b) - first
        before = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(first - before, size)
        value = np.repeat(starts[i:j], size)
        np.subtract(place, value, out=value)
        value <<= 8
        value |= low[place]
        if int(value[-1]) < 256 * NEAR and int(value.max()) < 256 * NEAR:
            terms = _VALUES[value]
        else:
            terms = mixed(mixed(value.view(np.uint64) + np.uint64(BASE)))
        sums[i:j] += np.add.reduceat(terms, before)
    return mixed(sums + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (in data), 64-bit hash and text number of each word of the texts between offsets, A-Z lower-cased. Words end where their text ends."""
    base, text = int(offsets[0]), data[offsets[0] : offsets[-1]]
    n = len(text)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none
    low = LOWER[text]
    inside = kind[low]
    edge = np.empty(n, bool)  # whether the byte before belongs to another text or to no word
    edge[0] = True
    np.logical_not(inside[:-1], out=edge[1:])
    cuts = (offsets[:-1] - base)[np.diff(offsets) > 0]
    edge[cuts] = True
    starts = np.flatnonzero(inside & edge)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts[1:] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    hashes = word_hashes(low, starts, ends)
    doc = np.searchsorted(offsets, starts + base, "right") - 1
    return starts + base, ends + base, hashes, doc
