"""Byte-level BPE of many texts at once, where equal pieces are encoded once.

Texts are cut at places where no token of the usual word pattern crosses. Pieces
are told apart by 64-bit hashes; those that a worker remembers (their bytes are
compared) bring their ids along, and only the others are encoded. All of it is
array operations; a piece that is remembered takes a few dozen bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from kinmatch.llm.common import joined, ragged
from kinmatch.llm.words import table, word_hashes

#: Bytes of pieces that are looked up at a time.
AT_ONCE = 1 << 20
#: Pieces that are encoded at a time: their strings and lists weigh many times their bytes.
ENCODED = 1 << 13
#: What may follow or precede a cut: ASCII but white space and controls (some of which count as white space).
_INK = table(bytes(range(33, 127)))
_OTHER = table(bytes(range(128, 256)))
#: First bytes of white space beyond ASCII.
_WIDE = table(b"\xc2\xe1\xe2\xe3")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts between offsets (of data, from 0) start; each text that isn't empty starts one.

    The pattern's words take one space before them, so a space before anything
    but white space starts a word; so does a line feed between two characters
    that aren't white space.
    """
    ink = _INK[data]
    after = np.append(ink[1:] | (_OTHER[data[1:]] & ~_WIDE[data[1:]]), False)  # of those that may be white space, none counts
    cuts = (data == 0x20) & after
    cuts |= (data == 0x0A) & np.append(ink[1:], False) & np.concatenate([[False], ink[:-1]])
    first = offsets[:-1][np.diff(offsets) > 0]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    cuts[last[cuts[last]]] = False  # what follows belongs to another text
    cuts[first] = True
    return np.flatnonzero(cuts)


@dataclass
class Known:
    """Pieces by hash, in order: where their bytes and ids lie."""

    keys: np.ndarray
    at: np.ndarray
    size: np.ndarray
    id_at: np.ndarray
    n_ids: np.ndarray
    text: np.ndarray
    ids: np.ndarray

    @staticmethod
    def nothing(kind: np.dtype) -> Known:
        none = np.zeros(0, np.int64)
        return Known(none.view(np.uint64), none, none.astype(np.int32), none, none.astype(np.int32), np.zeros(0, np.uint8), np.zeros(0, kind))

    def find(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pieces (of data) it has, and their places."""
        place = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(place < len(self.keys))
        hit = hit[(self.keys[place[hit]] == keys[hit]) & (self.size[place[hit]] == size[hit])]
        if len(hit):
            same = ragged(self.text, self.at[place[hit]], self.size[place[hit]]) == ragged(data, start[hit], size[hit])
            hit = hit[np.logical_and.reduceat(same, np.cumsum(size[hit]) - size[hit])]
        return hit, place[hit]

    def with_more(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, id_at: np.ndarray, n_ids: np.ndarray) -> Known:
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        both = lambda a, b: np.concatenate([a, b.astype(a.dtype)])[order]
        at, id_at = len(self.text) + np.cumsum(size) - size, len(self.ids) + id_at
        return Known(keys[order], both(self.at, at), both(self.size, size), both(self.id_at, id_at), both(self.n_ids, n_ids), np.concatenate([self.text, ragged(data, start, size)]), np.concatenate([self.ids, ids]))


class PieceTable:
    """Encodes texts by pieces. encode gives the ids (little-endian integers of the kind) of each of some distinct pieces; at least `remembered` of the last pieces are kept, at most twice as many."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kind: np.dtype, remembered: int):
        self.encode, self.kind, self.remembered = encode, kind, remembered
        self.known = self.older = Known.nothing(kind)

    def _ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after another, and each one's number of ids."""
        hashes = word_hashes(data, start, start + size)
        keys, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        at, n = start[first], size[first]
        id_at, n_ids = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        hit, place = self.known.find(keys, data, at, n)
        id_at[hit], n_ids[hit] = self.known.id_at[place], self.known.n_ids[place]
        new = np.ones(len(keys), bool)
        new[hit] = False
        new = np.flatnonzero(new)
        again, place = self.older.find(keys[new], data, at[new], n[new])
        n_ids[new[again]] = self.older.n_ids[place]
        fresh = np.ones(len(new), bool)
        fresh[again] = False
        got = []
        for part in np.split(new[fresh], range(ENCODED, int(fresh.sum()), ENCODED)):
            coded = self.encode([data[a:b].tobytes().decode() for a, b in zip(at[part].tolist(), (at + n)[part].tolist(), strict=True)]) if len(part) else []
            n_ids[part] = [len(x) // self.kind.itemsize for x in coded]
            got.append(b"".join(coded))
        # Ids of what is new to the younger table: those of the older one, and the fresh ones.
        more = n_ids[new]
        ends = np.cumsum(more)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, self.kind)
        from_older = np.repeat(~fresh, more)
        ids[from_older] = ragged(self.older.ids, self.older.id_at[place], self.older.n_ids[place])
        ids[~from_older] = np.frombuffer(b"".join(got), self.kind)
        id_at[new] = len(self.known.ids) + ends - more
        self.known = self.known.with_more(keys[new], data, at[new], n[new], ids, ends - more, more)  # a key whose bytes differ (a collision) is there twice, and the second is encoded again
        out = ragged(self.known.ids, id_at[number], n_ids[number])
        if len(self.known.keys) > self.remembered:
            self.known, self.older = Known.nothing(self.kind), self.known
        return out, n_ids[number]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts between offsets (from 0), one after another, and each text's first (and the end)."""
        start = piece_starts(data, offsets)
        end = np.append(start[1:], len(data))
        parts, counts, i = [], [], 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + AT_ONCE, "right")))
            a = int(start[i])
            got, n = self._ids(data[a : int(end[j - 1])], start[i:j] - a, (end - start)[i:j])
            parts.append(got)
            counts.append(n)
            i = j
        before = np.concatenate([[0], np.cumsum(joined(counts, np.int64))])
        return joined(parts, self.kind), before[np.searchsorted(start, offsets)]
