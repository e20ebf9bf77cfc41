"""Which of very many 64-bit keys occur in two documents or more: a bit filter of a bounded size.

Tasks send sorted, delta-coded lists of distinct keys, cut into segments by the
keys' first bits. A segment's lists are merged in a bounded memory: beyond it, what
has been merged goes into a filter of keys seen once. False alarms are possible,
at both filters; a repeated key is never missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from kinmatch.llm.common import in_batches, release, stored

LISTS = "segment int, keys binary, several binary"
#: Segments: a power of two that follows the input's size between these bounds, for about so many bytes of text each.
LEAST_SEGMENTS, MOST_SEGMENTS, SEGMENT_BYTES = 256, 4096, 1 << 28
#: Keys that a segment's merge holds, and the bits of its filter beyond that.
HELD_KEYS, ONCE_BITS = 1 << 21, 1 << 24
LEAST_BITS = 1 << 22


def layout(total_bytes: int, most_bits: int) -> tuple[int, int]:
    """Number of segments, and the bits of each one's filter: about 20 bits a key, most_bits in all."""
    segments = min(MOST_SEGMENTS, max(LEAST_SEGMENTS, 1 << int(total_bytes // SEGMENT_BYTES).bit_length()))
    return segments, min(most_bits, max(LEAST_BITS, 1 << int(total_bytes).bit_length())) // segments


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Sorted integers as byte planes of their differences, whose empty planes compress to nothing."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def segment_lists(keys: np.ndarray, several: np.ndarray, segments: int) -> pa.RecordBatch:
    """A row a segment of these distinct sorted keys, with whether the sender knows two documents with each."""
    cuts = np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))
    full = np.flatnonzero(np.diff(cuts))
    lists = [(packed(keys[cuts[s] : cuts[s + 1]]), np.packbits(several[cuts[s] : cuts[s + 1]]).tobytes()) for s in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([x for x, _ in lists], pa.binary()), pa.array([x for _, x in lists], pa.binary())], ["segment", "keys", "several"])


def filter_at(keys: np.ndarray, bits: int) -> np.ndarray:
    """Three positions a key inside its segment of so many bits."""
    return np.stack([((keys >> np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in (0, 17, 29)])


class Segment:
    """The repeated keys of one segment, as bits."""

    def __init__(self, bits: int):
        self.bits, self.twice, self.once = bits, np.zeros(bits, bool), None
        self.keys: list[np.ndarray] = []
        self.several: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, several: np.ndarray) -> None:
        self.keys.append(keys)
        self.several.append(several)
        self.size += len(keys)
        if self.size > HELD_KEYS:
            self.merge()
            if self.size > HELD_KEYS // 2:
                self.settle()

    def merge(self) -> None:
        keys, several = np.concatenate(self.keys), np.concatenate(self.several)
        order = np.argsort(keys, kind="stable")
        keys, several = keys[order], several[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        several = np.logical_or.reduceat(several, first) | (np.diff(np.append(first, len(keys))) > 1)
        self.keys, self.several, self.size = [keys[first]], [several], len(first)

    def settle(self) -> None:
        """Put what is merged into the filters."""
        keys, several = self.keys[0], self.several[0]
        if self.once is not None:
            several = several | self.once[filter_at(keys, ONCE_BITS)].all(axis=0)
        self.twice[filter_at(keys[several], self.bits)] = True
        self.keys, self.several, self.size = [], [], 0
        if self.once is None:
            self.once = np.zeros(ONCE_BITS, bool)
        self.once[filter_at(keys, ONCE_BITS)] = True

    def held(self) -> bytes:
        if self.size:
            self.merge()
            keys, several = self.keys[0], self.several[0]
            if self.once is not None:
                several = several | self.once[filter_at(keys, ONCE_BITS)].all(axis=0)
            self.twice[filter_at(keys[several], self.bits)] = True
        return np.packbits(self.twice, bitorder="little").tobytes()


def segment_filters(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment = None, Segment(bits)
        for batch in batches:
            for k, keys, several in zip(*(batch.column(c).to_pylist() for c in ("segment", "keys", "several")), strict=True):
                if k != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([segment.held()], pa.binary())], ["segment", "held"])
                    now, segment = k, Segment(bits)
                key = unpacked(keys)
                segment.add(key, np.unpackbits(np.frombuffer(several, np.uint8), count=len(key)).astype(bool))
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([segment.held()], pa.binary())], ["segment", "held"])

    return rows


def repeats(lists: DataFrame, segments: int, bits: int, label: str) -> Broadcast:
    """The filter over the keys of lists (LISTS) that occur twice or more, one segment a row: segments * bits in all."""
    spark = lists.sparkSession
    filters = lists.repartition(segments // 4, "segment").sortWithinPartitions("segment").transform(in_batches, segment_filters(bits), "segment int, held binary")
    held = np.zeros((segments, bits // 8), np.uint8)
    for r in stored(filters, label).toLocalIterator():  # a few files at a time
        held[r.segment] = np.frombuffer(r.held, np.uint8)
    del lists, filters
    release(spark)
    return spark.sparkContext.broadcast(held)


def suspected(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key. held: the segments' bits, one segment a row."""
    at, segment = filter_at(keys, held.shape[1] * 8), segment_of(keys, len(held))
    found = np.ones(len(keys), bool)
    for p in at:
        found &= (held[segment, p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return found
