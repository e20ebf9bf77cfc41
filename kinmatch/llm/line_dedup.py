"""Line deduplication with two Bloom filters.

The first filter holds the line hashes seen once, the second those seen at
least twice. Only lines in the second are suspects; only suspects are shuffled,
with their whole keys, to be counted exactly. The filters are built in
segments by hash range, so no task holds all hashes, and the second one has a
size bound (MOST_BITS) when it goes to the tasks: a full filter costs time,
never a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import given_id, in_batches, plain, split_by, stored

SPACE = b" \t\n\x0b\x0c\r"
SEGMENTS = 256
BITS_PER_LINE = 24
#: The second filter is at most 64 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
PROBES = 4


def line_key(line: bytes, least: int) -> bytes | None:
    """The line stripped and with A-Z in lower case, or None where it has fewer than least code points."""
    key = line.strip(SPACE)
    if len(key) < least or not key.isascii() and len(key.decode()) < least:
        return None
    return key.lower()


def keyed_lines(text: bytes, least: int) -> list[bytes | None]:
    return [line_key(x, least) for x in text.split(b"\n")]


def texts_of(column: pa.Array) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES x n positions inside a segment of so many bits."""
    step = (hashes >> np.uint64(24)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


class TwoFilters:
    """Once-seen and twice-seen filter of one segment."""

    def __init__(self, bits: int):
        self.once, self.twice, self.bits = np.zeros(bits, bool), np.zeros(bits, bool), bits

    def add(self, hashes: np.ndarray, repeated: np.ndarray) -> None:
        """hashes: distinct; repeated: whether the sender has seen it in two documents itself."""
        at = positions(hashes, self.bits)
        again = repeated | self.once[at].all(axis=0)
        self.twice[at[:, again]] = True
        self.once[at] = True


def _hash_rows(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_docs = [np.fromiter({xxhash.xxh3_64_intdigest(k) for k in keyed_lines(t, least) if k is not None}, np.uint64) for t in texts_of(batch.column("txt"))]
            hashes, counts = np.unique(np.concatenate(of_docs) if of_docs else np.zeros(0, np.uint64), return_counts=True)
            cuts = np.searchsorted(hashes >> np.uint64(56), np.arange(SEGMENTS + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(np.diff(cuts)[full], pa.int64()), pa.array([hashes[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary()), pa.array([(counts[cuts[s] : cuts[s + 1]] > 1).tobytes() for s in full], pa.binary())],
                ["segment", "n", "hashes", "repeated"],
            )

    return rows


def _filter_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filters = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(filters.twice, bitorder="little").tobytes()], pa.binary())], ["segment", "twice"])

        for batch in batches:
            for segment, hashes, repeated in zip(*(batch.column(c).to_pylist() for c in ("segment", "hashes", "repeated")), strict=True):
                if segment != now:
                    if filters:
                        yield out()
                    now, filters = segment, TwoFilters(bits)
                filters.add(np.frombuffer(hashes, np.uint64), np.frombuffer(repeated, bool))
        if filters:
            yield out()

    return rows


def _suspect_rows(least: int, segments: dict[int, np.ndarray], bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, keys = [], []
            for i, text in enumerate(texts_of(batch.column("txt"))):
                for k in {k for k in keyed_lines(text, least) if k is not None}:
                    doc.append(i)
                    keys.append(k)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            top, found = hashes >> np.uint64(56), np.zeros(len(keys), bool)
            for s in np.unique(top):
                if s in segments:
                    mine = np.flatnonzero(top == s)
                    at = positions(hashes[mine], bits)
                    found[mine] = (segments[s][at >> 3] >> (at & 7) & 1).all(axis=0)
            kept = np.flatnonzero(found)
            at = pa.array(np.asarray(doc, np.int64)[kept])
            yield pa.RecordBatch.from_arrays([batch.column("did").take(at), batch.column("tk").take(at), pa.array([keys[i].decode() for i in kept], pa.string())], ["did", "tk", "key"])

    return rows


def _kept_rows(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, drop in zip(texts_of(batch.column("txt")), batch.column("keys").to_pylist(), strict=True):
                lines = text.split(b"\n")
                gone = {k.encode() for k in drop or ()}
                kept = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                texts.append(b"\n".join(kept) if gone else text)
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], ["did", "n_lines", "n_dropped", "text"])

    return rows


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """One row per input row: doc_id, text (what is left), n_lines, n_dropped.

    A key of at least least_chars code points found in at least least_docs rows
    loses its lines except in the rows with the largest id that holds it (a null
    id counts as the largest). Lines of one document that share a key stay or go
    together. A null or empty text has one empty line; an empty table gives no
    rows; each repeated row counts as a document of its own.
    """
    spark = docs.sparkSession
    docs = plain(docs, id_col, text_col)
    binary = docs.select("did", F.col("txt").cast("binary").alias("txt"), F.xxhash64("txt").alias("tk"))
    hashes = stored(binary.select("txt").transform(in_batches, _hash_rows(least_chars), "segment int, n long, hashes binary, repeated binary"), "line-hashes")
    lines = hashes.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_LINE * lines).bit_length())) // SEGMENTS
    twice = hashes.repartition(SEGMENTS // 4, "segment").sortWithinPartitions("segment").transform(in_batches, _filter_rows(bits), "segment int, twice binary")
    segments = {r.segment: np.frombuffer(r.twice, np.uint8) for r in stored(twice, "line-filter").toLocalIterator()}  # MOST_BITS at most
    sent = spark.sparkContext.broadcast(segments)
    suspects = stored(binary.transform(in_batches, lambda batches: _suspect_rows(least_chars, sent.value, bits)(batches), "did long, tk long, key string"), "line-suspects")
    common = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("did").alias("last")).filter(F.col("n") >= least_docs).select("key", "last")
    common = stored(common, "common-lines")  # a plain join of two tables, in which Spark splits a line that very many documents hold
    gone = suspects.join(common, "key").filter("did < last").groupBy("did", "tk").agg(F.collect_set("key").alias("keys"))
    gone = stored(gone, "dropped-keys")
    sent.destroy()
    touched, others = split_by(binary, gone)
    touched, others = touched.join(gone, ["did", "tk"], "left").select("did", "txt", "keys"), others.select("did", "txt", F.lit(None).cast("array<string>").alias("keys"))
    out = touched.unionByName(others).transform(in_batches, _kept_rows(least_chars), "did long, n_lines long, n_dropped long, text string")
    return out.select(given_id().alias("doc_id"), "text", "n_lines", "n_dropped")
