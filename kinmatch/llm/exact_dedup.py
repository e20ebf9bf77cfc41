"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks; each chunk's polynomial hash is computed on its own
and chunks combine by shifting the left one by the right one's length:
h(xy) = h(x) * r^len(y) + h(y). Equal fingerprints (and lengths) are only
suspects: their texts are compared chunk by chunk, as a minimum and a maximum
per fingerprint and chunk number. Those aggregate before any shuffle, so a
group of copies of any size costs each task one row per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import NO_ID, bit_filter, given_id, in_batches, may_hold, mixed, plain, steps, stored, tagged, untagged, utf8

PRIME = np.uint64(2**31 - 1)
#: Four independent bases below PRIME: about 124 bits together.
BASES = (1_103_515_245, 1_664_525_011, 69_069_069, 22_695_477)
CHUNK = 1 << 16
KEYS = ["n_bytes", "fp_a", "fp_b"]


def powers(base: int, n: int = CHUNK) -> np.ndarray:
    """base^0 ... base^(n-1) modulo PRIME, by doubling."""
    out, top = np.ones(1, np.uint64), base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(top) % PRIME])
        top = top * top % int(PRIME)
    return out[:n]


_POWERS: dict[int, np.ndarray] = {}


def chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of each chunk data[start:end]; chunks follow one another, none is empty or longer than CHUNK."""
    if base not in _POWERS:
        _POWERS[base] = powers(base)
    exponent = np.repeat(ends, ends - starts) - np.arange(starts[0], ends[-1]) - 1
    terms = (data[starts[0] : ends[-1]].astype(np.uint64) + np.uint64(1)) * _POWERS[base][exponent]  # below 2^40, so 2^16 of them fit
    return np.add.reduceat(terms, starts - starts[0]) % PRIME


def combine(left: int, right: int, right_length: int, base: int) -> int:
    """The hash of a concatenation from its parts' hashes."""
    p = int(PRIME)
    return (left * pow(base, right_length, p) + right) % p


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x 4 hashes modulo PRIME of the texts between offsets; an empty text has 0."""
    sizes = np.diff(offsets)
    pieces = -(-sizes // CHUNK)
    out = np.zeros((len(sizes), len(BASES)), np.uint64)
    if not pieces.sum():
        return out
    doc = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = offsets[:-1][doc] + nth * CHUNK
    ends = np.minimum(starts + CHUNK, offsets[1:][doc])
    for k, base in enumerate(BASES):
        hashes = chunk_hashes(data, starts, ends, base)
        out[doc[nth == 0], k] = hashes[nth == 0]
        for i in np.flatnonzero(nth):
            out[doc[i], k] = combine(int(out[doc[i], k]), int(hashes[i]), int(ends[i] - starts[i]), base)
    return out


def _packed(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = lambda a, b: ((a << np.uint64(31)) | b).view(np.int64)
    return pair(prints[:, 0], prints[:, 1]), pair(prints[:, 2], prints[:, 3])


def _prints_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8(batch.column("norm"))
    prints = [fingerprints(data, offsets[i : j + 1]) for i, j in steps(offsets)]
    a, b = _packed(np.concatenate(prints) if prints else np.zeros((0, 4), np.uint64))
    return data, offsets, np.diff(offsets), a, b


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, _, sizes, a, b = _prints_of(batch)
        yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(sizes), pa.array(a), pa.array(b), batch.column("text_sha256")], ["did", *KEYS, "text_sha256"])


def key_hash(n_bytes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a.view(np.uint64)) ^ b.view(np.uint64) ^ n_bytes.view(np.uint64)).view(np.int64)


def _chunk_rows(bits: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, sizes, a, b = _prints_of(batch)
            for i in np.flatnonzero(may_hold(bits, a)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                parts = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, sizes[i])), pa.array(np.full(n, a[i])), pa.array(np.full(n, b[i])), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], [*KEYS, "nth", "chunk"])

    return rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whitespace: str = r"[\x20\x09-\x0D]+") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes (of the normalised text).

    Texts are equal when identical after replacing each run of whitespace by
    one space. The row with the smallest id of a group stays (exactly one, also
    when that id occurs in several equal rows); a null id sorts last; null and
    empty texts are one group; an empty table gives no rows.
    """
    norm = plain(docs, id_col, text_col).select("did", F.regexp_replace("txt", whitespace, " ").alias("norm"))
    rows = norm.withColumn("text_sha256", F.sha2("norm", 256)).transform(in_batches, _fingerprint_rows, "did long, n_bytes long, fp_a long, fp_b long, text_sha256 string")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    suspects = rows.groupBy(*KEYS).count().filter("count > 1 and n_bytes > 0").select(*KEYS)
    chunks = norm.transform(in_batches, _chunk_rows(bit_filter(suspects, "fp_a")), "n_bytes long, fp_a long, fp_b long, nth int, chunk binary")
    compared = chunks.groupBy(*KEYS, "nth").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    collided = compared.filter("least <> most").select(*KEYS).distinct().withColumn("collided", F.lit(True))
    collided = stored(collided, "collided")
    if collided.isEmpty():
        rows = rows.withColumn("same", F.lit(""))
    else:
        rows = rows.join(collided, KEYS, "left").withColumn("same", F.when(F.col("collided"), F.col("text_sha256")).otherwise("")).drop("collided")
    groups = rows.groupBy(*KEYS, "same").agg(F.min(F.struct("did", "row")).alias("first"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = stored(groups, "equal-texts")  # a plain join of two tables, in which Spark splits a text that very many rows have
    out = rows.join(groups, [*KEYS, "same"], "left").withColumns({"keep": F.coalesce("first.did", "did"), "size": F.coalesce("group_size", F.lit(1))})
    return out.select(given_id().alias("doc_id"), given_id("keep").alias("keep_id"), F.col("size").alias("group_size"), F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"), "text_sha256", "n_bytes")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whitespace: str = r"[\x20\x09-\x0D]+") -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps: one of each group of equal texts."""
    kept = exact_dedup(docs, id_col, text_col, whitespace).filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.col("text_sha256").alias("sha"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = tagged(docs, id_col, sha=F.sha2(F.regexp_replace(text, whitespace, " "), 256))
    # Rows with one id and equal texts are one row here.
    return untagged(named.join(kept, ["did", "sha"], "left_semi").dropDuplicates(["did", "sha"]))
