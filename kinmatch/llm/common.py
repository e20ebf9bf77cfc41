"""What the operators of this subpackage share.

Input contract: an operator takes any DataFrame, reads an id column (cast to
long) and a text column, and never looks at other columns, so extra columns
cannot clash with its own. A null text is an empty text. A null id is replaced
inside by NO_ID, the largest long, sorts after all others and comes out as null.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os.path
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = 2**63 - 1
#: Bits of the filters that are sent to all tasks: 2 MB whatever the input's size. A full filter lets more rows through; it never loses one.
FILTER_BITS = 1 << 24
#: Text that one vectorised step takes at most (a longer document is a step of its own).
STEP_BYTES = 1 << 18
#: Spark's setting for the bytes of a batch that goes to a Python worker, and its value where the session leaves it open.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, txt) without nulls."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("txt"))


def text_key(text_col: str = "txt"):
    """A 64-bit hash of the text: with its id, it tells a row from others that share the id or have none."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


def in_batches(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches of a few MB (an executor's memory doesn't follow the texts' lengths); at a task's end the worker gives back what it has freed."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def tagged(docs: DataFrame, id_col: str, **keys: Column) -> DataFrame:
    """Each row of docs as a struct `row`, with its id (did) and other keys beside it, so that no name in docs can clash; untagged() gives docs back."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), *(v.alias(k) for k, v in keys.items()))


def untagged(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def given_id(col: str = "did"):
    return F.when(F.col(col) != NO_ID, F.col(col))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset in a local run. On a cluster it must be set."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{tempfile.gettempdir()}/checkpoints/kinmatch"
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables, by Hadoop's own file system."""
    if (jsc := spark.sparkContext._jsc) is None:
        return
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit(paths: list[str]) -> None:
    if spark := SparkSession.getActiveSession():
        clear(spark, paths)


_STORED: list[str] = []
atexit.register(_clear_at_exit, _STORED)


def new_path(spark: SparkSession, label: str) -> str:
    _STORED.append(path := f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return path


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here and lost executors cost no recomputation. The files go when the driver ends."""
    path = new_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # columns of `by` come last


def path_of(table: DataFrame) -> str:
    """The folder of a table from stored()."""
    files = table.inputFiles()
    return next((p for p in _STORED if any(f"/{os.path.basename(p)}/" in f for f in files)), "/nowhere")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of finished jobs now: it does so when the driver's garbage is collected, which may be long after. Nothing may read those jobs' DataFrames later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of each row, one after another."""
    end = np.cumsum(size)
    return flat[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - end + size, size)]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)


def bit_filter(df: DataFrame, hash_col: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of fixed size over a long column. The bits are or-ed by Spark; the driver receives bits / 64 rows at most, never a row per hash."""
    words = df.select(F.explode(F.array(*[F.pmod(F.shiftrightunsigned(F.col(hash_col), s), F.lit(bits)) for s in (0, 19, 38)])).alias("at"))
    words = words.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    rows = words.toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether bit_filter may hold each of these hashes."""
    n, found = np.uint64(len(bits) * 64), np.ones(len(hashes), bool)
    for s in (0, 19, 38):
        at = (hashes.view(np.uint64) >> np.uint64(s)) % n
        found &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def split_by(source: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """source (did, tk, txt binary) in two: rows that may have a (did, tk) of keys, and rows that have none, which need no shuffle to meet them."""
    held = source.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.xxhash64("did", "tk").alias("h")), "h"))

    def part(inside: bool) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select(["did", "tk", "txt"]).filter(pa.array(may_hold(held.value, batch.column("h").to_numpy()) == inside))

        return source.select("did", "tk", "txt", F.xxhash64("did", "tk").alias("h")).transform(in_batches, rows, "did long, tk long, txt binary")

    return part(True), part(False)
