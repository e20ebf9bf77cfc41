"""Sums of weights over shared features, of all pairs of two sets of records.

Records are packed into tiles once: the left side's as rows of features, the
right side's as an inverted index. Each tile meets every tile of the same group,
and only what is kept of a record's sums (a count, the best few) leaves the
worker: no pair moves, and nothing is left out. Work grows with the product
of both sides; what moves grows with the number of tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.sources.settled import settled

#: Records of a tile. Both tiles and one record's sums lie in a worker's memory.
TILE = 8192
#: Spark's setting for the bytes of a batch that goes to a Python worker: one pair of tiles.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
LEFT, RIGHT = "grp string, ats binary, ends binary, fs binary, ws binary", "grp string, ats binary, keys binary, starts binary, rows binary"


def _flat(table: pa.Table, column: str, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and each row's number of them."""
    lists = table.column(column).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), np.diff(lists.offsets.to_numpy())


def _left(table: pa.Table) -> pa.Table:
    (f, n), (w, _) = _flat(table, "f", np.int64), _flat(table, "w", np.float64)
    return _row(table, LEFT, table.column("at").to_numpy(), np.cumsum(n), f, w)


def _right(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    f, n = _flat(table, "f", np.int64)
    order = np.argsort(f, kind="stable")
    keys, starts = np.unique(f[order], return_index=True)
    return _row(table, RIGHT, table.column("at").to_numpy(), keys, np.append(starts, len(f)), np.repeat(np.arange(len(n), dtype=np.int32), n)[order])


def _row(table: pa.Table, schema: str, *arrays: np.ndarray) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.table([pa.array([table.column("grp")[0].as_py()], pa.string()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names)


def _tiles(rows: DataFrame, pack: Callable, schema: str, label: str) -> DataFrame:
    """Rows (grp, at, f and, left, w), packed."""
    rows = settled(rows, label)
    tiled = rows.withColumn("tile", F.pmod(F.xxhash64("at"), F.lit(1 + rows.count() // TILE)))
    packed = settled(tiled.groupBy("grp", "tile").applyInArrow(pack, schema), f"{label}-tiles")
    return packed.repartition(max(1, packed.count()))


def met(left: DataFrame, right: DataFrame, kept: Callable[[np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """(at, ...) of each left record and right tile: what kept(sums, right ats in order) makes of the sums with all records of the tile, as columns of one length.

    left: (grp, at, f, w), right: (grp, at, f); at is a long, f an array of distinct 64-bit hashes, w its weights. Only equal grp meet.
    """
    if left.sparkSession.conf.get(BATCH_SETTING, None) is None:
        left.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    l, r = _tiles(left, _left, LEFT, "left"), _tiles(right, _right, RIGHT, "right")  # noqa: E741
    r = r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns])
    # Equality in a form that is no key of a join: a group would be one task.
    both = l.crossJoin(r).filter(F.least("grp", "r_grp") == F.greatest("grp", "r_grp")).drop("grp", "r_grp")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ats, ends, fs, ws, r_ats, keys, starts, rows = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in enumerate((np.int64, np.int64, np.int64, np.float64, np.int64, np.int64, np.int64, np.int32)))
                out = list(zip(*_meet(ats, ends, fs, ws, r_ats, keys, starts, rows, kept), strict=True))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return both.mapInArrow(run, schema)


def _meet(ats, ends, fs, ws, r_ats, keys, starts, rows, kept) -> Iterator[tuple]:
    if not len(keys):
        return
    place = np.minimum(np.searchsorted(keys, fs), len(keys) - 1)
    found = keys[place] == fs
    begin = 0
    for at, end in zip(ats, ends, strict=True):
        here = found[begin:end]
        p, w = place[begin:end][here], ws[begin:end][here]
        begin = end
        if not len(p):
            continue
        a, b = starts[p], starts[p + 1]
        sums = np.bincount(np.concatenate([rows[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]), np.repeat(w, b - a), len(r_ats))
        columns = kept(sums, r_ats)
        if len(columns[0]):
            yield np.full(len(columns[0]), at), *columns
