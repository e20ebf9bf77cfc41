"""Token ids in flat binary files that can be memory-mapped.

Documents are dealt by ranges of their ids; each range becomes a shard of three
little-endian files: `.tokens` (unsigned 16-bit integers where the vocabulary
allows it, else 32-bit), `.offsets` (64-bit: where each document starts in the
shard, and its end) and `.ids` (64-bit document ids). A shard's base, the number
of ids in all shards before it, is a prefix sum over the manifest. Files get
names of their own at each attempt and only those of the manifest count, so
tasks may run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import given_id, in_batches, joined, new_path, plain, ragged, steps, stored, utf8
from kinmatch.llm.pieces import AT_ONCE, PieceTable

#: Pieces that a Python worker remembers: at least so many of the last ones, at most twice as many.
REMEMBERED = 1_000_000
#: Pieces that are encoded at a time.
PIECES = 20_000
MANIFEST = "shard int, name string, n_docs long, n_ids long"


class PieceEncoder:
    """Encodes texts with a tokenizers file; pieces it remembers are not encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.opens = np.array([names.get(i, "")[:1] in ("\u0120", "\u010a") for i in range(max(names) + 1)])  # tokens that start with a space or a line feed
        self.pieces = PieceTable(self.learn, self.kind, REMEMBERED)

    def parts(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        raw, at = ids.astype(self.kind).tobytes(), (at * self.kind.itemsize).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def each(self, pieces: list[str]) -> list[bytes]:
        """The ids of any pieces."""
        got = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return self.parts(np.array(got.ids, np.int64), np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(pieces) + 1)))

    def split(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that start with a space or a line feed and have no other white space: encoded as one text and cut before such tokens."""
        ids = np.array(self.tokenizer.encode("".join(pieces), add_special_tokens=False).ids, np.int64)
        at = np.append(np.flatnonzero(self.opens[ids]), len(ids))
        return self.parts(ids, at) if len(at) == len(pieces) + 1 and not at[0] else self.each(pieces)

    def learn(self, pieces: list[str]) -> list[bytes]:
        plain = [k for k, p in enumerate(pieces) if p[0] in " \n" and len(p) > 1 and p.split() == [p[1:]]]
        out: list[bytes] = [b""] * len(pieces)
        for places, encode in ((plain, self.split), (sorted(set(range(len(pieces))).difference(plain)), self.each)):
            for i in range(0, len(places), PIECES):
                part = places[i : i + PIECES]
                for k, raw in zip(part, encode([pieces[k] for k in part]), strict=True):
                    out[k] = raw
        return out

    def encode(self, texts: pa.Array, end: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the texts, each followed by the end id, and each one's number of ids, some texts at a time. Texts with one of the tokenizer's added tokens are encoded whole."""
        data, offsets = utf8(texts)
        for i, j in steps(offsets, AT_ONCE):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            raw = part.tobytes()
            special = {k: texts[i + k].as_py() for k in range(j - i) if any(raw.find(a, at[k], at[k + 1]) >= 0 for a in self.added)} if any(a in raw for a in self.added) else {}
            if special:
                kept = np.ones(j - i, bool)
                kept[list(special)] = False
                size = np.where(kept, np.diff(at), 0)
                part, at = ragged(part, at[:-1], size), np.concatenate([[0], np.cumsum(size)])
            ids, starts = self.pieces.ids(part, at)
            whole = {k: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind) for k, t in special.items()}
            ids = np.insert(ids, np.repeat([starts[k] for k in whole], [len(x) for x in whole.values()]).astype(np.int64), joined(list(whole.values()), self.kind)) if whole else ids
            n = np.diff(starts)
            n[list(whole)] = [len(x) for x in whole.values()]
            if end is not None:
                ids, n = np.insert(ids, np.cumsum(n), self.kind.type(end)), n + 1
            yield ids, n


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """A worker keeps its encoder from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _shard_rows(tokenizer_path: str, folder: str, end: int | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        shard, name = TaskContext.get().partitionId(), None
        ids, ends, at = [], [np.zeros(1, np.int64)], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if name is None:
                fs, root = pa.fs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                name = f"{shard:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{root}/{name}.tokens")
                enc = encoder(tokenizer_path)
            ids.append(batch.column("did").to_numpy())
            for raw, n in enc.encode(batch.column("txt"), end):
                out.write(raw.tobytes())
                ends.append(at + np.cumsum(n))
                at += len(raw)
        if name is not None:
            out.close()
            for kind, values in (("offsets", np.concatenate(ends)), ("ids", np.concatenate(ids))):
                with fs.open_output_stream(f"{root}/{name}.{kind}") as f:
                    f.write(np.asarray(values, "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([sum(map(len, ids))], pa.int64()), pa.array([at], pa.int64())], ["shard", "name", "n_docs", "n_ids"])

    return rows


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Write all documents' ids, in ascending id order (equal ids by text hash; null ids last), each followed by the end id. Returns the manifest (shard, name, n_docs, n_ids, base) and the folder, which all executors must share.

    Null and empty texts have the end id only; an empty table has an empty manifest.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")
    ordered = plain(docs, id_col, text_col).repartitionByRange("did").sortWithinPartitions("did", F.xxhash64("txt"))
    manifest = stored(ordered.transform(in_batches, _shard_rows(tokenizer_path, folder, end), MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), folder


def mapped(fs: pa.fs.FileSystem, path: str, kind: str | np.dtype) -> np.ndarray:
    """A file's integers: memory-mapped where the file system is local, else read."""
    if isinstance(fs, pa.fs.LocalFileSystem):
        if not fs.get_file_info(path).size:
            return np.zeros(0, kind)
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _document_rows(folder: str, kind: str, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                tokens, at, dids = (mapped(fs, f"{root}/{name}.{x}", k) for x, k in (("tokens", kind), ("offsets", "<i8"), ("ids", "<i8")))
                for i in range(0, len(dids), 4096):
                    j = min(i + 4096, len(dids))
                    parts = [np.asarray(tokens[a:b], "<u4") for a, b in zip(at[i:j], at[i + 1 : j + 1], strict=True)]
                    columns = [pa.array(dids[i:j]), pa.array(at[i:j] + base), pa.array(np.diff(at[i : j + 1])), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    names = ["did", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows


def read_tokens(manifest: DataFrame, folder: str, wide: bool = False, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as 32-bit integers), and ids if asked for. wide: the files hold 32-bit integers."""
    shards = manifest.repartition("name").select("name", "base")
    schema = "did long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = shards.transform(in_batches, _document_rows(folder, "<u4" if wide else "<u2", with_ids), schema)
    return rows.select(given_id().alias("doc_id"), *rows.columns[1:])


def is_wide(tokenizer_path: str) -> bool:
    return encoder(tokenizer_path).kind.itemsize == 4
