"""Byte-level BPE encoding and decoding by a rank map.

Each word (match of the pattern) is a byte array; ranked merges are folded over
it, lowest rank first and leftmost among equals, until no neighbouring pair has
a rank. Only distinct words are folded, and a worker remembers a bounded number
of results from batch to batch and task to task. Decoding concatenates the
tokens' binary pieces.

Two engines fold the same way. `fold_words` is the fold in Spark's higher-order
functions with a literal rank map; `encode` folds all new words of a batch at
once, a merge a word and round, by array operations, as the first one is far
beyond the budget of time for a corpus (see the README). Both map documents one
by one: nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import given_id, in_batches, joined, plain, ragged, steps, trim, utf8
from kinmatch.llm.pieces import AT_ONCE, PieceTable

#: Pieces whose ids a Python worker remembers: at least so many of the last ones, at most twice as many.
REMEMBERED = 250_000
#: Ids whose decimals and bytes are joined at a time (of one text at least): places in them take tens of bytes an id.
DIGESTED = 1 << 16
#: Words longer than this fold one by one, by a heap.
LONG = 96
NO_RANK = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word, over linked parts with a heap of pairs: n log n for a word of n bytes."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is gone
    left = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or not end[j] or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            left[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if left[i] >= 0 and (r := ranks.get(word[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Merges:
    """The pairs of ids that make a token, to fold many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        table = np.array(sorted(pairs) or [(-1, 0)], np.int64)
        self.pairs, self.made = table[:, 0].copy(), table[:, 1].copy()
        self.ranks, self.of_byte = ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], NO_RANK)

    def fold(self, words: list[bytes]) -> list[bytes]:
        """The ids of each (not empty) word as little-endian 32-bit integers: in each round, every word's pair of lowest rank merges, the leftmost of equals."""
        out: list[bytes] = [b""] * len(words)
        many = []
        for k, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(w) > LONG:
                out[k] = np.array(fold_long(w, self.ranks), "<u4").tobytes()
            else:
                many.append(k)
        if not many:
            return out
        number = np.array(many)
        size = np.array([len(words[k]) for k in many])
        ids = self.of_byte[np.frombuffer(b"".join([words[k] for k in many]), np.uint8)]
        pair = np.append(self.rank(ids[:-1], ids[1:]), NO_RANK)
        pair[np.cumsum(size) - 1] = NO_RANK
        while len(number):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(pair << 32 | np.arange(len(ids)), first)
            merging = best >> 32 < NO_RANK
            if not merging.all():  # words without a pair are done
                raw, ends = ids.astype("<u4").tobytes(), (first + size) * 4
                for k in np.flatnonzero(~merging).tolist():
                    out[number[k]] = raw[4 * first[k] : ends[k]]
                live = np.repeat(merging, size)
                moved = np.cumsum(live) - 1
                at = moved[best[merging] & (2**32 - 1)]
                ids, pair, number, size, best = ids[live], pair[live], number[merging], size[merging], best[merging]
            else:
                at = best & (2**32 - 1)
            if not len(number):
                break
            ids[at] = best >> 32
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            at = at - np.arange(len(at))  # one part before each place has gone, a word
            ids, pair, size = ids[kept], pair[kept], size - 1
            end = np.cumsum(size) - 1
            pair[at] = self.rank(ids[at], ids[np.minimum(at + 1, len(ids) - 1)])
            pair[end] = NO_RANK
            before = at[at > end - size + 1] - 1
            pair[before] = self.rank(ids[before], ids[before + 1])
        return out


class Codec:
    """A rank file and a word pattern; remembers pieces."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.merges = Merges(self.ranks)
        self.words: Callable[[str], list[str]] = regex.compile(pattern).findall
        tokens = {r: t for t, r in self.ranks.items()}
        self.tokens = Strings([tokens.get(r, b"") for r in range(max(tokens) + 1)])
        self.decimals = Strings([b" %d" % r for r in range(max(tokens) + 1)])
        self.pieces = PieceTable(self.learn, np.dtype("<u4"), REMEMBERED)

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; its distinct words are folded."""
        found = list(map(self.words, pieces))
        distinct = list(set().union(*found))
        ids = dict(zip(distinct, self.merges.fold([w.encode() for w in distinct]), strict=True))
        return [b"".join([ids[w] for w in ws]) for ws in found]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's start (and the end)."""
        ids, at = self.pieces.ids(*utf8(texts))
        return ids.astype(np.int64), at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        return self.tokens.joined(ids, at)


class Strings:
    """Byte strings by number, to be joined in many rows at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Of numbers[at[k]:at[k + 1]], the strings one after another, for each k."""
        size = self.size[numbers]
        raw, cuts = ragged(self.data, self.start[numbers], size).tobytes(), np.concatenate([[0], np.cumsum(size)])[at].tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """A worker keeps its codec from task to task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _encoded_rows(path: str, pattern: str, digests: bool, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            _, offsets = utf8(batch.column("txt"))
            for i, j in steps(offsets, AT_ONCE):
                ids, at = c.ids(batch.column("txt").slice(i, j - i))
                columns, names = [batch.column("did").slice(i, j - i)], ["did"]
                if digests:
                    parts = [(ids[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in steps(at, DIGESTED)]
                    columns += [pa.array(np.diff(at)), pa.array([sha(x[1:]) for p in parts for x in c.decimals.joined(*p)], pa.string()), pa.array([sha(x) for p in parts for x in c.decode(*p)], pa.string())]
                    names += ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
            trim()  # several workers share an executor with a full heap

    return rows


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids (array<int>). Null and empty texts have no ids; an empty table gives no rows."""
    rows = plain(docs, id_col, text_col).transform(in_batches, _encoded_rows(ranks_path, pattern, digests=False, with_ids=True), "did long, ids array<int>")
    return rows.select(given_id().alias("doc_id"), "ids")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id and data (binary), the tokens' bytes one after another. Null ids are no ids; an id without a token is an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            if any(len(x) and (x.min() < 0 or x.max() >= len(c.tokens.size) or not c.tokens.size[x].all()) for x in lists):
                raise ValueError("an id without a token")
            data = c.decode(joined(lists, np.int64), np.cumsum([0, *map(len, lists)]))
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(data, pa.binary())], ["did", "data"])

    source = encoded.select(F.col(id_col).cast("long").alias("did"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.transform(in_batches, rows, "did long, data binary").select(F.col("did").alias("doc_id"), "data")


def round_trips(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """encode and decode in one map, with digests: doc_id, n_tokens, ids_sha256 (of decimal ids with single spaces between), decoded_sha256, and ids if asked for."""
    more = ", ids array<int>" * with_ids
    rows = plain(docs, id_col, text_col).transform(in_batches, _encoded_rows(ranks_path, pattern, True, with_ids), "did long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
    return rows.select(given_id().alias("doc_id"), *rows.columns[1:])


# The fold in Spark's higher-order functions.

BUCKETS = 8192


def _bucket(left, right):
    return (left * 31 + right * 7919) % BUCKETS


def rank_tables(ranks: dict[bytes, int]) -> tuple[Column, Column]:
    """The rank map as literals: by bucket, the pairs of ids that have a rank (left * 2^20 + right), and their ranks."""
    merges = Merges(ranks)
    left, right = merges.pairs >> 32, merges.pairs & (2**32 - 1)
    order = np.argsort(_bucket(left, right), kind="stable")
    cuts = np.searchsorted(_bucket(left, right)[order], np.arange(BUCKETS + 1))

    def literal(values: np.ndarray, kind: str) -> Column:
        parts = [",".join(map(str, values[order[i:j]].tolist())) or "-1" for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return F.expr("array(" + ",".join(f"cast(split('{x}', ',') as array<{kind}>)" for x in parts) + ")")  # folded to a constant once

    return literal(left << 20 | right, "bigint"), literal(merges.made, "int")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def fold_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """words with a column ids (array<int>): ranked merges folded over each (non-null) word's bytes, by expressions only. The state is the parts' ids and the ranks of neighbours."""
    pairs_of, ranks_of = rank_tables(ranks)
    none = F.array().cast("array<int>")
    of_byte = F.expr("cast(split('" + ",".join(str(ranks[bytes([b])]) for b in range(256)) + "', ',') as array<int>)")

    def rank(left: Column, right: Column) -> Column:
        def found(bucket: Column) -> Column:
            at = F.array_position(F.get(pairs_of, bucket), F.shiftleft(left.cast("bigint"), 20) + right)
            return F.when(at > 0, F.get(F.get(ranks_of, bucket), (at - 1).cast("int")))

        return _let(_bucket(left, right).cast("int"), found)

    def step(state: Column, _: Column) -> Column:
        ids, pairs = state["ids"], state["pairs"]

        def merge(least: Column) -> Column:
            def at(k: Column) -> Column:  # from 1
                left = F.when(k > 1, F.array(rank(F.get(ids, k - 2), least))).otherwise(none)
                right = F.when(k + 1 < F.size(ids), F.array(rank(least, F.get(ids, k + 1)))).otherwise(none)
                new_ids = F.concat(F.slice(ids, F.lit(1), k - 1), F.array(least), F.slice(ids, k + 2, F.size(ids)))
                new_pairs = F.concat(F.slice(pairs, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right, F.slice(pairs, k + 2, F.size(ids)))
                return F.struct(new_ids.alias("ids"), new_pairs.alias("pairs"))

            return F.when(least.isNull(), state).otherwise(_let(F.array_position(pairs, least).cast("int"), at))

        return _let(F.array_min(pairs), merge)

    text = F.col(word_col).cast("binary")
    size = F.octet_length(text)
    byte = lambda i: F.conv(F.hex(F.substring(text, i, F.lit(1))), 16, 10).cast("int")
    ids = F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.get(of_byte, byte(i)))).otherwise(none)
    start = _let(ids, lambda p: F.struct(p.alias("ids"), F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: rank(x, F.get(p, i + 1))).alias("pairs")))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), size - 1))
    return words.withColumn("ids", F.aggregate(rounds, start, step, lambda s: s["ids"]))
