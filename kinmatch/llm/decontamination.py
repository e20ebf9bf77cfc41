"""Benchmark decontamination with an FM-index per shard of the training text.

A shard (about 1 MB of documents) becomes a sequence of word numbers, in which 0
stands for words that no benchmark item has and for the ends of texts; runs of
other words that are shorter than the shortest phrase can't hold a match and
fold into one 0. The suffix array of that sequence gives the Burrows-Wheeler
transform, held as a wavelet matrix. All phrases are searched backwards at
once; their occurrences are located by walking to sampled suffix positions, and
the words that they cover merge into spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import given_id, in_batches, mixed, plain, ragged, steps, stored, tagged, text_key, untagged, utf8
from kinmatch.llm.words import ALNUM, LOWER, words

WINDOW = 13
SHARD_BYTES = 1 << 20
SAMPLE = 8
#: Benchmark text that goes to the tasks at once (its windows take some 15 times that); a larger benchmark is searched in blocks of about this size, one pass over the documents each.
BLOCK_BYTES = 8 << 20
ROWS = "did long, tk long, n_words long, words array<int>, bytes array<int>, items array<string>"


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit plane a level and popcounts."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.planes = len(symbols), levels, []
        for level in reversed(range(levels)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            whole = np.zeros(self.n // 64 * 8 + 8, np.uint8)
            whole[: len(packed)] = packed
            plane = whole.view(np.uint64)
            before = np.zeros(len(plane) + 1, np.int64)
            np.cumsum(np.bitwise_count(plane), out=before[1:])
            self.planes.append((plane, before, self.n - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    @staticmethod
    def ones(plane: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        return before[word] + np.bitwise_count(plane[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol[k] occurs before position i[k]."""
        low = np.zeros(len(i), np.int64)
        for level, (plane, before, zeros) in zip(reversed(range(self.levels)), self.planes, strict=True):
            bit = (symbol >> level & 1).astype(bool)
            one_i, one_low = self.ones(plane, before, i), self.ones(plane, before, low)
            i, low = np.where(bit, zeros + one_i, i - one_i), np.where(bit, zeros + one_low, low - one_low)
        return i - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling. Each 0 differs from the others (in order of position), so the longest repeat is the longest run without 0."""
    n, gap = len(symbols), symbols == 0
    zeros = int(gap.sum())
    rank = np.where(gap, np.cumsum(gap) - 1, symbols.astype(np.int64) + zeros - 1)
    k = 1
    while True:
        key = rank << 32
        key[: n - k] |= rank[k:] + 1
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1 or k >= n:
            return order
        rank, k = new, 2 * k


class FMIndex:
    """Over symbols 0 .. top; a match never holds a 0, and the sequence starts with one."""

    def __init__(self, symbols: np.ndarray, top: int):
        suffixes = suffix_array(symbols)
        last = symbols[suffixes - 1]  # the sequence starts with 0, whose forerunner is never asked for
        self.matrix = WaveletMatrix(last, max(1, int(top).bit_length()))
        self.bwt = last
        counts = np.bincount(symbols, minlength=top + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        run_start = symbols[suffixes - 1] == 0  # a walk never crosses a 0
        self.sampled = (suffixes % SAMPLE == 0) | run_start
        self.where = suffixes[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of right-aligned phrases, all at once and backwards."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.matrix.n)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1]):
            live = live[(lengths[live] > j) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, -1 - j]
            low[live] = self.first[c] + self.matrix.rank(c, low[live])
            high[live] = self.first[c] + self.matrix.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked, left = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            done = self.sampled[rows[left]]
            at = left[done]
            out[at] = self.where[self.nth[rows[at]]] + walked[at]
            left = left[~done]
            c = self.bwt[rows[left]]
            rows[left] = self.first[c] + self.matrix.rank(c, rows[left])
            walked[left] += 1
        return out


@dataclass
class Phrases:
    """The distinct windows of benchmark items, as right-aligned word numbers."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place + 1
    spelling: np.ndarray  # the words' bytes, in lower case, one after another
    spelt_at: np.ndarray  # where each word's start, and the end
    windows: np.ndarray
    lengths: np.ndarray
    pairs: np.ndarray  # (window, item) rows, by window
    items: list[str | None]

    @staticmethod
    def of(items: list[str | None], texts: list[bytes], window: int = WINDOW) -> Phrases:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        starts, ends, hashes, item = words(data, offsets, ALNUM)
        vocabulary, place, numbers = np.unique(hashes, return_index=True, return_inverse=True)
        size = (ends - starts)[place]
        spelling = LOWER[ragged(data, starts[place], size)]
        numbers = numbers.astype(np.int32) + 1
        n_words = np.bincount(item, minlength=len(texts))
        n_windows = np.where(n_words > 0, np.maximum(n_words - window + 1, 1), 0)
        of_item = np.repeat(np.arange(len(texts)), n_windows)
        start = ragged(np.arange(len(numbers)), np.cumsum(n_words) - n_words, n_windows)
        length = np.minimum(n_words, window)[of_item]
        table, name = np.zeros((len(start), window), np.int32), np.zeros(len(start), np.uint64)
        for k in range(window):  # from the last word backwards
            has = length > k
            table[has, window - 1 - k] = numbers[(start + length - 1 - k)[has]]
            name = mixed(name * np.uint64(3) + table[:, window - 1 - k].astype(np.uint64) + np.uint64(1))
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        if any(not np.array_equal(table[first, k][which], table[:, k]) for k in range(window)):  # equal names of different windows
            _, first, which = np.unique(table, axis=0, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), of_item], axis=1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        return Phrases(vocabulary, spelling, np.concatenate([[0], np.cumsum(size)]), table[first], length[first], pairs, items)


def shard_hits(phrases: Phrases, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts between offsets: each word's text number, start and end; (text, window) pairs that occur; whether each word is hit."""
    starts, ends, hashes, doc = words(data, offsets, ALNUM)
    hit, none = np.zeros(len(starts), bool), np.zeros((0, 2), np.int64)
    if not len(starts) or not len(phrases.lengths):
        return doc, starts, ends, none, hit
    place = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    number = np.where(phrases.vocabulary[place] == hashes, place + 1, 0)
    known, size = np.flatnonzero(number), ends - starts
    known = known[np.diff(phrases.spelt_at)[place[known]] == size[known]]
    if len(known):  # a word's hash tells its number, its bytes confirm it
        same = LOWER[ragged(data, starts[known], size[known])] == ragged(phrases.spelling, phrases.spelt_at[place[known]], size[known])
        known = known[np.logical_and.reduceat(same, np.cumsum(size[known]) - size[known])]
    number = np.zeros_like(number)
    number[known] = place[known] + 1
    # Runs of known words within a text, each after one 0.
    breaks = (number == 0) | np.concatenate([[True], doc[1:] != doc[:-1]])
    run = np.cumsum(breaks)
    known = number > 0
    size = np.bincount(run[known], minlength=int(run[-1]) + 1)
    kept = np.flatnonzero(known & (size[run] >= phrases.lengths.min()))
    if not len(kept):
        return doc, starts, ends, none, hit
    fresh = np.concatenate([[True], run[kept][1:] != run[kept][:-1]])
    at = np.arange(len(kept)) + np.cumsum(fresh)
    symbols = np.zeros(at[-1] + 2, np.int64)
    symbols[at] = number[kept]
    word_at = np.zeros(len(symbols), np.int64)
    word_at[at] = kept
    index = FMIndex(symbols, len(phrases.vocabulary))
    low, high = index.search(phrases.windows, phrases.lengths)
    found = np.maximum(high - low, 0)
    if not found.any():
        return doc, starts, ends, none, hit
    window = np.repeat(np.arange(len(found)), found)
    rows = np.arange(len(window)) - np.repeat(np.cumsum(found) - found, found) + low[window]
    first = word_at[index.locate(rows)]
    cover = np.bincount(first, minlength=len(starts) + 1)[: len(starts) + 1].astype(np.int64) - np.bincount(first + phrases.lengths[window], minlength=len(starts) + 1)
    hit = np.cumsum(cover)[:-1] > 0
    return doc, starts, ends, np.unique(np.stack([doc[first], window], axis=1), axis=0), hit


def _hit_rows(phrases: Phrases):
    first_pair = np.searchsorted(phrases.pairs[:, 0], np.arange(len(phrases.lengths) + 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("txt"))
            for i, j in steps(offsets, SHARD_BYTES):
                doc, starts, ends, pairs, hit = shard_hits(phrases, data, offsets[i : j + 1])
                n = j - i
                items: list[set] = [set() for _ in range(n)]
                for d, w in pairs.tolist():
                    items[d].update(phrases.items[x] for x in phrases.pairs[first_pair[w] : first_pair[w + 1], 1])
                docs_words = np.searchsorted(doc, np.arange(n + 1))
                new = hit & ~(np.concatenate([[False], hit[:-1]]) & np.concatenate([[False], doc[1:] == doc[:-1]]))
                end = hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([doc[1:] == doc[:-1], [False]]))
                a, b = np.flatnonzero(new), np.flatnonzero(end)  # first and last words of spans
                spans_of = np.searchsorted(doc[a], np.arange(n + 1))
                word_spans, byte_spans = [], []
                for d in range(n):
                    x, y = a[spans_of[d] : spans_of[d + 1]], b[spans_of[d] : spans_of[d + 1]]
                    word_spans.append(np.stack([x - docs_words[d], y + 1 - docs_words[d]], axis=1).ravel().tolist())
                    byte_spans.append((np.stack([starts[x], ends[y]], axis=1).ravel() - offsets[i + d]).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").slice(i, n), batch.column("tk").slice(i, n), pa.array(np.diff(docs_words), pa.int64()), pa.array(word_spans, pa.list_(pa.int32())), pa.array(byte_spans, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    ["did", "tk", "n_words", "words", "bytes", "items"],
                )

    return rows


def merged(flat: list[int]) -> list[int]:
    """Union of [start, end) ranges given as a flat list; ranges that touch become one."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _result_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, hits, items = [], [], []
        for flat, places, found in zip(*(batch.column(c).to_pylist() for c in ("words", "bytes", "items")), strict=True):
            ranges = merged(flat)
            hits.append(sum(ranges[1::2]) - sum(ranges[::2]))
            places = merged(places)
            spans.append([{"start": a, "end": b} for a, b in zip(places[::2], places[1::2], strict=True)])
            items.append(sorted(set(found)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("did"), batch.column("tk"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array(spans, kind)],
            ["did", "tk", "n_words", "n_hit", "items", "items_sha256", "spans"],
        )


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """contamination(), with the rows' text hashes (tk) and with did for doc_id."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("txt"))
    total = items.agg(F.sum(F.octet_length("txt"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    source = plain(docs, id_col, text_col).withColumn("tk", text_key())
    found = None
    for k in range(blocks):
        got = items.filter(F.pmod(F.xxhash64("txt", "item"), F.lit(blocks)) == k).collect()  # about BLOCK_BYTES
        phrases = Phrases.of([r.item for r in got], [r.txt.encode() for r in got], window)
        phrases.pairs = phrases.pairs[[phrases.items[i] is not None for i in phrases.pairs[:, 1]]] if len(phrases.pairs) else phrases.pairs
        sent = spark.sparkContext.broadcast(phrases)
        rows = source.transform(in_batches, lambda batches, sent=sent: _hit_rows(sent.value)(batches), ROWS)
        if blocks > 1:  # one block's windows at a time
            rows = stored(rows.filter(F.size("words") > 0), "benchmark-hits")
            sent.destroy()
        found = rows if found is None else found.unionByName(rows)
    if blocks > 1:  # a repeated row counts once here; its results are the same
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.dropDuplicates().groupBy("did", "tk").agg(flat("words"), flat("bytes"), flat("items"))
        none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
        counted = source.transform(in_batches, _hit_rows(Phrases.of([], [], window)), ROWS).select("did", "tk", "n_words")
        found = counted.join(found, ["did", "tk"], "left").select("did", "tk", "n_words", none("words", "int"), none("bytes", "int"), none("items", "string"))
    out = found.transform(in_batches, _result_rows, "did long, tk long, n_words long, n_hit long, items array<string>, items_sha256 string, spans array<struct<start:int,end:int>>")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated, spans (byte ranges of hit passages, merged).

    A window is window consecutive words of an item, or the whole of a shorter
    item that has words. A word inside any occurrence of a window is hit; a
    document is contaminated when 20 * n_hit >= n_words and n_hit > 0. Null or
    wordless texts have 0 words and are clean; an item without an id hits words
    but is not listed; an empty benchmark hits nothing; an empty table gives no
    rows; repeated rows are judged one by one.
    """
    out = _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    return out.select(given_id().alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "items_sha256", "contaminated", "spans")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that contamination() doesn't find contaminated (each row by itself, also where rows share an id or have none)."""
    found = _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, window).filter("contaminated").select("did", "tk")
    return untagged(tagged(docs, id_col, tk=text_key(text_col)).join(found, ["did", "tk"], "left_anti"))
