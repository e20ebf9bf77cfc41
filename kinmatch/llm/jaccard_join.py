"""N-gram Jaccard join of all documents, and the classes that its links make.

A set of word n-grams is held as sorted 64-bit hashes. Candidates come from a
prefix filter: with all elements in one order, two sets of similarity t share
one among the first |set| - ceil(t |set|) + 1 of each. Elements of one document
alone come first in that order and need no key, as they are shared with none; so
a document that is not mostly made of others' n-grams sends nothing. Which
elements repeat is told by a bit filter of a bounded size (false alarms cost
keys, never links), made from sorted, delta-coded hash lists. Sets that share a
key are gathered into candidate classes (a superset of the true ones).
Each class, in order of size, is cut into tiles; a pair of tiles whose size
bands can hold links at all is one piece of work. In it, bitmap signatures of
hashed elements bound each overlap from above by bit counts, what is left is
intersected exactly, and pairs that are connected already are skipped. Equal
sets are one set from the start, so copies never meet as pairs. A row is known by
its id and a hash of its text, as ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import given_id, in_batches, joined, mixed, plain, release, split_by, steps, stored, tagged, text_key, untagged, utf8
from kinmatch.llm.components import connected_components
from kinmatch.llm.repeats import LISTS, layout, repeats, segment_lists, suspected
from kinmatch.llm.words import NONSPACE, words

#: The filter over repeated elements is at most 32 MB.
MOST_BITS = 1 << 28
#: Elements that are sorted at once, and keys that go on at once.
LIST_SIZE, KEYS_SIZE = 1 << 21, 1 << 20
#: Elements of the sets of one tile, at most (unless a single set has more).
TILE = 1 << 18
#: Bits of signatures that are made at a time.
SIGNATURE_BITS = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted, in one array, and its n + 1 offsets. A text with fewer words, but not none, has one n-gram."""
    _, _, hashes, doc = words(data, offsets, NONSPACE)
    docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=docs)
    first = np.cumsum(counts) - counts
    grams, size = np.zeros(len(hashes), np.uint64), np.minimum(counts, n)[doc]
    nth = np.arange(len(hashes)) - first[doc]
    for k in range(n):
        at = np.minimum(np.arange(len(hashes)) + k, max(0, len(hashes) - 1))
        grams = np.where(k < size, mixed(grams * np.uint64(3) + hashes[at] + np.uint64(k + 1)), grams)
    whole = nth <= np.maximum(counts[doc] - n, 0)
    doc, grams = doc[whole], grams[whole]
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=docs))])


def prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many first elements of a set must hold one of any set that it links with."""
    return np.where(sizes > 0, sizes + (-percent * sizes) // 100 + 1, 0)


def prefix_keys(grams: np.ndarray, at: np.ndarray, repeated: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, element) rows: each set's first elements, those that don't repeat before the others, but only the repeated ones."""
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    before = np.concatenate([[0], np.cumsum(repeated)])
    own = before[at[1:]] - before[at[:-1]]
    wanted = prefix_sizes(sizes, percent) - (sizes - own)
    kept = repeated & (before[:-1] - before[at[:-1]][owner] < wanted[owner])
    return owner[kept], grams[kept]


def set_names(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that name a set."""
    pad = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    a, b = pad(mixed(grams ^ np.uint64(0x1234567))), pad(mixed(grams + np.uint64(0x9E3779B9)) | np.uint64(1))
    return mixed(a[at[1:]] - a[at[:-1]]).view(np.int64), mixed(b[at[1:]] - b[at[:-1]]).view(np.int64)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first document, and the sets, a step at a time."""
    data, offsets = utf8(batch.column("txt"))
    for i, j in steps(offsets):
        yield i, *shingle_sets(data, offsets[i : j + 1], n)


def _name_rows(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [], []
            for _, grams, at in _sets(batch, n):
                sizes.append(np.diff(at))
                names.append(set_names(grams, at))
            a, b = (joined([x[k] for x in names], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("tk"), pa.array(a), pa.array(b), pa.array(joined(sizes, np.int64))], ["did", "tk", "a", "b", "n"])

    return rows


def _element_rows(n: int, segments: int):
    """Sorted lists of the elements of some documents (LIST_SIZE elements), with whether two of these have them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            key, count = np.unique(joined(lists, np.uint64), return_counts=True)
            lists.clear()
            return segment_lists(key, count > 1, segments)

        for batch in batches:
            for _, grams, _ in _sets(batch, n):
                lists.append(grams)
                if sum(map(len, lists)) >= LIST_SIZE:
                    yield out()
        if lists:
            yield out()

    return rows


def repeated_elements(source: DataFrame, n: int) -> Broadcast:
    """A filter over the elements of two documents or more."""
    segments, bits = layout(source.agg(F.sum(F.octet_length("txt"))).first()[0] or 0, MOST_BITS)
    return repeats(source.select("txt").transform(in_batches, _element_rows(n, segments), LISTS), segments, bits, "element-filter")


def _key_rows(n: int, percent: int, held: np.ndarray):
    """(key, tk): each key once in KEYS_SIZE, with the smallest of its texts' hashes; the others are tied to that one by keys of their own."""

    def out(owners: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        owner, key = joined(owners, np.int64), joined(keys, np.uint64)
        order = np.lexsort((owner, key))
        owner, key = owner[order], key[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        pivot = owner[first][np.cumsum(first) - 1] if len(key) else owner
        ties = np.unique(np.stack([owner, pivot], axis=1)[owner != pivot], axis=0)
        tie = mixed(mixed(ties[:, 0].astype(np.uint64)) + ties[:, 1].astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[first], tie, tie]).view(np.int64)), pa.array(np.concatenate([owner[first], ties[:, 0], ties[:, 1]]))], ["key", "tk"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, keys = [], []
        for batch in batches:
            tks = batch.column("tk").to_numpy()
            for i, grams, at in _sets(batch, n):
                owner, key = prefix_keys(grams, at, suspected(held, grams), percent)
                owners.append(tks[owner + i])
                keys.append(key)
            if sum(map(len, keys)) >= KEYS_SIZE:
                yield out(owners, keys)
                owners, keys = [], []
        if keys:
            yield out(owners, keys)

    return rows


class Links:
    """Union-find over places 0 .. n - 1."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def union(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        self.root[j] = i

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap a set: bit h mod (bits) for each hash. About eight bits an element, 64 to 32,768."""
    bits = min(1 << 15, max(64, 1 << (4 * max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), bits // 64), np.uint64)
    step = max(1, SIGNATURE_BITS // bits)
    for a in range(0, len(sets), step):
        part = np.zeros((min(step, len(sets) - a), bits), bool)
        for k, s in enumerate(sets[a : a + step]):
            part[k, (s % np.uint64(bits)).astype(np.int64)] = True
        out[a : a + step] = np.packbits(part, axis=1).view(np.uint64)
    return out


def tile_links(sets: list[np.ndarray], side: np.ndarray, percent: int, forest: bool = True) -> list[tuple[int, int, int]]:
    """Links among sets in ascending size, each with its overlap: all of them, or a spanning forest. side: 0 or 1, and with both present only pairs across count."""
    sizes = np.array([len(s) for s in sets])
    bitmaps, links, out = signatures(sets), Links(len(sets)), []
    two = bool(side.any()) and not side.all()
    marked = np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
    for i in range(len(sets)):
        stop = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        later = np.arange(i + 1, stop)
        if two:
            later = later[side[later] != side[i]]
        if forest and len(later):
            later = later[links.roots()[later] != links.find(i)]
        if not len(later):
            continue
        # An element of i whose bit the other lacks is not shared; each such bit stands for one at least.
        shared = np.bitwise_count(bitmaps[later] & bitmaps[i]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(sizes[i] - (marked[i] - shared), sizes[later] - (marked[later] - shared))
        later = later[(100 + percent) * bound >= percent * (sizes[i] + sizes[later])]
        for j in later.tolist():
            if forest and links.find(i) == links.find(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                links.union(i, j)
                out.append((i, j, both))
    return out


def _tile_rows(n: int, percent: int, forest: bool):
    def links(group: list[tuple]) -> pa.RecordBatch:
        group.sort(key=lambda r: (r[4], r[1], r[2]))
        texts = [r[5] for r in group]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        sets: list[np.ndarray] = []
        for i, j in steps(offsets):
            grams, at = shingle_sets(data, offsets[i : j + 1], n)
            sets += [grams[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        found = tile_links(sets, np.array([r[3] for r in group]), percent, forest)
        columns = [[group[pair[end]][c] for pair in found] for c in (1, 2) for end in (0, 1)] + [[pair[2] for pair in found]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b", "ta", "tb", "both"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        seen: set[tuple] = set()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("work", "did", "tk", "side", "n", "txt")), strict=True):
                if group and row[0] != group[0][0]:
                    yield links(group)
                    group, seen = [], set()
                if row[1:4] not in seen:  # a repeated row is one here
                    seen.add(row[1:4])
                    group.append(row)
        if group:
            yield links(group)

    return rows


def _set_links(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, forest: bool = True) -> tuple[DataFrame, DataFrame]:
    """The set of each row (did, tk, a, b, n), and links that join the rows of each class: the ids (a, b) and text hashes (ta, tb) of two rows, and the overlap of their sets (null where these are equal)."""
    spark = docs.sparkSession
    source = plain(docs, id_col, text_col).withColumn("tk", text_key())
    sets = stored(source.transform(in_batches, _name_rows(n), "did long, tk long, a long, b long, n long"), "shingle-sets")
    sent = repeated_elements(source, n)
    parts = source.transform(in_batches, lambda batches: _key_rows(n, percent, sent.value)(batches), "key long, tk long")
    first = F.first("tk").over(Window.partitionBy("key").orderBy("tk").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    across = parts.withColumn("pivot", first).filter("tk <> pivot").select(F.col("tk").alias("a"), F.col("pivot").alias("b")).distinct()
    across = stored(across, "rough-links")
    sent.destroy()
    del parts
    release(spark)
    rough = connected_components(across, "rough-classes")

    # One row stands for all with its set.
    named = sets.filter("n > 0")
    heads = named.groupBy("a", "b", "n").agg(F.min("did").alias("head"), F.min_by("tk", "did").alias("tk"))
    heads = stored(heads, "set-heads")  # a plain join of two tables, in which Spark splits a set that very many rows have
    copies = named.join(heads.withColumnRenamed("tk", "head_tk"), ["a", "b", "n"]).filter("did <> head or tk <> head_tk").select(F.col("did").alias("a"), F.col("head").alias("b"), F.col("tk").alias("ta"), F.col("head_tk").alias("tb"), F.lit(None).cast("long").alias("both"))
    members = heads.join(rough.withColumnRenamed("node", "tk"), "tk").select("head", "tk", "component", "n")
    # Tiles: stretches of a class's sets, in order of size, with about TILE elements each.
    several = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
    members = members.join(several, "component")
    order = Window.partitionBy("component").orderBy("n", "head", "tk")
    large = members.filter(F.col("total") > TILE).withColumn("tile", F.floor((F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")) / TILE).cast("int"))
    tiles = stored(members.filter(F.col("total") <= TILE).withColumn("tile", F.lit(0)).unionByName(large).select("component", "head", "tk", "n", "tile"), "tiles")
    bands = tiles.groupBy("component", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = bands.select("component", F.col("tile").alias("tile_b"), F.col("least").alias("least_b"))
    work = bands.join(other, "component").filter((F.col("tile") <= F.col("tile_b")) & (100 * F.col("most") >= percent * F.col("least_b"))).select("component", "tile", "tile_b", F.xxhash64("component", "tile", "tile_b").alias("work"))
    sides = work.select("component", "tile", "work", F.lit(0).alias("side")).unionByName(work.filter("tile <> tile_b").select("component", F.col("tile_b").alias("tile"), "work", F.lit(1).alias("side")))
    wanted = tiles.join(sides, ["component", "tile"]).select("work", F.col("head").alias("did"), "tk", "side", "n")
    texts, _ = split_by(source.withColumn("txt", F.col("txt").cast("binary")), tiles.select(F.col("head").alias("did"), "tk"))
    matched = texts.join(wanted, ["did", "tk"]).repartition("work").sortWithinPartitions("work").select("work", "did", "tk", "side", "n", "txt").transform(in_batches, _tile_rows(n, percent, forest), "a long, b long, ta long, tb long, both long")
    links = stored(matched.unionByName(copies), "links")
    del matched, texts
    release(spark)
    return sets, links


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are maximal runs of all but the space and \\t to \\r, A-Z lower-cased;
    a text's set holds its distinct n-word shingles, or the whole of a shorter
    text. Two rows link when 100 * intersection >= percent * union; empty sets
    link with nothing. component_id is the smallest id reachable (its own id
    without links). A null id is the largest of all; rows that share an id share
    their component, each with the links of all of them; an empty table gives no
    rows.
    """
    sets, links = _set_links(docs, id_col, text_col, n, percent)
    classes = connected_components(links.select("a", "b"), "classes")
    out = sets.select("did", "n").join(classes.withColumnRenamed("node", "did"), "did", "left")
    return out.withColumn("root", F.coalesce("component", "did")).select(given_id().alias("doc_id"), F.col("n").alias("n_shingles"), given_id("root").alias("component_id"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and who has each set.

    Links: a, b (ids of the rows that stand for two sets), overlap, each pair once;
    members: doc_id, n_shingles, head (the id that stands for its set) and n_links
    (how many other rows its own links with, those of equal sets included). Sets
    without elements link with nothing; a null id is the largest of all and comes
    out as null, so ids should be given and unique here; empty tables give no rows.
    """
    sets, links = _set_links(docs, id_col, text_col, n, percent, forest=False)
    size = sets.groupBy("a", "b", "n").agg(F.min("did").alias("head"), F.count("*").alias("size"))
    between = links.filter("both is not null").select("a", "b", F.col("both").alias("overlap"))
    ways = between.select(F.col("a").alias("head"), F.col("b").alias("other")).unionByName(between.select(F.col("b").alias("head"), F.col("a").alias("other")))
    named = size.filter("n > 0")
    reach = ways.join(named.select(F.col("head").alias("other"), "size"), "other").groupBy("head").agg(F.sum("size").alias("across"))
    size = named.join(reach, "head", "left").select("a", "b", "n", "head", (F.col("size") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))
    members = sets.join(size, ["a", "b", "n"], "left")
    members = members.select(given_id().alias("doc_id"), F.col("n").alias("n_shingles"), given_id("head").alias("head"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return between.select(given_id("a").alias("a"), given_id("b").alias("b"), "overlap"), members


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but for those that a class of near-duplicates holds beside its first row.

    Classes are of rows here: an id that several rows share, or that is null,
    links none of them. The first row is that of the smallest id, null the largest,
    and among rows with one id that of the smallest text hash; equal rows stay or go
    together.
    """
    sets, links = _set_links(docs, id_col, text_col, n, percent)
    classes = connected_components(links.select(F.col("ta").alias("a"), F.col("tb").alias("b")), "classes")
    linked = links.select(F.explode(F.array("ta", "tb")).alias("tk")).distinct()  # with texts that link only with their copies
    linked = linked.join(classes.withColumnRenamed("node", "tk"), "tk", "left").select("tk", F.coalesce("component", "tk").alias("component"))
    members = stored(sets.select("did", "tk").join(linked, "tk").distinct(), "class-rows")
    firsts = members.groupBy("component").agg(F.min("did").alias("first"))
    firsts = members.join(firsts, "component").filter("did = first").groupBy("component").agg(F.min("did").alias("first"), F.min("tk").alias("first_tk"))
    others = members.join(firsts, "component").filter("did <> first or tk <> first_tk").select("did", "tk")
    return untagged(tagged(docs, id_col, tk=text_key(text_col)).join(others, ["did", "tk"], "left_anti"))
