"""Exact, line, suffix and Jaccard deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinmatch.llm import exact_dedup as ed
from kinmatch.llm.components import connected_components
from kinmatch.llm.exact_dedup import exact_dedup, keep_first
from kinmatch.llm.jaccard_join import jaccard_classes, keep_one_of_each, prefix_keys, prefix_sizes, tile_links
from kinmatch.llm.line_dedup import LEAST_BITS, TwoFilters, line_dedup
from kinmatch.llm.repeats import packed, unpacked
from kinmatch.llm.suffix_dedup import has_earlier, suffix_dedup, suffix_order
from tests.llm.cases import edited, empty, prose, rows, table

LAST = 2**63


def known(i):
    return LAST if i is None else i


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# Exact.


def test_exact_matches_brute_force(spark):
    data = rows()
    groups = defaultdict(list)
    for i, t in data:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    got = exact_dedup(table(spark, data)).collect()
    want = Counter()
    for text, ids in groups.items():
        first = min(ids, key=known)
        want.update((i, first, len(ids), sha(text)) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_on_nothing(spark):
    assert exact_dedup(empty(spark)).collect() == []
    assert keep_first(empty(spark)).collect() == []


def test_keep_first_keeps_all_columns(spark):
    docs = table(spark, rows())
    got = keep_first(docs)
    assert got.schema == docs.schema and set(map(str, got.collect())) <= set(map(str, docs.collect()))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    texts = [norm(r.text) for r in got.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {norm(t) for _, t in rows()}


def test_fingerprints_combine(monkeypatch):
    text = np.frombuffer(prose(1, 3000).encode(), np.uint8)
    whole = ed.fingerprints(text, np.array([0, len(text)]))
    monkeypatch.setattr(ed, "CHUNK", 1000)
    assert (ed.fingerprints(text, np.array([0, len(text)])) == whole).all()
    x, y = (ed.fingerprints(t, np.array([0, len(t)]))[0] for t in (text[:777], text[777:]))
    assert [ed.combine(int(a), int(b), len(text) - 777, base) for a, b, base in zip(x, y, ed.BASES, strict=True)] == whole[0].tolist()


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    """With fingerprints that all collide, the comparison of chunks still tells texts apart."""
    import kinmatch.llm.exact_dedup as m

    def rows_of(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("did"), pa.array([7] * n, pa.int64()), pa.array([1] * n, pa.int64()), pa.array([1] * n, pa.int64()), b.column("text_sha256")], ["did", *m.KEYS, "text_sha256"])

    def chunks_of(_):
        def rows_(batches):
            import pyarrow as pa

            for b in batches:
                for t in b.column("norm").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([1], pa.int64()), pa.array([1], pa.int64()), pa.array([0], pa.int32()), pa.array([t.encode()], pa.binary())], [*m.KEYS, "nth", "chunk"])

        return rows_

    monkeypatch.setattr(m, "_fingerprint_rows", rows_of)
    monkeypatch.setattr(m, "_chunk_rows", chunks_of)
    got = {r.doc_id: r.keep_id for r in m.exact_dedup(table(spark, [(1, "abc"), (2, "abd"), (3, "abc")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


# Lines.


def brute_lines(data, least, docs):
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    lower = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    key = lambda line: lower(line.strip(space))
    count, last = Counter(), {}
    for i, t in data:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] += 1
            last[k] = max(last.get(k, -1), known(i))
    out = Counter()
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and count[key(x)] >= docs and known(i) < last[key(x)])]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize(("least", "docs"), [(40, 5), (5, 2)])
def test_lines_match_brute_force(spark, least, docs):
    line = "  Überall STEHT dieselbe lange Zeile, und zwar hier. "
    data = rows() + [(100 + i, f"{prose(i, 10)}\n{line}\n{line.lower() if i % 2 else line}\nend") for i in range(8)]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(table(spark, data), least_chars=least, least_docs=docs).collect())
    assert got == brute_lines(data, least, docs)
    assert line_dedup(empty(spark)).collect() == []


def test_two_filters_lose_no_repeat():
    r = np.random.default_rng(0)
    hashes = r.integers(0, 2**63, 500, dtype=np.uint64)
    f = TwoFilters(LEAST_BITS // 256)
    f.add(hashes, np.zeros(500, bool))
    f.add(hashes[:100], np.zeros(100, bool))
    from kinmatch.llm.line_dedup import positions

    found = f.twice[positions(hashes, f.bits)].all(axis=0)
    assert found[:100].all() and found[100:].mean() < 0.2


def test_line_of_all_documents(spark):
    line = "a line of more than forty characters that all documents hold"
    data = [(i, f"{line}\nown {i}") for i in range(300)]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(table(spark, data)).collect())
    assert got == brute_lines(data, 40, 5)


# Suffixes.


def brute_suffixes(data, least=50):
    data = [(i, (t or "").encode()) for i, t in data]
    first = {}
    for i, t in data:
        for k in range(len(t) - least + 1):
            g = t[k : k + least]
            first[g] = min(first.get(g, LAST), known(i))
    out = Counter()
    for i, t in data:
        gone = bytearray(len(t) + 1)
        for k in range(len(t) - least + 1):
            if first[t[k : k + least]] < known(i):
                gone[k : k + least] = b"\1" * least
        spans = sum(1 for k in range(len(t)) if gone[k] and not gone[k + 1])
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out[i, len(t), len(t) - len(kept), spans, sha(kept)] += 1
    return out


def test_suffixes_match_brute_force(spark):
    data = rows() + [(200 + i, "ab" * (30 + i)) for i in range(3)] + [(210, "z" * 49), (211, "z" * 50), (212, "z" * 300)]
    got = suffix_dedup(table(spark, data)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute_suffixes(data)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert suffix_dedup(empty(spark)).collect() == []


def test_texts_in_pieces_give_the_same(spark, monkeypatch):
    import kinmatch.llm.suffix_dedup as m

    data = [(1, prose(5, 3000)), (2, "x" + prose(5, 3000)[3000:9000]), (3, prose(6, 50))]
    want = brute_suffixes(data)
    monkeypatch.setattr(m, "PIECE", 1000)
    monkeypatch.setattr(m, "STEP", 500)
    assert list(m.parts(__import__("pyarrow").array([b"a" * 2100]), 50))  # pieces are made
    got = m.suffix_dedup(table(spark, data)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("least", [50, 64])
def test_repeats_over_the_cut_of_a_long_text(spark, monkeypatch, least):
    import kinmatch.llm.suffix_dedup as m

    monkeypatch.setattr(m, "PIECE", 2000)
    monkeypatch.setattr(m, "STEP", 500)
    long = prose(11, 900)
    data = [(1, long)] + [(2 + k, f"{k} {long[2000 * 1 - 30 - k : 2000 - 30 - k + least]} tail {k}") for k in range(4)]
    got = m.suffix_dedup(table(spark, data), least=least).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute_suffixes(data, least)
    assert all(r.n_removed >= least for r in got if r.doc_id > 1)


@pytest.mark.parametrize("keys", [200, 1])
def test_windows_of_frequent_anchors(spark, monkeypatch, keys):
    import kinmatch.llm.suffix_dedup as m

    monkeypatch.setattr(m, "HOT_RUNS", 3)
    monkeypatch.setattr(m, "HOT_KEYS", keys)
    passage = prose(12, 30)
    data = [(i, f"{prose(500 + i, 12)} {passage} {prose(600 + i, 12)}") for i in range(20)] + rows()
    got = m.suffix_dedup(table(spark, data)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute_suffixes(data)


def test_repeats_beyond_a_segments_memory(monkeypatch):
    import kinmatch.llm.repeats as m

    monkeypatch.setattr(m, "HELD_KEYS", 100)
    monkeypatch.setattr(m, "ONCE_BITS", 1 << 14)
    r = np.random.default_rng(5)
    segment, keys = m.Segment(1 << 14), r.integers(0, 2**63, 1000, dtype=np.uint64)
    for k in range(0, 1000, 50):
        segment.add(np.sort(keys[k : k + 50]), np.zeros(50, bool))
    segment.add(np.sort(keys[:60]), np.zeros(60, bool))  # seen before
    segment.add(np.sort(keys[500:520]), np.ones(20, bool))  # known to repeat
    held = np.frombuffer(segment.held(), np.uint8)[None, :]
    monkeypatch.setattr(m, "segment_of", lambda keys, segments: np.zeros(len(keys), np.int64))
    found = m.suspected(held, keys)
    assert found[:60].all() and found[500:520].all() and found.mean() < 0.3


def test_segments_follow_the_input():
    from kinmatch.llm.repeats import layout, segment_lists, segment_of

    assert layout(0, 1 << 29)[0] == 256 and layout(1 << 50, 1 << 29) == (4096, (1 << 29) // 4096)
    keys = np.sort(np.random.default_rng(6).integers(0, 2**64, 5000, dtype=np.uint64))
    for segments in (256, 4096):
        lists = segment_lists(keys, np.zeros(5000, bool), segments)
        assert (np.concatenate([unpacked(x) for x in lists.column("keys").to_pylist()]) == keys).all()
        assert (np.diff(segment_of(keys, segments)) >= 0).all() and segment_of(keys, segments).max() < segments


def test_bytes_of_units_go_before_runs_meet(spark, monkeypatch):
    """What lies on disk while runs meet are the runs and the units' places."""
    import kinmatch.llm.suffix_dedup as m

    seen, stored, clear = [], m.stored, m.clear
    monkeypatch.setattr(m, "stored", lambda df, label: (seen.append(label), stored(df, label))[1])
    monkeypatch.setattr(m, "clear", lambda spark, paths: (seen.extend("no " + p.rsplit("/", 1)[1][:-33] for p in paths), clear(spark, paths)))
    m.suffix_dedup(table(spark, rows())).collect()
    assert seen.index("no repeat-units") < seen.index("repeat-runs") < seen.index("repeat-windows")


def test_groups_over_batches_and_parts(monkeypatch):
    """Anchors whose rows lie in several batches, sorted in parts of any size and by either packing of ranks."""
    import pyarrow as pa

    import kinmatch.llm.suffix_dedup as m

    keys = [0] * 3 + [1] * 31 + [2] + [3] * 25
    texts = [prose(10 * x + k % 4, 40).encode()[k % 7 : 120 + k % 5] for k, x in enumerate(keys)]
    did = [k - keys.index(x) for k, x in enumerate(keys)]
    unit = [b"%d" % k for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(unit), pa.array(did, pa.int64()), pa.array([5] * 60, pa.int32()), pa.array(texts)], ["key", "unit", "did", "at", "bytes"])
    want = {(unit[k], 5 + i) for k, t in enumerate(texts) for i in range(len(t) - 49) if any(t[i : i + 50] in texts[j] for j in range(k) if keys[j] == keys[k])}
    for rows_, size, three in ((60, 1 << 17, 1 << 21), (7, 1 << 17, 0), (1, 1, 1 << 21), (9, 500, 1 << 21)):
        monkeypatch.setattr(m, "SORT_BYTES", size)
        monkeypatch.setattr(m, "THREE_RANKS", three)
        got = [r for b in m._sorted_rows(50)(iter([batch.slice(0, 0), *(batch.slice(i, rows_) for i in range(0, 60, rows_))])) for r in b.to_pylist()]
        assert sorted((r["unit"], r["at"] + i) for r in got for i in range(r["n"])) == sorted(want) and want


def test_suffix_order_and_factors():
    text = b"banana bandana banana"
    starts = np.arange(len(text) - 20 + 1)
    order, same = suffix_order(np.frombuffer(text * 3, np.uint8), 21, np.arange(43))
    data = text * 3
    assert order.tolist() == sorted(range(43), key=lambda k: (data[k : k + 21], k)) and len(starts)
    assert same.tolist() == [False] + [data[a : a + 21] == data[b : b + 21] for a, b in zip(order[1:], order[:-1], strict=True)]
    ids, stretch = np.array([5, 3, 3, 9, 1, 1]), np.array([False, True, True, True, False, True])
    assert has_earlier(ids, stretch).tolist() == [True, False, False, True, False, False]


def test_packing_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (unpacked(packed(x)) == x).all() and len(unpacked(packed(x[:0]))) == 0


# Jaccard.


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(data, n, percent):
    sets = [shingles(t, n) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = data[i][0] == data[j][0]
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) or same_id:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        least[find(i)] = min(least.get(find(i), LAST), known(d))
    return Counter((d, len(s), None if least[find(i)] == LAST else least[find(i)]) for i, ((d, _), s) in enumerate(zip(data, sets, strict=True)))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_classes_match_brute_force(spark, n, percent):
    chain = [prose(300, 150)]
    for k in range(12):
        chain.append(edited(chain[-1], k, 1))
    data = [(i, t) for i, t in rows() if i is not None] + [(300 + i, t) for i, t in enumerate(chain)] + [(400 + i, " ".join("abcdefghij"[: 2 + i % 9])) for i in range(20)] + [(500 + i, edited(prose(7, 60), i, i % 7)) for i in range(30)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(table(spark, data), n=n, percent=percent).collect())
    assert got == brute_classes(data, n, percent)


def test_large_classes_in_tiles(spark, monkeypatch):
    import kinmatch.llm.jaccard_join as m

    monkeypatch.setattr(m, "TILE", 300)
    data = [(i, edited(prose(8, 100), i, i % 5)) for i in range(60)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in m.jaccard_classes(table(spark, data)).collect())
    assert got == brute_classes(data, 3, 90)


def test_jaccard_without_ids_and_on_nothing(spark):
    data = [(None, "a b c d"), (5, "a b c d"), (None, None), (6, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(table(spark, data)).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (None, 0, 5), (6, 0, 6)], key=str)
    assert jaccard_classes(empty(spark)).collect() == []


def test_keep_one_of_each(spark):
    data = [(i, t) for i, t in rows() if i not in (None, 62)]
    docs = table(spark, data)
    kept = keep_one_of_each(docs)
    want = {c for _, _, c in brute_classes(data, 5, 80)}
    assert kept.schema == docs.schema and set(map(str, kept.collect())) <= set(map(str, docs.collect())) and {r.doc_id for r in kept.collect()} == want
    assert keep_one_of_each(empty(spark)).collect() == []


def test_links_beside_rows_without_ids(spark):
    base = [prose(900 + i, 40 + 15 * i) for i in range(24)]
    data = [(2 * i, t) for i, t in enumerate(base)] + [(2 * i + 1, edited(t, i, 1)) for i, t in enumerate(base)]
    data += [(None, f"{base[i]} {base[i + 1]}") for i in range(23)]  # in one candidate class with all, linked with none
    data += [(90, edited(base[20], 5, 1)), (90, prose(60, 100)), (91, base[7]), (91, base[7])]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(table(spark, data)).collect())
    assert got == brute_classes(data, 3, 90)


def test_keep_one_of_each_judges_rows(spark):
    far = [prose(70 + i, 80) for i in range(4)]
    near = prose(80, 200)
    data = [(1, near), (None, edited(near, 1, 1)), (None, far[0]), (None, far[1]), (7, edited(near, 2, 1)), (7, far[2]), (8, far[3]), (8, far[3])]
    data += [(None, edited(prose(81, 200), 1, 1)), (None, edited(prose(81, 200), 2, 1))]  # no ids at all: one of the two
    kept = Counter((r.doc_id, r.text) for r in keep_one_of_each(table(spark, data)).collect())
    assert sum(kept[x] for x in data[-2:]) == 1
    assert kept - Counter(data[-2:]) == Counter([data[0], data[2], data[3], data[5], data[6], data[7]])


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 120))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(r.integers(0, max(1, int(n * (1 - percent / 100))) + 1))
        b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, int(r.integers(0, 3)), dtype=np.uint64)]))
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if len(b) and 100 * both >= percent * union:
            grams, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            alarm = r.random(2**8) < 0.1  # some elements that don't repeat seem to, alike in all sets
            repeated = np.isin(grams, np.intersect1d(a, b)) | alarm[(grams % np.uint64(256)).astype(int)]
            owner, key = prefix_keys(grams, at, repeated, percent)
            assert set(key[owner == 0]) & set(key[owner == 1])
    assert prefix_sizes(np.array([0, 1, 9, 10, 11, 100]), 90).tolist() == [0, 1, 1, 2, 2, 11]


def test_tile_links_span_the_true_classes():
    r = np.random.default_rng(4)
    base = np.sort(r.integers(0, 2**63, 80, dtype=np.uint64))
    sets = sorted([np.sort(np.concatenate([base[k:], r.integers(0, 2**63, k, dtype=np.uint64)])) for k in (0, 1, 2, 3, 8, 30)] + [base[:10], base[:11]], key=len)
    found = tile_links(sets, np.zeros(len(sets), int), 90)
    for i, j, n in found:
        both = len(np.intersect1d(sets[i], sets[j]))
        assert n == both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both)
    root = list(range(len(sets)))
    for i, j, _ in found:
        a, b = root[i], root[j]
        root = [a if x == b else x for x in root]
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                assert root[i] == root[j]


def test_all_links_match_brute_force(spark):
    from kinmatch.llm.jaccard_join import jaccard_links

    data = [(i, edited(prose(8, 60), i, i % 4)) for i in range(40)] + [(100 + i, prose(8, 60)) for i in range(3)] + [(200, None), (201, "")]
    links, members = jaccard_links(table(spark, data))
    sets = {i: frozenset(shingles(t, 3)) for i, t in data}
    head = {}
    for i, s in sorted(sets.items()):
        head.setdefault(s, i)
    near = lambda a, b: a and b and 100 * len(a & b) >= 90 * len(a | b)
    want = {(min(head[a], head[b]), max(head[a], head[b]), len(a & b)) for a in head for b in head if a != b and near(a, b)}
    assert {(min(r.a, r.b), max(r.a, r.b), r.overlap) for r in links.collect()} == want and links.count() == len(want) > 5
    got = {r.doc_id: (r.n_shingles, r.n_links) for r in members.collect()}
    assert got == {i: (len(s), sum(j != i and bool(near(s, t)) for j, t in sets.items())) for i, s in sets.items()}


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement, whose polynomial hashes modulo 2^64 are equal whatever the base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r.component_id for r in jaccard_classes(table(spark, [(1, one), (2, other), (3, one.upper())])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(50, 60), (60, 55), (70, 70)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 55: 50, 60: 50}
