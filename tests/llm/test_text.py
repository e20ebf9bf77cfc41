"""Decontamination, quality, personal data, tokens, HTML and the pipeline."""

import hashlib
import html.parser
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import byte_bpe, pieces, pii
from kinmatch.llm import html_text as H
from kinmatch.llm.decontamination import FMIndex, WaveletMatrix, contamination, keep_clean, merged, suffix_array
from kinmatch.llm.pieces import piece_starts
from kinmatch.llm.quality import keep_good, passes, quality
from kinmatch.llm.token_files import PieceEncoder, read_tokens, write_tokens
from tests.llm.cases import empty, prose, rows, table
from tests.llm.test_dedup import brute_classes, known, sha

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")

# Decontamination.


def brute_hits(data, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = Counter()
    for i, t in data:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        out[i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def items():
    return [(1, prose(0, 40)), (2, prose(3, 20)), (3, "yellow answer"), (4, None), (5, ""), (10, prose(0, 40).upper()), (11, prose(1000, 60)), (12, "Größe 中文")]


def check_hits(spark, data, its):
    bench = spark.createDataFrame(its, "item_id long, text string")
    got = contamination(table(spark, data), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_hits(data, its)
    return got


def test_hits_match_brute_force(spark):
    check_hits(spark, rows(), items())
    check_hits(spark, rows(), [(1, prose(0, 40)), (2, prose(3, 20))])
    assert not any(r.n_hit for r in check_hits(spark, rows(), [(1, None)]))
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert contamination(empty(spark), bench).collect() == []
    assert contamination(table(spark, rows()), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    import kinmatch.llm.decontamination as m

    data = [(i, t) for i, t in rows() if i is not None]
    monkeypatch.setattr(m, "BLOCK_BYTES", 200)
    check_hits(spark, data, items())


def test_keep_clean(spark):
    docs = table(spark, rows())
    kept = keep_clean(docs, spark.createDataFrame(items()[:2], "item_id long, text string"))
    bad = {i for i, *_, c in brute_hits(rows(), items()[:2]) if c}
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows() if i not in bad)


def test_keep_clean_judges_rows(spark):
    data = [(None, prose(90, 40)), (None, prose(91, 40)), (3, prose(90, 40)), (3, prose(92, 40)), (4, prose(93, 40))]
    kept = keep_clean(table(spark, data), spark.createDataFrame([(1, prose(90, 40))], "item_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([data[1], data[3], data[4]])


def test_wavelet_ranks_and_fm_search():
    r = np.random.default_rng(0)
    s = np.concatenate([[0], r.integers(0, 7, 500)])
    m = WaveletMatrix(s, 3)
    c, i = r.integers(0, 7, 200), r.integers(0, len(s) + 1, 200)
    assert m.rank(c, i).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, i, strict=True)]
    index = FMIndex(s, 7)
    patterns = [s[k : k + n] for k, n in zip(r.integers(1, 480, 60), r.integers(1, 6, 60), strict=True)]
    patterns = [p for p in patterns if p.all()]
    width = max(map(len, patterns))
    right = np.array([np.concatenate([np.zeros(width - len(p), int), p]) for p in patterns])
    low, high = index.search(right, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(len(s) - len(p) + 1) if (s[k : k + len(p)] == p).all()]


def test_suffix_array_orders_runs():
    s = np.array([0, 2, 1, 2, 1, 0, 2, 1, 0])
    order = suffix_array(s).tolist()
    assert sorted(order) == list(range(9)) and order[:3] == [0, 5, 8] and order.index(7) < order.index(1)


def test_merged_ranges():
    assert merged([5, 9, 0, 3, 3, 4, 8, 12]) == [0, 4, 5, 12] and merged([]) == []


# Quality.


def junk(seed: int) -> str:
    return " ".join(w.upper() + "!!" for w in prose(seed, 60, lines=False).split())


def quality_tables(spark):
    data = [(i, prose(i, 80) if i % 3 else junk(i)) for i in range(240)] + [(240, None), (241, ""), (None, "no id"), (242, prose(1, 8000)), (1, prose(1, 80))]
    labels = [(i, 1 if i % 3 else 0, 0) for i in range(0, 240, 2)] + [(None, 1, 0), (3, None, None), (9999, 1, 1)]
    return data, table(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_and_holds_out(spark):
    data, docs, labels = quality_tables(spark)
    got = quality(docs, labels).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(held) > 30 and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.97
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted((str(r.doc_id), r.score) for r in quality(docs, flipped).collect()) == sorted((str(r.doc_id), r.score) for r in got), "held-out labels are not used"
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)


def test_quality_with_nothing_to_learn(spark):
    _, docs, labels = quality_tables(spark)
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality(empty(spark), labels).collect() == []


def test_forward_backward_matches_enumeration():
    from itertools import product

    unary, moves = np.array([[0.3, -1.0, 2.0]]), np.array([[0.5, -0.2], [0.1, 0.9]])
    forward, backward, total = passes(unary, np.array([3]), moves)
    scores = {p: sum(u for u, y in zip(unary[0], p, strict=True) if y) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False)) for p in product((0, 1), repeat=3)}
    z = np.log(sum(map(np.exp, scores.values())))
    assert np.isclose(total[0], z)
    for k in range(3):
        want = sum(np.exp(s - z) for p, s in scores.items() if p[k])
        assert np.isclose(np.exp(forward[0, k, 1] + backward[0, k, 1] - z), want)


# Personal data.


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute_pii(t: str) -> list[tuple]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p: re.finditer(p, t, re.A)
    out = [("email", *m.span()) for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [("ip", *m.span()) for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in find(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_match_brute_force(spark):
    r = random.Random(5)
    parts = ["a@b.co", "x.y@z", "@", ".", "-", " ", "1.2.3.4", "256.1.1.1", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "(", "12", "5", "中", "é", "\n", "4111111111111111", "--", "  ", "b.c_d@e.f", "999999999999.1.1.1"]
    data = rows() + [(1000 + i, "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))) for i in range(400)]
    data += [(2000, "1 2 3 4 5 " * 20000), (2001, "9" * 8000), (2002, "a" * 8000 + "@b.c"), (2003, "a.b@c.d " * 3000)]
    for row in pii.find_pii(table(spark, data).select("doc_id", "text")).collect():
        assert [tuple(x) for x in row.base] == brute_pii(row.text), row.text[:200]
        assert set(row.base) <= set(row.found)
    assert pii.find_pii(empty(spark)).collect() == []


def test_added_spans(spark):
    data = [(1, "please mail jane (at) example (dot) com today"), (2, "call (212) 555-0199 now, tel. 030-55-1234"), (3, "we met at noon.\nThen we left at five. It was 2019-2020, page 12-34, price 12.50"), (4, "river light at stone. Es war 19 20 21"), (5, "card 4111.1111.1111.1111 exp")]
    got = {r.doc_id: [r.text[x.s : x.e] for x in r.found if x not in r.base] for r in pii.find_pii(table(spark, data)).collect()}
    assert got[1] == ["jane (at) example (dot) com"] and "(212) 555-0199" in got[2] and got[3] == got[4] == []
    redacted = {r.doc_id: r.text for r in pii.redacted(pii.find_pii(table(spark, data + [(6, "a@b.co, 1.2.3.4")]))).collect()}
    assert redacted[1] == "please mail [email] today" and redacted[6] == "[email], [ip]" and redacted[4] == data[3][1]


def test_proposals_and_trees_on_unseen_templates(spark):
    """All templates of personal data are proposed; trees that have not seen a template still judge it, at the stated recall and precision."""
    text = F.col("text")
    for kind, pattern in pii.GENERATORS.items():
        made = pii._made(spark, kind).filter("label = 1").select("number", (F.size(pii.matches(text, pattern)) > 0).alias("found"))
        assert made.filter("not found").count() == 0, kind
    least = {"email": (0.6, 0.8), "card": (0.95, 0.95), "phone": (0.85, 0.9)}
    for kind, model in pii.models(spark).items():
        assert model.recall >= least[kind][0] and model.precision >= least[kind][1], (kind, model.recall, model.precision)


def test_main_path_is_native(spark):
    plan = pii.find_pii(table(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Tokens.

ODD = [" ", "  ", "\n", "\t", "a", "B", "é", "中", "1", "²", "Ⅷ", ".", "!", "_", "'s", "'S", "\x1c", "\x85", "\xa0", " ", "😀", "\x00", "<|endoftext|>", "ß", "̈", "the", "ing"]


def odd_texts(n: int) -> list[str]:
    r = random.Random(2)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(30))) for _ in range(n)]


def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def lists(ids, at):
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def encoded(enc, texts):
    """The ids of each text by a PieceEncoder, without an end id."""
    return [x for ids, n in enc.encode(pa.array(texts, pa.string()), None) for x in lists(ids, np.concatenate([[0], np.cumsum(n)]))]


def test_pieces_start_at_words():
    for t in odd_texts(3000):
        data = np.frombuffer(t.encode(), np.uint8)
        starts = piece_starts(data, np.array([0, len(data)]))
        assert starts[:1].tolist() == [0][: len(data)]
        for at in starts[1:].tolist():
            assert data[at] in b" \n" and not t.encode()[at + 1 :].decode()[0].isspace()


def test_bpe_equals_the_library():
    codec, ref = byte_bpe.Codec(RANKS, P.PATTERN), reference_encoding()
    r = random.Random(3)
    texts = odd_texts(5000) + ["".join(r.choice("abcé") for _ in range(3000)), "a" * 2000, "=-" * 1000, " \n" * 500, "", "x\ny\n"]
    got = codec.ids(pa.array(texts))
    assert lists(*got) == [ref.encode_ordinary(t) for t in texts]
    assert codec.decode(*got) == [t.encode() for t in texts]
    assert lists(*codec.ids(pa.array([], pa.string()))) == []


def test_bpe_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    codec, ref = byte_bpe.Codec(RANKS, P.PATTERN), reference_encoding()
    for i in range(12):
        texts = [prose(i + j, 100) for j in range(3)] * 2
        assert lists(*codec.ids(pa.array(texts))) == [ref.encode_ordinary(t) for t in texts]


def test_what_a_worker_remembers_is_small():
    """Two workers share an executor whose heap is full."""
    t = pieces.PieceTable(lambda words: [b"\0\0\0\0"] * len(words), np.dtype("<u4"), byte_bpe.REMEMBERED)
    most = 0
    for k in range(12):
        text = " ".join(str(10**7 + k * 10**5 + j) for j in range(10**5)).encode()
        t.ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        most = max(most, sum(x.nbytes for known in (t.known, t.older) for x in vars(known).values()))
    assert most < 32e6


def test_pieces_are_encoded_and_digested_in_parts(monkeypatch):
    """The strings of thousands of pieces and the places of all ids never lie in memory at once; empty batches and texts pass."""
    monkeypatch.setattr("kinmatch.llm.pieces.ENCODED", 7)
    monkeypatch.setattr(byte_bpe, "DIGESTED", 5)
    monkeypatch.setattr(byte_bpe, "_CODECS", {})
    codec, ref = byte_bpe.codec(RANKS, P.PATTERN), reference_encoding()
    most, learn = [], codec.learn
    codec.pieces.encode = lambda pieces: (most.append(len(pieces)), learn(pieces))[1]
    texts = ["", "one two three four five six seven eight nine ten eleven", "", "x", " and so on é " * 9, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["did", "txt"])
    got = [r for b in byte_bpe._encoded_rows(RANKS, P.PATTERN, True, True)(iter([batch.slice(0, 0), batch])) for r in b.to_pylist()]
    assert max(most) <= 7 < sum(most)
    for r, t in zip(got, texts, strict=True):
        ids = ref.encode_ordinary(t)
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_pieces_with_equal_hashes(monkeypatch):
    """Pieces of different bytes that share a hash across batches are told apart."""
    monkeypatch.setattr(pieces, "word_hashes", lambda data, starts, ends: (data[starts].astype(np.uint64) << np.uint64(8)) + (ends - starts).astype(np.uint64))
    codec, ref = byte_bpe.Codec(RANKS, P.PATTERN), reference_encoding()
    for t in ("ab cd", "ac ce", "ab cd", "ad cd"):
        assert lists(*codec.ids(pa.array([t]))) == [ref.encode_ordinary(t)]


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(pieces, "AT_ONCE", 100)
    codec, ref = byte_bpe.Codec(RANKS, P.PATTERN), reference_encoding()
    texts = ["", prose(1, 400), "", "x" * 500 + " " + prose(2, 30), ""]
    assert lists(*codec.ids(pa.array(texts))) == [ref.encode_ordinary(t) for t in texts]


def test_bpe_frames(spark):
    data, ref = rows(), reference_encoding()
    docs = table(spark, data)
    encoded = byte_bpe.encode(docs, RANKS, P.PATTERN)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(ref.encode_ordinary(t or ""))) for i, t in data)
    assert Counter((r.doc_id, bytes(r.data)) for r in byte_bpe.decode(encoded, RANKS, P.PATTERN).collect()) == Counter((i, (t or "").encode()) for i, t in data)
    trips = byte_bpe.round_trips(docs, RANKS, P.PATTERN).collect()
    want = Counter()
    for i, t in data:
        ids = ref.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in trips) == want
    assert byte_bpe.encode(empty(spark), RANKS, P.PATTERN).collect() == []


def test_fold_in_expressions_equals_the_other(spark):
    ranks, ref = byte_bpe.read_ranks(RANKS), reference_encoding()
    words = ["", "a", "the", " morning", "zzzzzz", "naïve", "中文", "unbelievable", " 12345", "...", "mississippi"]
    got = byte_bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
    assert {r.word: r.ids for r in got} == {w: ref.encode_ordinary(w) for w in words}


def test_pieces_equal_whole_texts():
    enc = PieceEncoder(JSON)
    texts = odd_texts(5000)
    got = encoded(enc, texts)
    assert encoded(enc, []) == []
    assert got == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    fresh, enc, end = Tokenizer.from_file(JSON), PieceEncoder(JSON), "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}a", f"a{end}", f"a  {end}{end} b", f"a\n{end}\n b", f" {end}", "<|endoftext", *odd_texts(500)]
    got = encoded(enc, texts)
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark):
    data = rows()
    enc = PieceEncoder(JSON)
    manifest, folder = write_tokens(table(spark, data), JSON)
    got = read_tokens(manifest, folder, with_ids=True).collect()
    assert len(got) == len(data)
    by_id = Counter((r.doc_id, tuple(r.ids)) for r in got)
    assert by_id == Counter((i, (*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in data)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert [known(r.doc_id) for r in sorted(got, key=lambda r: r.start)] == sorted(known(i) for i, _ in data)
    manifest, folder = write_tokens(empty(spark), JSON)
    assert manifest.collect() == [] and read_tokens(manifest, folder).collect() == []


# HTML.

LAID_OUT = {
    "<p>a<p>b<br>c <b>d</b> e": "a\n\nb\nc d e",
    "<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li>three</ul>after": "- one\n- two\n  3. x\n  4. y\n- three\n\nafter",
    "<table><tr><td>a<td>bbbb<tr><td>cccccc<td>d</table>": "a       bbbb\ncccccc  d",
    "<table><caption>Cap</caption><thead><tr><th>H1<th>H2<tbody><tr><td colspan=2>wide cell<tr><td>1<td><table><tr><td>x<td>y<tr><td>z</table></table> tail": "Cap\nH1  H2\nwide cell\n1   x  y\n    z\n\ntail",
    "<div>a<div hidden>no</div><span style='display: none'>no</span>b</div>c": "ab\nc",
    "<pre>\n a  b\n  c</pre>x": " a  b\n  c\n\nx",
    "<head><title>T</title><body>hi &amp; bye &lt;": "hi & bye <",
    "<script>if(a<b)document.write('</p>')</script>ok": "ok",
    "text < 5 and > 3": "text < 5 and > 3",
    "<dl><dt>t<dd>d1<dd>d2</dl>": "t\n  d1\n  d2",
    "</p>x<p>y</div>z": "x\n\nyz",
    "<a href='x>y'>l</a> <img alt=q>m": "l m",
    "<h1>A<h2>B": "A\n\nB",
    "": "",
    "<!-- only a comment -->": "",
    "<style>x</style><template>no</template>": "",
}


@pytest.mark.parametrize("page", LAID_OUT)
def test_layout(page):
    assert H.page_text(page) == LAID_OUT[page]


SEEN_INSIDE = {
    "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p>": "so x=2",
    "<math><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math>z": "1 2z",
    "<map name=m><p>in</p><area></map>": "in",
    "<svg><title>no</title><defs><text>no</text></defs><desc/><text>A</text><text>B</text></svg>c": "A\nB\nc",
    "<svg><title/><text>A</text></svg>": "A",
    "<svg><defs><p>out": "out",
    "<svg/><title>no</title>a<desc>b</desc>": "ab",
    "a<textarea>\nx\n y</textarea>b": "a x\n y b",
    "a<select><option>x<option selected>y</select>b": "a y b",
    "<select><optgroup disabled label=g><option>x<optgroup label=h><option>y<option>z</select>": "y",
    "<select multiple><optgroup label=g><option>x<option label=L>y</select>b": "g\nx\nL\nb",
    "<datalist><option>no</datalist>a": "a",
}


@pytest.mark.parametrize("page", SEEN_INSIDE)
def test_text_inside_other_elements_is_kept(page):
    assert H.page_text(page) == SEEN_INSIDE[page]


UNTIDY_TABLES = {
    "<table><tr><form><td>x</td></form></tr></table>": "x",
    "<table><form><tr><td>x<td>y</form><tr><td>z</table>": "x  y\nz",
    "<table><div>Hello</div><tr><td>a</table>": "Hello\n\na",
    "<table><tr><b>note</b><td>a</table>": "note\n\na",
    "<table><tr><td>a</td></tr><table><tr><td>b</td></tr></table>": "a\n\nb",
    "<table><div><table><tr><td>b</table>": "b",
    "<table><tr><td>a<div>in<td>b<tr><p>out<th>c</table>end": "out\n\na   b\nin\nc\n\nend",
    "<table><colgroup><col><i>early</i><tr><td>a</table>": "early\n\na",
    "<table>1<b>2</b>3<tbody>4<tr>5<td>6</table>7": "12345\n\n6\n\n7",
    "<table><caption>c<table><tr><td>in</table><tr><td>a</table>": "c\n\nin\na",
    "<table><input type=submit value=Go><tr><td>a</table>": "Go\n\na",
    "<table><template><tr>no<td>no</template><tr><td>a</table>": "a",
    "<tr>x": "x",
}


@pytest.mark.parametrize("page", UNTIDY_TABLES)
def test_untidy_tables_keep_their_text(page):
    assert H.page_text(page) == UNTIDY_TABLES[page]


def test_no_text_is_lost_among_table_tags():
    r = random.Random(5)
    tags = "table tr td th tbody thead caption colgroup form div b p a ul li h2 center span".split()
    for _ in range(3000):
        page, words = "", []
        for k in range(r.randrange(1, 14)):
            page += "".join(f"<{r.choice(['', '', '/'])}{r.choice(tags)}>" for _ in range(r.randrange(4))) + f" w{k}w "
            words.append(f"w{k}w")
        assert sorted(re.findall(r"w\d+w", H.page_text("<table>" + page))) == sorted(words), page


class Words(html.parser.HTMLParser):
    """Visible words in order, the plain way."""

    def __init__(self):
        super().__init__()
        self.words, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_no_visible_word_is_lost(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for p in pages:
        w = Words()
        w.feed(p.html)
        got = [x for line in H.page_text(p.html).split("\n") for x in (line.strip().removeprefix("- ")).split()]
        assert got == w.words


def test_deep_and_odd_pages_end():
    for page in ("<div>" * 20000 + "x", "<table><tr><td>" * 300 + "x", "<p" * 20000, '<a "' * 20000, "<" * 50000, "<ul><li>" * 3000 + "y", "<b>" * 9000 + "</i>" * 9000):
        H.page_text(page)


def test_html_frames(spark):
    data = [(1, "<p>a<p>b"), (2, None), (3, ""), (None, "<b>x</b>"), (1, "<p>a<p>b")]
    pages = spark.createDataFrame([(i, "u", t, "clash") for i, t in data], "page_id long, url string, html string, text string")
    assert Counter((r.page_id, r.text) for r in H.html_text(pages).collect()) == Counter([(1, "a\n\nb"), (2, ""), (3, ""), (None, "x"), (1, "a\n\nb")])
    assert H.html_text(pages.limit(0)).collect() == []


# Queries and the pipeline.


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {re.match(r"op\d+", n)[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_decontamination", "op5_jaccard_join", "op6_line_dedup", "op10_exact_dedup"])
def test_queries_match_their_sql(spark, name):
    from tests.compare import assert_matches

    assert_matches(spark, name, "/root/testdata/sf0.001")


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Each stage over what the one before it kept, against plain Python; quality by its own operator's scores."""
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    data = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, sf)
        if name == "quality":
            good = {r.doc_id for r in quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
            data = [(i, t) for i, t in data if i in good]
        elif name == "exact_dedup":
            seen: dict[str, int] = {}
            for i, t in sorted(data):
                seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
            data = [(i, t) for i, t in data if i in set(seen.values())]
        elif name == "jaccard_join":
            kept = {root for _, _, root in brute_classes(data, 5, 80)}
            data = [(i, t) for i, t in data if i in kept]
        elif name == "decontamination":
            bad = {i for i, *_, hit in brute_hits(data, bench) if hit}
            data = [(i, t) for i, t in data if i not in bad]
        else:
            ref = reference_encoding()
            got = {r.doc_id: (r.ids, r.decoded_sha256) for r in out.collect()}
            assert got == {i: (ref.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data}
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _ in data), name
    assert [r.doc_id for r in c.run(spark, sf).select("doc_id").orderBy("doc_id").collect()] == sorted(i for i, _ in data)
