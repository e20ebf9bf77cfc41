"""Golden cases, algebraic equivalences and the SQL of the linkage queries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinmatch import oracles, queries
from kinmatch.functions import fuzzy, unicode
from kinmatch.functions import lineage_a as A
from kinmatch.functions import lineage_b as B
from kinmatch.operators import blocking as K
from kinmatch.operators import decide as D
from kinmatch.operators import features as X
from kinmatch.operators import metrics as M
from kinmatch.operators import model as L
from kinmatch.operators import retrieval as R
from kinmatch.operators import validate as V
from kinmatch.sources import records
from tests.compare import assert_matches

SF = "/root/testdata/sf0.001"


def column(spark, f, values):
    """f over a column of strings, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, name):
    assert_matches(spark, name, SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.SQL)))
def test_other_queries_have_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_names(spark):
    cases = {"Acme Pvt. Ltd.": "acme", "Limited Edition Games": "limited edition games", "Holdings Inc": "", "Café Noir SARL": "caf noir", "A&B Tools": "a b tools", "गुजरात Ltd": "गुजरात", "": "", None: ""}
    assert column(spark, A.normalize_name, cases) == list(cases.values())


def test_suffix_pattern_equals_popping(spark):
    r = random.Random(1)
    words = [*A.LEGAL_SUFFIXES, "acme", "tools", "inca", "coal"]
    names = [" ".join(r.choice(words) for _ in range(r.randrange(6))) for _ in range(500)]

    def popped(n):
        w = n.split()
        while w and w[-1] in A.LEGAL_SUFFIXES:
            w.pop()
        return " ".join(w)

    assert column(spark, A.normalize_name, names) == [popped(n) for n in names]


def test_long_runs_of_suffixes(spark):
    """A plain repetition overflows the stack of a task here."""
    run = "co ag as " * 20_000
    assert column(spark, A.normalize_name, [f"acme {run}", f"{run} x", run, f"x {run} acme {run}"]) == ["acme", f"{run.strip()} x", "", f"x {run.strip()} acme"]


def test_words_are_found_not_split(spark):
    """Against the splitting forms; a key array is made once, and sorted without a comparison in lambdas."""
    r = random.Random(7)
    texts = ["".join(r.choice(["ab", "12", "7", " ", ".", "road", "é", "ﬁ", "ग", "१", "\n", "😀", "Ab9"]) for _ in range(r.randrange(25))) for _ in range(400)] + [None, "", "123456", "१२३४"]
    other = "[^0-9a-zऀ-ॿ]+"

    def words(s, least):
        found = re.split(other, unicode.unicodedata.normalize("NFKC", (s or "").lower()))
        return list(dict.fromkeys(w for w in found if len(w) >= least and re.search("[^0-9]", w) and w not in A.ADDRESS_SKIP))

    assert column(spark, A.plain_words, texts) == [re.sub(other, " ", (s or "").lower()).strip(" ") for s in texts]
    for least in (1, 2, 4):
        assert column(spark, lambda s, k=least: A.address_tokens(s, k), texts) == [words(s, least) for s in texts]
    plan = queries.QUERIES["block_keys"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(|, A") == 1 and "lambda left" not in plan and "[^0-9a-z" not in plan


def test_long_grams(spark):
    r = random.Random(3)
    s = "".join(r.choice("aé😀ग ") for _ in range(200_000))
    for f, n, t in ((A.trigrams, 3, s.replace(" ", "_")), (A.char4, 4, s)):
        assert column(spark, f, [s]) == [list(dict.fromkeys(t[i : i + n] for i in range(len(t) - n + 1)))]
        assert "substring" not in spark.range(1).select(f(F.lit("abcd")))._jdf.queryExecution().logical().toString()  # which walks from the start for each gram


def test_retrieved_pairs_never_move(spark):
    """Against plain sums; lists of targets go to queries, and no exchange lies between pairs and their sums."""
    r = random.Random(7)
    rows = [(f"S{i % 3 + 1}-{i % 40:02}x{i}", i, i % 3 + 1, " ".join(r.choices(["silver", "lake", "delta", "omega", "lining"], k=3)), r.choice(["hill road", "10 lake view", ""]), r.choice(["en", "de"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "entity_id string, ord long, src int, business_name string, business_address string, country string")
    vocabulary, pairs = R.retrieve_candidates(docs, 4, 6, fold=False)
    first = {}
    for t in sorted(R.target_tokens(docs, False).collect(), key=lambda t: t.ord):
        first.setdefault(t.token, []).append(t)
    idf, sums = {v.token: v.idf for v in vocabulary.collect()}, {}
    for q in R.query_tokens(docs, False).collect():
        for t in first.get(q.token, [])[:6]:
            if t.country == q.country:
                of = sums.setdefault(q.s1_id, {})
                of[t.tgt_id] = of.get(t.tgt_id, 0.0) + idf[q.token]
    want = {(s, t, n) for s, of in sums.items() for n, (t, _) in enumerate(sorted(of.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4])}
    assert {(p.s1_id, p.tgt_id, p["rank"]) for p in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s1_id" in plan and not re.search(r"hashpartitioning\(s1_id#\d+, (at|tgt_id)#", plan)


def test_retrieval_without_a_cap_is_whole(spark, monkeypatch):
    """Against plain sums over all targets of all tokens, with more holders of a token than any cap here; records fill several tiles."""
    from kinmatch.operators import tiles

    r = random.Random(9)
    rows = [(f"S{i % 3 + 1}-{i % 40:02}x{i}", i, i % 3 + 1, " ".join(r.choices(["silver", "lake", "delta", "omega", "lining"], k=3)), r.choice(["hill road", "10 lake view", "late word", ""]), r.choice(["en", "de"])) for i in range(240)]
    docs = spark.createDataFrame(rows, "entity_id string, ord long, src int, business_name string, business_address string, country string")
    vocabulary, capped = R.retrieve_candidates(docs, 4, 6, fold=False)
    idf, sums = {v.token: v.idf for v in vocabulary.collect()}, {}
    holders = R.target_tokens(docs, False).collect()
    for q in R.query_tokens(docs, False).collect():
        for t in holders:
            if (t.token, t.country) == (q.token, q.country):
                of = sums.setdefault(q.s1_id, {})
                of[t.tgt_id] = of.get(t.tgt_id, 0.0) + idf[q.token]
    want = {(s, t, n, round(x, 6)) for s, of in sums.items() for n, (t, x) in enumerate(sorted(of.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4])}
    rows_of = lambda pairs: {(p.s1_id, p.tgt_id, p["rank"], round(p.block_score, 6)) for p in pairs.collect()}
    assert rows_of(capped) != want
    for size in (8192, 25):
        monkeypatch.setattr(tiles, "TILE", size)
        assert rows_of(R.retrieve_candidates(docs, 4, None, fold=False)[1]) == want


def test_no_cap_in_retrieval_queries(monkeypatch, spark):
    """Neither the query nor its SQL takes the first targets of a token."""
    for name in ("idf_retrieval_topk", "pair_features_b"):
        monkeypatch.setattr(R, "capped_postings", None)
        queries.QUERIES[name](spark, SF)
        assert "nth <= 40" not in oracles.SQL[name]


def test_all_pairs_are_scored(spark):
    """Against the SQL without caps and budgets; the pairs that budgets let through are far fewer."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(oracles.query([*oracles.WHOLE, oracles.TRUTH], "SELECT f.s1_id, f.other_id, (t.s1_id IS NOT NULL)::INT FROM final f LEFT JOIN truth t ON t.s1_id = f.s1_id AND t.other_id = f.other_id")).fetchall()
    got = queries.QUERIES["gbt_scores"](spark, SF)
    rows = [(x.s1_id, x.other_id, x.label) for x in got.collect()]
    assert sorted(rows) == sorted(want) and len(rows) > 2 * queries.QUERIES["entity_budget"](spark, SF).count()
    assert got.filter("score is null or score < 0 or score > 1").count() == 0


def test_numbers_of_many_rows(spark):
    """Rows are wide, so that AQE merges ranges of whole rows and of sorted columns alone in other ways."""
    rows = spark.range(0, 200_000, 1, 16).select(F.col("id").alias("ord"), F.xxhash64("id").alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    right = F.expr("nth = ord AND total = 200000 AND wide = sha2(string(ord), 512)")
    assert records.numbered(rows, "ord").agg(F.count("*"), F.count_if(right)).first()[:] == (200_000, 200_000)
    assert records.numbered(rows, "v").agg(F.countDistinct("nth"), F.min("nth"), F.max("nth")).first()[:] == (200_000, 0, 199_999)


def test_long_lists_keep_the_strongest_pairs(spark):
    """Against all pairs of all lists: only a record's first list may be longer than its budget."""
    r = random.Random(5)
    names = ["silver lining", "silver lake", "northern silver works", "delta lining", "x"]
    rows = [(f"S{i % 3 + 1}-{i}", i, i % 3 + 1, r.choice(names), f"{r.choice(['delta', 'lane', 'omega hill'])} {r.choice(['10001', '20002', ''])}", r.choice(["en", "en", "de"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "entity_id string, ord long, src int, business_name string, business_address string, country string")
    for p in (queries.PARAMS, K.BlockingParams(token_cap=10, post_budget=7, pre_collect=12), K.BlockingParams(post_budget=60, pre_collect=5)):
        keys = K.block_keys(K.prepare(docs), p)
        index, probe = keys.filter("src = 1"), keys.filter("src > 1")
        df = K.trimmed(index, p)
        visits = K.budgeted(probe, df, p)
        columns = ["other_id", "s1_id", "weight", "pre_rank"]
        plain, kept = (sorted(K.top_by_weight(K.candidates(visits, lists), p.pre_collect).select(columns).collect()) for lists in (index.join(df, "key", "left_semi"), K.visited(index, df, p)))
        assert kept == plain and plain
        assert K.visited(index, df, p).groupBy("key").count().agg(F.max("count")).first()[0] <= max(p.post_budget, p.pre_collect)


def test_words_join_stored_pairs_in_parts(spark, monkeypatch):
    """Shuffles of keys end before words of records join their pairs, a part at a time; nothing is left to shuffle."""
    docs = records.document_records(spark, SF)
    whole = K.scored_candidates(docs, queries.PARAMS)[1]
    names, settled = [], K.settled
    monkeypatch.setattr(K, "PART_PAIRS", 50)
    monkeypatch.setattr(K, "settled", lambda df, label: (names.append(label), settled(df, label))[1])
    parts = K.scored_candidates(docs, queries.PARAMS)[1]
    assert names == ["light", "key-counts", "visits", "weighed"] + ["scored"] * K.PARTS
    assert sorted(parts.collect()) == sorted(whole.select(parts.columns).collect()) and whole.count() > 200
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()


def test_matches_are_counted_over_all_pairs(spark, tmp_path, monkeypatch):
    """Against evidence of every pair; lists are longer than every cap and budget, and records fill several tiles."""
    from kinmatch.operators import tiles

    r = random.Random(8)
    names = ["silver lining", "lining silver", "a b", "b a", "northern silver works", "x", "Inc"]
    words = ["delta", "lane", "omega", "hill", "10001", "20002", "30003"]
    text = lambda: r.choice(names) + "\n" + " ".join(r.sample(words, r.randrange(7)))
    texts = [text() for _ in range(150)]
    rows = [(i, r.choice([t, t.replace("\n", " \n").upper()]), r.choice(["en", "en", "de", None])) for i, t in enumerate(texts + texts[::5])] + [(1000, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = records.document_records(spark, str(tmp_path)).withColumn("text_key", records.text_key())
    light = K.prepare(docs, "text_key").withColumn("key", F.transform(K.key_array(), lambda k: k["key"]))
    side = lambda x, kept: light.filter(kept).select(F.struct(*light.columns).alias(x))
    l, x = F.col("l"), F.col("r")  # noqa: E741
    pairs = side("l", "src = 1").crossJoin(side("r", "src > 1")).select(l["ord"].alias("ord"), K.evidence(l, x).alias("score"), F.arrays_overlap(l["key"], x["key"]).alias("met"), (l["text_key"] == x["text_key"]).alias("same"))
    want = {}
    for p in pairs.collect():
        if p.met and p.score >= 6:
            k, t = want.get(p.ord, (0, 0))
            want[p.ord] = (k + 1, t + p.same)
    assert max(k for k, _ in want.values()) > max(queries.PARAMS.post_budget, queries.PARAMS.collect)
    for size in (8192, 20):
        monkeypatch.setattr(tiles, "TILE", size)
        got = K.match_counts(K.prepare(docs, "text_key"), lambda score: score >= 6, queries.PARAMS)
        assert {g.ord: (g.k, g.t) for g in got.collect() if g.k} == want
    known = records.document_truth(spark, str(tmp_path)).groupBy("s1_id").count().collect()
    sizes = records.document_truth_sizes(spark, str(tmp_path)).collect()
    assert {(m.s1_id, m.m) for m in sizes if m.m} == {tuple(m) for m in known} and len(sizes) == docs.filter("src = 1").count()
    counts = {c.s1_id: (c.k, c.t) for c in queries._counts(spark, str(tmp_path)).collect()}
    assert {s1: c for s1, c in counts.items() if c[0]} == {f"S1-{i}": c for i, c in want.items()} and len(counts) == len(sizes)


def test_union_sizes_make_no_pairs_of_equal_names(spark):
    """Against all pairs of all lists; 3,000 records of one name would make 2 million pairs."""
    r = random.Random(6)
    names = ["silver lining", "silver lake", "northern silver works", "delta lining", "x"]
    rows = [(f"S{i % 3 + 1}-{i}", i, i % 3 + 1, r.choice(names), f"{r.choice(['delta', 'lane', 'omega hill'])} {r.choice(['10001', '20002', ''])}", r.choice(["en", "en", "de"])) for i in range(200)]
    schema = "entity_id string, ord long, src int, business_name string, business_address string, country string"
    for p in (queries.PARAMS, K.BlockingParams(token_cap=30, prefix_cap=20, address_cap=25), K.BlockingParams(signature_keys=True, country_free_keys=True)):
        light = K.prepare(spark.createDataFrame(rows, schema))
        keys = K.block_keys(light, p)
        visits = keys.filter("src > 1").join(K.trimmed(keys.filter("src = 1"), p), "key").select(F.col("entity_id").alias("other_id"), F.col("ord").alias("other_ord"), "src", "w", "key", F.lit(0).alias("nth"))
        plain = K.candidates(visits, keys.filter("src = 1")).groupBy("other_id").agg(F.count("*").alias("n_pairs"), F.sum("weight").alias("weight"))
        got = K.union_sizes(light, p)
        assert sorted(got.collect()) == sorted(plain.select(got.columns).collect()) and plain.count() > 100
    many = spark.range(3000).selectExpr("concat('S', id % 3 + 1, '-', id) entity_id", "id ord", "cast(id % 3 + 1 as int) src", "'one name' business_name", "'' business_address", "'en' country")
    pairs = K.union_sizes(K.prepare(many), queries.PARAMS)
    assert {x[1:] for x in pairs.collect()} == {(1000, 8000.0)} and pairs.count() == 2000


def test_pins_and_grams(spark):
    assert column(spark, A.pins, ["12 Main St 560001-1234, 99999, 560001", "1234567", "10001 20002 30003 40004", None]) == [["560001", "99999"], [], ["10001", "20002", "30003"], []]
    assert column(spark, A.trigrams, ["ab c", "ab", ""]) == [["ab_", "b_c"], ["ab"], []]
    r = random.Random(2)
    texts = ["".join(r.choice("12a ") for _ in range(30)) for _ in range(300)]

    def plain(s):
        out = []
        for m in re.findall(r"(?<!\d)\d{5,6}(?!\d)", s):
            if m not in out:
                out.append(m)
        return out[:3]

    assert column(spark, A.pins, texts) == [plain(t) for t in texts]


def test_two_jaccards(spark):
    df = spark.sql("SELECT array() AS a, array('x') AS b, array('x', 'y') AS c").select(*[F.col(k).cast("array<string>").alias(k) for k in "abc"])
    a, b, c = (F.col(k) for k in "abc")
    assert df.select(A.jaccard(a, a), A.jaccard(a, b), A.jaccard(b, c), B.jaccard(a, a), B.containment(b, c), B.dice(b, c)).first()[:] == (1.0, 0.0, 0.5, 0.0, 1.0, pytest.approx(2 / 3))


def test_archive_texts(spark):
    assert column(spark, lambda s: B.name_tokens(s), ["northernsilver.com", "@smithveterinary", "458-a", "Café & Søn", None]) == [["northernsilver"], ["smithveterinary"], ["458", "a"], ["cafe", "and", "s", "n"], []]
    assert column(spark, B.normalize_number, ["00203", "0", "000", "12a", "007b"]) == ["203", "0", "0", "12a", "7b"]
    assert column(spark, B.trade_name_variants, ["Deltasol dba Ajmer Lining"]) == [["deltasol", "ajmer lining", "deltasol dba ajmer lining"]]
    assert column(spark, B.dominant_script, ["abc", "गुजरात ab", "தமிழ்", "123", None]) == ["LATIN", "DEVANAGARI", "TAMIL", "LATIN", "LATIN"]
    assert unicode.folded("Ångström é गुजरात") == "Angstrom e गुजरात"
    assert [tuple(r) for r in column(spark, B.last_components, ["1 Road, Pune, MH", "Pune", ", ,x", "a, --"])] == [("pune", "mh"), (None, None), (None, None), (None, None)]


def test_domains_are_found_in_one_pass(spark):
    """Against the plain pattern; which takes steps with the square of a run's length, minutes here."""
    import time

    plain = r"([a-z0-9-]+)\.(?:" + "|".join(B.DOMAINS) + r")\b"
    found = lambda pattern: column(spark, lambda s: F.array_join(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), "|"), texts)
    rest = lambda pattern: column(spark, lambda s: F.array_join(F.split(s, pattern, -1), "|"), texts)
    r = random.Random(10)
    texts = ["".join(r.choice(["foo", "a-b", ".com", ".net", ".in", "-", " ", "x1", "_", ".", "é", ".co.in", ".com-bar.net"]) for _ in range(r.randrange(14))) for _ in range(2000)]
    assert found(B.DOMAIN) == found(plain) and rest(B.DOMAIN) == rest(plain) and any(found(plain))
    start = time.time()
    assert column(spark, B.split_domains, ["a" * 1_000_000]) == ["a" * 1_000_000] and time.time() - start < 30


def rec(spark, rows):
    return spark.createDataFrame(rows, "ord long, entity_id string, src long, business_name string, business_address string, country string")


def test_keys_evidence_and_features(spark):
    light = K.prepare(rec(spark, [(1, "S1-1", 1, "Acme Tools", "Baker 56001", "US"), (2, "S1-2", 1, "acme tools", "", "US"), (3, "S2-3", 2, "Acme Tool", "", "us"), (4, "S1-4", 1, "Inc", "", "")]))
    keys = {(r.w, r.key) for r in K.block_keys(light).filter("entity_id = 'S1-1'").collect()}
    assert keys == {(8.0, "E|us|acme tools"), (3.0, "T|us|acme"), (3.0, "T|us|tools"), (1.0, "X|us|acme"), (1.0, "X|us|tool"), (1.5, "A|us|baker"), (3.0, "Z|us|56001")}
    assert light.count() == 3
    pairs = K.with_sides(spark.createDataFrame([("S1-2", "S2-3"), ("S1-2", "S1-2")], "s1_id string, other_id string"), light)
    scores = {r.other_id: r.e for r in pairs.select("other_id", K.evidence(F.col("l"), F.col("r")).alias("e")).collect()}
    assert scores == {"S2-3": 4.0, "S1-2": 22.0}
    f = X.with_features_a(pairs.filter("other_id = 'S2-3'")).first().asDict()
    want = dict(name_exact=0, name_jacc=1 / 3, name_tri=0.875, name_pre3=1, addr_jacc=1, pin_eq=0, country_eq=1, len_ratio=0.9, tok_contain=0.5, sig_eq=0, first_tok_eq=1, last_tok_eq=0, lcp_ratio=0.9, num_tok_jacc=1, addr_num_eq=0, sub_str=1, min_len_log=0.460517, addr_len_ratio=1, tok_min_log=1 / 3, tok_pre4_jacc=1)
    assert {k: f[k] for k in want} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_posting_budget_passes_over(spark):
    probe = spark.createDataFrame([("S2-1", 1, 2, w, k) for w, k in ((3.0, "a"), (2.0, "b"), (1.0, "c"))] + [("S2-2", 2, 2, w, k) for w, k in ((8.0, "d"), (3.0, "e"))], "entity_id string, ord long, src long, w double, key string")
    df = spark.createDataFrame([("a", 300), ("b", 200), ("c", 50), ("d", 900), ("e", 10)], "key string, df long")
    got = {(r.other_id, r.key) for r in K.budgeted(probe, df).collect()}
    assert got == {("S2-1", "a"), ("S2-1", "c"), ("S2-2", "d")}


def test_entity_budget_equals_counting(spark):
    r = random.Random(4)
    rows = [(f"S1-{r.randrange(5)}", f"S2-{i}", 2, i, 0, float(r.randrange(3, 9))) for i in range(200)]
    got = {(x.s1_id, x.other_id) for x in K.entity_budget(spark.createDataFrame(rows, "s1_id string, other_id string, src int, other_ord int, rank int, score double"), K.BlockingParams(budget=3)).collect()}
    counts, want = {}, set()
    for s1, other, *_, score in rows:
        if score < 6 and counts.get(s1, 0) >= 3:
            continue
        counts[s1] = counts.get(s1, 0) + 1
        want.add((s1, other))
    assert got == want


def test_idf(spark):
    tokens = spark.createDataFrame([("a",)] + [("b",)] * 9 + [("c",)] * 100, "token string")
    assert {r.token: round(r.idf, 6) for r in R.idf_vocabulary(tokens, 100).collect()} == {"a": 4.921973, "b": 3.312535, "c": 1.0}


def test_f_half(spark):
    cases = [(0, 0, 0, 1), (0, 1, 0, 0), (2, 0, 0, 0), (2, 3, 2, 0.714286), (1, 1, 1, 1), (4, 1, 1, 0.625), (3, 2, 0, 0)]
    df = spark.createDataFrame([(m, k, t) for m, k, t, _ in cases], "m int, k int, t int")
    got = [round(float(r.f), 6) for r in df.select(M.f_half(F.col("m"), F.col("k"), F.col("t")).alias("f")).collect()]
    assert got == [w for *_, w in cases]


def test_hash_split(spark):
    assert column(spark, L.held_out, ["S1-1", "S1-4", "S1-714132312"]) == [False, True, False]


def test_decisions(spark):
    scores = spark.createDataFrame([("A", 1, "x", 0.9), ("A", 1, "y", 0.4), ("B", 2, "x", 0.7), ("C", 3, "z", 0.35), ("D", 4, "z", 0.2)], "s1_id string, s1_ord int, tgt_id string, score double")
    kept = {(r.s1_id, r.tgt_id) for r in D.one_owner(D.accept(scores)).collect()}
    assert kept == {("A", "x"), ("C", "z")}


def test_validator(spark):
    lines = spark.createDataFrame([(x,) for x in ("S1-1\tS2-1,S3-2", "S1-1\t", "S1-2\tS2-1,S2-1", "S1-3\tS1-9,X-1,S2-77", "no tab", "", "S1-5\t")], "line string")
    required = spark.createDataFrame([(f"S1-{i}",) for i in (1, 2, 3, 4)], "s1_id string")
    known = spark.createDataFrame([("S2-1",), ("S3-2",)], "other_id string")
    summary = V.report(V.violations(V.parsed(lines), required, known))
    assert {r.rule: r.examples for r in summary.collect()} == {"duplicate_s1": "S1-1", "repeated_id": "S1-2", "self_match": "S1-9", "bad_prefix": "X-1", "unknown_id": "S2-77", "malformed": "no tab", "missing_s1": "S1-4", "extra_s1": "S1-5"}
    assert V.exit_code(summary) == 1
    assert V.header_errors("Source1_Entity_Id\tmatched_entity_ids", V.RESULT_HEADER) == [] and V.header_errors("source1_entity_id,matched_entity_ids", V.RESULT_HEADER) and V.header_errors("", V.RESULT_HEADER)


def test_fuzzy():
    assert fuzzy.token_set_ratio("acme tools", "tools acme") == 1.0 and fuzzy.token_set_ratio("", "a") == 0.0
    assert fuzzy.partial_ratio("tool", "acme tools") == 1.0
    r = random.Random(5)
    for _ in range(100):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert fuzzy.lcs_length(a, b) == t[-1][-1]


def test_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "quoted" name\tRoad 1\tUS\nS1-2\tShort\n', encoding="utf-8")
    got = records.read_source(spark, str(tmp_path / "s.tsv")).collect()
    assert [tuple(r) for r in got] == [("S1-1", 'A "quoted" name', "Road 1", "US"), ("S1-2", "Short", "", "")]
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,\nS1-2\t\n", encoding="utf-8")
    assert [(r.s1_id, r.ids) for r in records.read_truth(spark, str(tmp_path / "t.tsv")).collect()] == [("S1-1", ["S2-1", "S3-2"]), ("S1-2", [])]
    assert records.read_truth(spark, str(tmp_path / "t.tsv"), singletons=False).count() == 1
    rows = spark.createDataFrame([(2, "S1-2", ""), (1, "S1-1", "S2-1,S3-2")], "ord int, source1_entity_id string, matched_entity_ids string")
    records.write_results(rows.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.replace("source1_entity_id\tmatched_entity_ids\n", "") == "S1-1\tS2-1,S3-2\nS1-2\t\n"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_whole_run(spark, tmp_path):
    """Block, train, predict and validate from files; a second run resumes."""
    from kinmatch.plans import linkage

    r = random.Random(6)
    words = "amber birch cedar delta ember flint grove harbor iris jade".split()
    name = lambda i: " ".join(random.Random(i).sample(words, 3)) + f" {i}"
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for s in (1, 2, 3):
        body = "".join(f"S{s}-{i}\t{name(i)}{' Ltd' if s == 2 else ''}\t{r.randrange(99)} Lakeview, Pune {10000 + i}\tIndia\n" for i in range(60) if s == 1 or i % s)
        (tmp_path / f"s{s}.tsv").write_text(head + body)
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{','.join(f'S{s}-{i}' for s in (2, 3) if i % s)}\n" for i in range(60)))
    paths = [str(tmp_path / f"s{s}.tsv") for s in (1, 2, 3)]
    p, m = K.BlockingParams(token_cap=60, post_budget=60), L.ModelParams(rounds=3, depth=3, negatives=1.0)
    out = linkage.run(spark, "full", paths, str(tmp_path / "t.tsv"), str(tmp_path / "out"), p, m)
    truth = records.read_truth(spark, str(tmp_path / "t.tsv"))
    assert out.count() == 60
    got = out.select(F.col("source1_entity_id").alias("s1_id"), records.id_list(F.col("matched_entity_ids")).alias("got")).join(truth, "s1_id")
    right = got.select(F.avg((F.array_sort("got") == F.array_sort("ids")).cast("double"))).first()[0]
    assert right > 0.8
    assert linkage.run(spark, "recall", paths, str(tmp_path / "t.tsv"), str(tmp_path / "out"), p, m).first().recall > 0.9
    rows = V.parsed(V.read_lines(spark, str(tmp_path / "out" / "matching_results")).filter("line not like 'source1_entity_id%'"))
    assert V.report(V.violations(rows, truth.select("s1_id"))).count() == 0


def files(tmp_path, n=60):
    r = random.Random(6)
    words = "amber birch cedar delta ember flint grove harbor iris jade".split()
    name = lambda i: " ".join(random.Random(i).sample(words, 3)) + f" {i}"
    for s in (1, 2, 3):
        body = "".join(f"S{s}-{i}\t{name(i)}{' Ltd' if s == 2 else ''}\t{r.randrange(99)} Lakeview, Pune, {('MH', 'Maharashtra')[s % 2]}\tIndia\n" for i in range(n) if s == 1 or i % s)
        (tmp_path / f"s{s}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + body)
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{','.join(f'S{s}-{i}' for s in (2, 3) if i % s)}\n" for i in range(n)))
    return [str(tmp_path / f"s{s}.tsv") for s in (1, 2, 3)], str(tmp_path / "t.tsv")


def test_whole_run_of_the_second_lineage(spark, tmp_path):
    from kinmatch.plans import linkage, retrieval

    paths, truth = files(tmp_path)
    p = retrieval.RetrievalParams(top_k=5, hold_out=0.3)
    row = retrieval.train(spark, paths, truth, str(tmp_path / "m"), p, L.ModelParams(rounds=3, depth=3, balance=True, validate=0.1)).first()
    assert row.macro_f05 > 0.7 and row.link_recall > 0.9
    report = retrieval.test(spark, paths, str(tmp_path / "m"), str(tmp_path / "o"), p)
    assert V.exit_code(report) == 0
    score = linkage.score_file(spark, str(tmp_path / "o" / "matching_results"), truth).first()
    assert score.n == 60 and score.macro_f05 > 0.7
    (tmp_path / "o" / "candidate_pairs").rename(tmp_path / "o" / "elsewhere")
    report = linkage.run(spark, "validate", paths, None, str(tmp_path / "o"))
    assert [(r.rule, r.severity) for r in report.collect()] == [("no_candidates", "warning")] and V.exit_code(report) == 0


def test_rows_by_id(spark, tmp_path):
    from kinmatch.operators import profile

    paths, _ = files(tmp_path, 10)
    ids = records.read_ids(spark, paths[1])
    assert sorted(r.entity_id for r in ids.collect()) == [f"S2-{i}" for i in (1, 3, 5, 7, 9)]
    got = profile.only_ids(records.read_source(spark, paths[1]), ids.filter("entity_id < 'S2-5'"))
    assert sorted(r.entity_id for r in got.collect()) == ["S2-1", "S2-3"]
    assert [r.x for r in ids.select(B.source_prefix(F.col("entity_id")).alias("x")).distinct().collect()] == ["S2"]


def test_windows(spark, tmp_path):
    from kinmatch.plans import linkage

    paths, truth = files(tmp_path, 30)
    row = linkage.run(spark, "recall", paths, truth, str(tmp_path / "o"), K.BlockingParams(token_cap=60, post_budget=60), limit=5, s1_limit=8).first()
    assert (row.known, row.found) == (9, 9)  # S2-1, 3, 5, 7 and S3-1, 2, 4, 5, 7, with S1-0 to 7
    data = records.first_rows(linkage.load_records(spark, paths), 5, 8)
    assert sorted(r.entity_id for r in data.filter("src = 2").collect()) == ["S2-1", "S2-3", "S2-5", "S2-7", "S2-9"] and data.filter("src = 1").count() == 8


def test_percentiles(spark):
    import numpy as np

    r = random.Random(7)
    for n in (1, 2, 7, 500):
        values = [round(r.random(), 2) for _ in range(n)]
        got = {round(x.share, 2): x.value for x in M.percentiles(spark.createDataFrame([(v,) for v in values], "score double"), "score").collect()}
        assert len(got) == 101 and all(got[round(i / 100, 2)] == pytest.approx(np.percentile(values, i)) for i in range(101))


def test_states_by_name(spark, tmp_path):
    from kinmatch.operators import state_maps as S

    rows = [(i, f"S1-{i}", 1, "x", f"1 Road, {city}, {state}", "IN") for i, (city, state) in enumerate([(c, s) for c in ("Pune", "Mumbai", "Nashik") for s in ("MH", "Maharashtra", "MH")] + [("Pune", "Goa"), ("Panaji", "Goa")])]
    data = rec(spark, [*rows, (90, "S1-90", 1, "x", "no components", "IN")])
    S.save_maps(S.state_clusters(S.surface_counts(data)), str(tmp_path / "maps"))
    got = {r.entity_id: r.state for r in S.canonical_state(data, S.load_maps(spark, str(tmp_path / "maps"))).collect()}
    assert {got[f"S1-{i}"] for i in range(9)} == {"mh"} and got["S1-9"] == "goa" and got["S1-90"] == ""


def test_compatibility_forms(spark):
    import unicodedata

    texts = ["Ｌａｋｅ ｔｏｗｅｒ", "ﬁeld ½", "café villa", "ⅷth", "plain", "", None]
    assert column(spark, unicode.nfkc, texts) == [t and unicodedata.normalize("NFKC", t) for t in texts]
    assert column(spark, A.address_tokens, ["Ｌａｋｅ ﬁeld cafés"]) == [["lake", "field"]]


def test_stream(spark, tmp_path):
    from kinmatch.streaming.probe import stream_pairs

    one = [(i, f"S1-{i}", 1, f"acme tools {i}", "", "us") for i in range(5)]
    two = [(i, f"S2-{i}", 2, f"acme tools {i}", "", "us") for i in range(5)]
    rec(spark, two).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ord long, entity_id string, src long, business_name string, business_address string, country string").parquet(str(tmp_path / "in"))
    q = stream_pairs(stream, K.prepare(rec(spark, one)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {(r.s1_id, r.other_id) for r in spark.read.parquet(str(tmp_path / "out")).filter("rank = 1").collect()}
    assert got == {(f"S1-{i}", f"S2-{i}") for i in range(5)}
