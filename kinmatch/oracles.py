"""DuckDB SQL for the linkage queries, built from common table expressions."""

from __future__ import annotations

import re
import unicodedata

from kinmatch.functions.lineage_a import ADDRESS_SKIP, LEGAL_SUFFIXES
from kinmatch.functions.lineage_b import SCRIPTS
from kinmatch.functions.unicode import folded
from kinmatch.operators.features import FEATURES_A
from kinmatch.operators.metrics import GATES
from kinmatch.queries import FLOOR, MOST, PARAMS, SAMPLES, THRESHOLD, TOP_K

DEVANAGARI, INDIC = "\\x{0900}-\\x{097f}", "\\x{0900}-\\x{0d7f}"
SUFFIXES = "(?:(?:^| )(?:" + "|".join(sorted(set(LEGAL_SUFFIXES))) + "))+$"
SKIP = ", ".join(f"'{w}'" for w in sorted(set(ADDRESS_SKIP)))
EMPTY = "[]::VARCHAR[]"


def words(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^0-9a-z{DEVANAGARI}]+', ' ', 'g'))"


def name(x: str) -> str:
    return f"regexp_replace({words(x)}, '{SUFFIXES}', '')"


def tokens(n: str) -> str:
    return f"CASE WHEN {n} = '' THEN {EMPTY} ELSE list_distinct(string_split({n}, ' ')) END"


def grams(s: str, k: int) -> str:
    return f"list_distinct(list_transform(range(1, length({s}) - {k - 2}), lambda i: substr({s}, i, {k})))"


def trigrams(n: str) -> str:
    u = f"replace({n}, ' ', '_')"
    return f"CASE WHEN length({u}) >= 3 THEN {grams(u, 3)} WHEN {u} <> '' THEN [{u}] ELSE {EMPTY} END"


def char4(n: str) -> str:
    return f"CASE WHEN length({n}) >= 4 THEN {grams(n, 4)} ELSE {EMPTY} END"


# Characters whose compatibility form has letters or digits of the key alphabet: one for one, and to several.
_COMPATIBLE = {c: k for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if (k := unicodedata.normalize("NFKC", c)) != unicodedata.normalize("NFC", c) and re.search("[0-9a-z\u0900-\u097f]", k)}
SINGLE = {c: k for c, k in _COMPATIBLE.items() if len(k) == 1}
SEVERAL = {c: k for c, k in _COMPATIBLE.items() if len(k) > 1}


# Characters that lose their accents (Latin ones) or have a compatibility form, where tokens can tell.
_FOLDED = {c: k for c in map(chr, (*range(0x80, 0x300), *range(0x370, 0xD800), *range(0xE000, 0x20000))) if (k := folded(c)) != c and re.search("[\x00-\x7f\u0900-\u0d7f]", k)}
FOLD_SINGLE = {c: k for c, k in _FOLDED.items() if len(k) == 1}
FOLD_SEVERAL = {c: k for c, k in _FOLDED.items() if len(k) > 1}


def fold(x: str) -> str:
    """Latin letters without their marks, and compatibility forms; the few texts with a character of FOLD_SEVERAL are taken apart."""
    quoted = lambda s: s.replace("'", "''")
    y = f"translate({x}, '{quoted(''.join(FOLD_SINGLE))}', '{quoted(''.join(FOLD_SINGLE.values()))}')"
    spread = ", ".join(f"'{c}': '{quoted(k)}'" for c, k in FOLD_SEVERAL.items())
    y = f"CASE WHEN regexp_matches({x}, '[{''.join(FOLD_SEVERAL)}]') THEN array_to_string(list_transform(string_split({y}, ''), lambda c: coalesce(map_extract(MAP {{{spread}}}, c)[1], c)), '') ELSE {y} END"
    return f"regexp_replace({y}, '([A-Za-z\\x{{00c0}}-\\x{{024f}}])[\\x{{0300}}-\\x{{036f}}]+', '\\1', 'g')"


def nfkc(x: str) -> str:
    """As far as keys can tell; the few texts with a character of SEVERAL are taken apart."""
    y = f"nfc_normalize(translate({x}, '{''.join(SINGLE)}', '{''.join(SINGLE.values())}'))"
    spread = ", ".join(f"'{c}': '{k}'" for c, k in SEVERAL.items())
    return f"CASE WHEN regexp_matches({x}, '[{''.join(SEVERAL)}]') THEN nfc_normalize(array_to_string(list_transform(string_split({y}, ''), lambda c: coalesce(map_extract(MAP {{{spread}}}, c)[1], c)), '')) ELSE {y} END"


def address(x: str) -> str:
    plain = f"trim(regexp_replace({nfkc(f'lower({x})')}, '[^0-9a-z{DEVANAGARI}]+', ' ', 'g'))"
    return f"list_distinct(list_filter(string_split({plain}, ' '), lambda t: length(t) >= 4 AND regexp_matches(t, '[^0-9]') AND t NOT IN ({SKIP})))"


def pins(x: str) -> str:
    """The first three distinct ones, in order."""
    runs = f"list_filter(regexp_extract_all({x}, '[0-9]+'), lambda r: length(r) IN (5, 6))"
    return f"list_filter({runs}, lambda r, i: list_position({runs}, r) = i)[1:3]"


def listed(a: str, sep: str = " ") -> str:
    return f"array_to_string(list_sort({a}), '{sep}')"


def prefixes(n: str) -> str:
    return f"list_distinct(list_transform({tokens(n)}, lambda t: left(t, 4)))"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard_a(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {shared(a, b)}::DOUBLE / (len({a}) + len({b}) - {shared(a, b)}) END"


def clean(x: str, folding: bool = False) -> str:
    t = f"replace(regexp_replace(lower({fold(f'trim({x})') if folding else f'trim({x})'}), '[’‘''`]', '', 'g'), '&', ' and ')"
    marked = f"regexp_replace({t}, '([a-z0-9-]+)\\.(?:com|net|org|co|in|io|biz|info|us|fr)\\b', ' \x01\\1\x02 ', 'g')"
    for _ in range(4):  # a domain's hyphens become spaces, one at a time
        marked = f"regexp_replace({marked}, '\x01([^\x01\x02-]*)-', '\x01\\1 ', 'g')"
    return f"regexp_replace(translate({marked}, '\x01\x02', ''), '[@#]([a-z0-9_]+)', ' \\1 ', 'g')"


def tokenized(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[^0-9a-z{INDIC}]+'), lambda t: t <> '')"


def unpadded(ts: str) -> str:
    return f"list_transform({ts}, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN regexp_replace(t, '^0+([0-9])', '\\1') ELSE t END)"


def numbers(ts: str) -> str:
    return f"list_transform(list_filter({ts}, lambda t: regexp_matches(t, '[0-9]')), lambda t: regexp_replace(t, '^0+([0-9])', '\\1'))"


# crc32 of the ASCII string $, bit by bit.
CRC = "xor(4294967295::UINTEGER, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split($, ''), lambda c: ord(c)::BIGINT)), lambda r, b: list_reduce(list_concat([xor(r, b)], range(0, 8)), lambda q, k: CASE WHEN q % 2 = 1 THEN xor(q // 2, 3988292384::BIGINT) ELSE q // 2 END))::UINTEGER)::BIGINT"
REC = """rec AS (SELECT doc_id AS ord, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS id, doc_id % 3 + 1 AS src, split_part(coalesce(text, ''), chr(10), 1) AS name,
  CASE WHEN strpos(coalesce(text, ''), chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS address, coalesce(lang, '') AS country, coalesce(text, '') AS text FROM documents)"""
TRUTH = """same AS (SELECT src, id, lower(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS k FROM rec),
truth AS (SELECT a.id AS s1_id, b.id AS other_id FROM same a JOIN same b USING (k) WHERE a.src = 1 AND b.src > 1)"""
LIGHT = f"""light0 AS (SELECT id, ord, src, {name("name")} AS n, lower(trim(country)) AS c, {address("address")} AS atok, {pins("address")} AS pins FROM rec),
light1 AS (SELECT *, {tokens("n")} AS toks FROM light0 WHERE n <> ''),
light AS (SELECT *, list_distinct(list_transform(list_filter(toks, lambda t: length(t) >= 4), lambda t: left(t, 4))) AS pre FROM light1)"""
KEYS = """keys AS (SELECT id, ord, src, 8.0::DOUBLE AS w, 'E|' || c || '|' || n AS key FROM light
  UNION ALL SELECT id, ord, src, 3.0, 'T|' || c || '|' || t FROM (SELECT *, unnest(list_filter(toks, lambda t: length(t) >= 4)) AS t FROM light)
  UNION ALL SELECT id, ord, src, 1.0, 'X|' || c || '|' || t FROM (SELECT *, unnest(pre) AS t FROM light)
  UNION ALL SELECT id, ord, src, 1.5, 'A|' || c || '|' || t FROM (SELECT *, unnest(atok) AS t FROM light)
  UNION ALL SELECT id, ord, src, 3.0, 'Z|' || c || '|' || t FROM (SELECT *, unnest(pins) AS t FROM light))"""
DF = f"""dfs AS (SELECT key, count(*) AS df FROM keys WHERE src = 1 GROUP BY key
  HAVING count(*) <= CASE left(key, 1) WHEN 'T' THEN {PARAMS.token_cap} WHEN 'X' THEN {PARAMS.prefix_cap} WHEN 'A' THEN {PARAMS.address_cap} ELSE 2147483647 END)"""
VISITS = f"""lists AS (SELECT id AS other_id, ord AS other_ord, src, list({{'seen': df, 'kept': [{{'w': w, 'df': df, 'key': key}}]}} ORDER BY w DESC, df, key) AS ls FROM keys JOIN dfs USING (key) WHERE src > 1 GROUP BY ALL),
folded AS (SELECT other_id, other_ord, src, list_reduce(ls, lambda s, x: CASE WHEN s.seen >= {PARAMS.post_budget} OR (s.seen > 0 AND s.seen + x.seen > {PARAMS.post_budget}) THEN s
  ELSE {{'seen': s.seen + x.seen, 'kept': list_concat(s.kept, x.kept)}} END) AS f FROM lists),
visits AS (SELECT other_id, other_ord, src, v.w AS w, v.df AS df, v.key AS key, nth FROM (SELECT other_id, other_ord, src, unnest(f.kept) AS v, unnest(range(0, len(f.kept))) AS nth FROM folded))"""
PRE = f"""cand AS (SELECT k.id AS s1_id, k.ord AS s1_ord, other_id, other_ord, v.src, sum(v.w) AS weight, min(nth) AS first_nth FROM visits v JOIN (SELECT * FROM keys WHERE src = 1) k USING (key) GROUP BY ALL),
pre_r AS (SELECT *, row_number() OVER (PARTITION BY other_id ORDER BY weight DESC, first_nth, s1_ord) AS pre_rank FROM cand),
pre AS (SELECT * FROM pre_r WHERE pre_rank <= {PARAMS.pre_collect})"""
SCORED = f"""sides AS (SELECT p.*, l.n AS n1, r.n AS n2, l.c AS c1, r.c AS c2, l.toks AS t1, r.toks AS t2, l.pre AS p1, r.pre AS p2, l.atok AS a1, r.atok AS a2, l.pins AS z1, r.pins AS z2
  FROM pre p JOIN light l ON l.id = s1_id JOIN light r ON r.id = other_id),
scored AS (SELECT *, 2.0 * {shared("t1", "t2")} + {shared("p1", "p2")} + CASE WHEN {shared("z1", "z2")} > 0 THEN 2.0 ELSE 0.0 END + 1.5 * {shared("a1", "a2")}
  + CASE WHEN len(t1) > 0 AND len(t1) = len(t2) AND {shared("t1", "t2")} = len(t1) THEN 6.0 ELSE 0.0 END + CASE WHEN n1 = n2 THEN 10.0 ELSE 0.0 END AS score FROM sides)"""
FINAL = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY other_id ORDER BY score DESC, s1_ord DESC) AS rank FROM scored WHERE score >= {PARAMS.gate}),
counted AS (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY other_ord, rank) AS nth_of_s1 FROM ranked WHERE rank <= {PARAMS.collect}),
final AS (SELECT * FROM counted WHERE score >= {PARAMS.strong} OR nth_of_s1 <= {PARAMS.budget})"""
SCORES = "scores AS (SELECT s1_id, s1_ord, other_id, other_ord, rank, score::DOUBLE / (score + 6.0) AS score FROM final)"
PREDICTED = f"""kept AS (SELECT * FROM scores WHERE score >= {THRESHOLD}),
counts AS (SELECT e.id AS s1_id, coalesce(t.m, 0) AS m, coalesce(k.k, 0) AS k, coalesce(k.t, 0) AS t FROM (SELECT id FROM rec WHERE src = 1) e
  LEFT JOIN (SELECT s1_id, count(*) AS m FROM truth GROUP BY 1) t ON t.s1_id = e.id
  LEFT JOIN (SELECT kept.s1_id, count(*) AS k, count(truth.s1_id) AS t FROM kept LEFT JOIN truth USING (s1_id, other_id) GROUP BY 1) k ON k.s1_id = e.id)"""
F_HALF = "CASE WHEN m = 0 AND k = 0 THEN 1.0 WHEN m = 0 OR k = 0 THEN 0.0 ELSE 1.25 * t / (0.25 * m + k) END"
EVERY = "pre AS (SELECT DISTINCT k.id AS s1_id, k.ord AS s1_ord, o.id AS other_id, o.ord AS other_ord, o.src FROM keys o JOIN keys k USING (key) WHERE o.src > 1 AND k.src = 1)"
PAST = f"final AS (SELECT *, row_number() OVER (PARTITION BY other_id ORDER BY score DESC, s1_ord DESC) AS rank FROM scored WHERE score >= {PARAMS.gate})"
WHOLE = [REC, LIGHT, KEYS, EVERY, SCORED, PAST]  # without caps and budgets
BLOCKED = [REC, LIGHT, KEYS, DF, VISITS, PRE, SCORED, FINAL]


def texts(column: str) -> str:
    values = ", ".join(f"('{i}', '{s}')" for i, s in SAMPLES)
    return f"x AS (SELECT id, {column} AS s FROM rec UNION ALL SELECT * FROM (VALUES {values}) v(id, s))"


def query(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes)}\n{select}"


def features_a() -> dict[str, str]:
    few, many, ls, ll = "least(len(t1), len(t2))", "greatest(len(t1), len(t2))", "least(length(n1), length(n2))", "greatest(length(n1), length(n2))"
    flag = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
    num = lambda a: f"list_filter({a}, lambda t: regexp_matches(t, '^[0-9]'))"
    chars = lambda n: f"string_split({n}, '')"
    lcp = f"coalesce(nullif(list_position(list_transform(list_zip({chars('n1')}[1:{ls}], {chars('n2')}[1:{ls}]), lambda z: z[1] = z[2]), false), 0) - 1, {ls})"
    out = [
        flag("n1 = n2 AND n1 <> ''"), jaccard_a("t1", "t2"), jaccard_a("(" + trigrams("n1") + ")", "(" + trigrams("n2") + ")"), flag("length(n1) >= 3 AND left(n1, 3) = left(n2, 3)"), jaccard_a("a1", "a2"), flag(f"{shared('z1', 'z2')} > 0"), flag("c1 = c2"),
        f"CASE WHEN {ll} = 0 THEN 1.0 ELSE {ls}::DOUBLE / {ll} END", f"CASE WHEN {few} = 0 THEN 0.0 ELSE {shared('t1', 't2')}::DOUBLE / {few} END", flag(f"{few} > 0 AND {shared('t1', 't2')} = {many}"),
        flag(f"{few} > 0 AND split_part(n1, ' ', 1) = split_part(n2, ' ', 1)"), flag(f"{few} > 0 AND split_part(n1, ' ', -1) = split_part(n2, ' ', -1)"), f"CASE WHEN {ll} = 0 THEN 1.0 ELSE {lcp}::DOUBLE / {ll} END", jaccard_a(num("t1"), num("t2")),
        flag(f"{shared(num('a1'), num('a2'))} > 0"), flag("n1 <> '' AND n2 <> '' AND (contains(n1, n2) OR contains(n2, n1))"), f"CASE WHEN {ll} = 0 THEN 0.0 ELSE least(1.0, ln(1.0 + {ls}) / 5.0) END",
        "CASE WHEN greatest(len(a1), len(a2)) = 0 THEN 1.0 ELSE least(len(a1), len(a2))::DOUBLE / greatest(len(a1), len(a2)) END", f"CASE WHEN {many} = 0 THEN 0.0 ELSE least(1.0, {few} / 6.0) END", jaccard_a(f"({prefixes('n1')})", f"({prefixes('n2')})"),
    ]
    return dict(zip(FEATURES_A, out, strict=True))


def features_sql(part: slice) -> str:
    columns = ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in list(features_a().items())[part])
    return query(BLOCKED, f"SELECT s1_id, other_id, {columns} FROM final")


RECB = f"""rb0 AS (SELECT id, ord, src, country, {clean("name")} AS cname, {tokenized(clean("name"))} AS nt0, {unpadded(tokenized(clean("address")))} AS at0, address FROM rec),
rb AS (SELECT *, list_distinct(nt0) AS nt, list_distinct(at0) AS at, list_distinct({numbers("at0")}) AS num FROM rb0),
tt AS (SELECT * FROM (SELECT id AS tgt_id, ord, country, unnest(list_distinct(list_concat(nt0, at0))) AS token FROM rb WHERE src > 1) WHERE length(token) >= 2),
vocab AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM rec WHERE src > 1) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM tt GROUP BY token)"""
VARIANTS = f"list_filter(list_concat(list_transform(regexp_split_to_array({clean('s')}, '\\b(?:dba|d/b/a|t/a|t\\\\a|f/k/a|fka|a/k/a|aka)\\b'), lambda p: trim(p)), [trim({clean('s')})]), lambda p: p <> '')"
RETRIEVED = f"""posts AS (SELECT tt.*, idf FROM tt JOIN vocab USING (token)),
q0 AS (SELECT id AS s1_id, country, {VARIANTS.replace(clean("s"), "cname")} AS vs, at0 FROM rb WHERE src = 1),
q AS (SELECT DISTINCT s1_id, country, token FROM (SELECT s1_id, country, unnest(list_concat(flatten(list_transform(vs, lambda v: list_filter(regexp_split_to_array(v, '\\s+'), lambda t: t <> ''))), at0)) AS token FROM q0)),
got AS (SELECT s1_id, tgt_id, sum(idf) AS block_score FROM q JOIN posts USING (token, country) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(block_score, 6) DESC, tgt_id) - 1 AS rank FROM got) WHERE rank < {TOP_K})"""


def last_components(x: str) -> str:
    parts = f"list_filter(string_split({x}, ','), lambda p: trim(p) <> '')"
    return f"SELECT *, CASE WHEN len({parts}) >= 2 THEN array_to_string({tokenized(f'lower({parts}[-2])')}, ' ') END AS city0, CASE WHEN len({parts}) >= 2 THEN array_to_string({tokenized(f'lower({parts}[-1])')}, ' ') END AS state0"


def features_b_sql() -> str:
    j = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE {shared(a, b)}::DOUBLE / (len({a}) + len({b}) - {shared(a, b)}) END"
    con = lambda a, b: f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0 ELSE {shared(a, b)}::DOUBLE / least(len({a}), len({b})) END"
    dice = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE 2.0 * {shared(a, b)} / (len({a}) + len({b})) END"
    flag = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
    columns = {
        "name_jaccard": j("l.nt", "r.nt"), "name_containment": con("l.nt", "r.nt"), "name_dice": dice("l.nt", "r.nt"), "name_exact": flag("l.cname <> '' AND l.cname = r.cname"), "addr_jaccard": j("l.at", "r.at"), "addr_containment": con("l.at", "r.at"), "addr_dice": dice("l.at", "r.at"),
        "num_overlap": j("l.num", "r.num"), "num_contradict": flag(f"len(l.num) > 0 AND len(r.num) > 0 AND {shared('l.num', 'r.num')} = 0"), "state_agree": flag("l.state <> '' AND l.state = r.state"), "script_match": flag("true"), "either_native": flag("false"), "tgt_addr_empty": flag("trim(r.address) = ''"),
        "max_shared_name_idf": "coalesce(bn, 0.0)", "max_shared_addr_idf": "coalesce(ba, 0.0)", "n_shared_name": shared("l.nt", "r.nt"), "n_shared_addr": shared("l.at", "r.at"), "block_score": "block_score", "block_rank": "rank", "is_s3": flag("starts_with(top.tgt_id, 'S3-')"),
    }
    state = f"""st AS (SELECT rb.*, coalesce(canon, surface, '') AS state FROM rb LEFT JOIN canonical USING (id)),
best AS (SELECT s1_id, tgt_id, max(CASE WHEN kind = 'n' THEN idf END) AS bn, max(CASE WHEN kind = 'a' THEN idf END) AS ba FROM
  (SELECT s1_id, tgt_id, 'n' AS kind, unnest(list_intersect(l.nt, r.nt)) AS token FROM top JOIN rb l ON l.id = s1_id JOIN rb r ON r.id = tgt_id
   UNION ALL SELECT s1_id, tgt_id, 'a', unnest(list_intersect(l.at, r.at)) FROM top JOIN rb l ON l.id = s1_id JOIN rb r ON r.id = tgt_id) JOIN vocab USING (token) GROUP BY ALL)"""
    select = ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in columns.items())
    return query([REC, RECB, RETRIEVED, STATES, CANONICAL, TRUTH, state], f"SELECT top.s1_id, top.tgt_id, {select}, (EXISTS (SELECT 1 FROM truth t WHERE t.s1_id = top.s1_id AND t.other_id = top.tgt_id))::INT AS label FROM top JOIN st l ON l.id = top.s1_id JOIN st r ON r.id = top.tgt_id LEFT JOIN best ON best.s1_id = top.s1_id AND best.tgt_id = top.tgt_id", recursive=True)


STATES = f"""st0 AS ({last_components("address")} FROM rec),
sc AS (SELECT country, state0 AS state, city0 AS city, count(*) AS n, min(ord) AS first FROM st0 WHERE city0 <> '' AND state0 <> '' GROUP BY ALL),
sup AS (SELECT country, state, sum(n)::BIGINT AS support FROM sc GROUP BY ALL),
cut AS (SELECT country, greatest(2, min(support)) AS least FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY support DESC, state) AS nth FROM sup) WHERE nth <= 201 GROUP BY country),
elig AS (SELECT country, state FROM sup JOIN cut USING (country) WHERE support >= least),
pl AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY country, city ORDER BY first, state) AS nth FROM sc JOIN elig USING (country, state)) WHERE nth <= 50),
ln AS (SELECT a.country, a.state AS a, b.state AS b FROM pl a JOIN pl b ON a.country = b.country AND a.city = b.city AND a.state <> b.state GROUP BY ALL HAVING count(*) >= 2),
reach AS (SELECT country, state AS a, state AS b FROM sup UNION SELECT reach.country, reach.a, ln.b FROM reach JOIN ln ON ln.country = reach.country AND ln.a = reach.b),
lab AS (SELECT country, a AS state, min(b) AS label FROM reach GROUP BY ALL)"""

CANONICAL = """named AS (SELECT country, state AS surface, first_value(state) OVER (PARTITION BY country, label ORDER BY support DESC, state) AS canon, support FROM sup JOIN lab USING (country, state)),
canonical AS (SELECT id, st0.country, CASE WHEN city0 <> '' AND state0 <> '' THEN state0 END AS surface, canon FROM st0 LEFT JOIN named ON named.country = st0.country AND surface = state0 AND city0 <> '' AND state0 <> '')"""

_script = " ".join(f"WHEN n_{k} = best THEN '{k}'" for k in SCRIPTS)
_counts = ", ".join(f"length(regexp_replace(l, '[^\\x{{{ord(a):04x}}}-\\x{{{ord(b):04x}}}]', '', 'g')) AS n_{k}" for k, (a, b) in SCRIPTS.items())
_best = ", ".join(f"n_{k}" for k in SCRIPTS)

_lines = f"""kept AS (SELECT * FROM scores WHERE score >= {THRESHOLD}),
res AS (SELECT r.ord, r.id AS s1, coalesce(string_agg(other_id, ',' ORDER BY other_ord, rank), '') AS ids FROM rec r LEFT JOIN kept ON kept.s1_id = r.id WHERE src = 1 GROUP BY ALL),
good AS (SELECT ord, s1 || chr(9) || ids AS line FROM res),
bad AS (SELECT ord, CASE ord % 21 WHEN 0 THEN line || ',S2-1,S2-1' WHEN 3 THEN line || ',S1-9' WHEN 6 THEN line || ',X-1' WHEN 9 THEN replace(line, chr(9), ',') WHEN 12 THEN 'S1-extra' || line ELSE line END AS line FROM good WHERE ord % 21 <> 15
  UNION ALL SELECT * FROM good WHERE ord % 21 = 18),
files AS (SELECT 'good' AS file, line FROM good UNION ALL SELECT 'bad', line FROM bad),
par AS (SELECT file, line, CASE WHEN contains(line, chr(9)) THEN split_part(line, chr(9), 1) END AS s1_id, CASE WHEN contains(line, chr(9)) THEN list_filter(string_split(split_part(line, chr(9), 2), ','), lambda x: x <> '') END AS ids FROM files),
ea AS (SELECT file, s1_id, unnest(ids) AS id FROM par WHERE s1_id IS NOT NULL),
req AS (SELECT id AS s1_id FROM rec WHERE src = 1),
vi AS (SELECT file, 'malformed' AS rule, line AS example FROM par WHERE s1_id IS NULL
  UNION ALL SELECT file, 'duplicate_s1', s1_id FROM par WHERE s1_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT file, 'repeated_id', s1_id FROM par WHERE len(ids) <> len(list_distinct(ids))
  UNION ALL SELECT file, 'self_match', id FROM ea WHERE split_part(id, '-', 1) = 'S1'
  UNION ALL SELECT file, 'bad_prefix', id FROM ea WHERE split_part(id, '-', 1) NOT IN ('S1', 'S2', 'S3')
  UNION ALL SELECT file, 'unknown_id', id FROM ea WHERE split_part(id, '-', 1) IN ('S2', 'S3') AND id NOT IN (SELECT id FROM rec WHERE src > 1)
  UNION ALL SELECT f.file, 'missing_s1', s1_id FROM req, (SELECT DISTINCT file FROM par) f WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.file = f.file AND par.s1_id = req.s1_id)
  UNION ALL SELECT DISTINCT file, 'extra_s1', s1_id FROM par WHERE s1_id IS NOT NULL AND s1_id NOT IN (SELECT s1_id FROM req)
  UNION ALL SELECT DISTINCT file, 'not_candidate', s1_id || '>' || id FROM ea WHERE NOT EXISTS (SELECT 1 FROM final WHERE final.s1_id = ea.s1_id AND final.other_id = ea.id)),
per AS (SELECT *, row_number() OVER (PARTITION BY file, rule ORDER BY example) AS nth FROM (SELECT file, rule, example, count(*) AS n FROM vi GROUP BY file, rule, example))"""

_curve = " UNION ALL ".join(f"SELECT {g} AS gate, (SELECT count(*) FROM final WHERE score >= {g}) AS pairs, (SELECT count(*) FROM final JOIN truth USING (s1_id, other_id) WHERE score >= {g}) AS hit" for g in GATES)
_accepted = f"acc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, other_id) AS r FROM scores) WHERE (score >= {THRESHOLD} AND r <= {MOST}) OR (r = 1 AND score >= {FLOOR}))"
_entity = "ent AS (SELECT r.ord, r.id AS s1_id, count(t.s1_id) AS m FROM rec r LEFT JOIN truth t ON t.s1_id = r.id WHERE src = 1 GROUP BY ALL)"

SQL = {
    "normalize_names": query([REC, texts("name")], f"SELECT id, n AS name, {listed(tokens('n'))} AS tokens, {listed(prefixes('n'))} AS prefixes, {listed(f'list_filter({tokens("n")}, lambda t: regexp_matches(t, $$^[0-9]$$))')} AS numeric FROM (SELECT id, {name('s')} AS n FROM x)"),
    "address_tokens": query(
        [REC, texts("address")],
        f"SELECT id, {listed(address('s'))} AS tokens, {listed(f'''list_distinct(list_filter(list_transform(regexp_split_to_array(lower(s), '\\s+'), lambda t: trim(t, '.,;:()[]{{}}''\"-')), lambda t: length(t) >= 4 AND regexp_matches(t, '\\p{{L}}') AND t NOT IN ({SKIP})))''')} AS stripped, "
        "len(list_distinct(list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda t: t <> '')))::INT AS n_plain FROM x",
    ),
    "postal_codes": query([REC, texts("address")], f"SELECT id, array_to_string({pins('s')}, ' ') AS pins FROM x"),
    "char_ngrams": query([REC, texts("name")], f"SELECT gram, count(*) AS df FROM (SELECT unnest(list_concat(list_transform({trigrams('n')}, lambda g: '3|' || g), list_transform({char4('n')}, lambda g: '4|' || g))) AS gram FROM (SELECT {name('s')} AS n FROM x)) GROUP BY gram"),
    "clean_tokens": query([REC, texts("text")], f"SELECT id, md5(array_to_string(t, ' ')) AS name_md5, len(t)::INT AS n_words, array_to_string({numbers(unpadded('t'))}, ' ') AS numbers FROM (SELECT id, {tokenized(clean('s'))} AS t FROM x)"),
    "folded_tokens": query([REC, texts("text")], f"SELECT id, array_to_string({tokenized(clean('s', folding=True))}, ' ') AS tokens FROM x"),
    "script_flags": query(
        [REC, texts("text")],
        f"SELECT id, CASE WHEN length(l) = 0 OR n_LATIN = best THEN 'LATIN' {_script} END AS script, native FROM (SELECT *, greatest({_best}, n_LATIN) AS best FROM (SELECT id, l, native, {_counts}, length(regexp_replace(l, '[{INDIC}]', '', 'g')) AS n_LATIN "
        f"FROM (SELECT id, regexp_replace(s, '[^\\p{{L}}]', '', 'g') AS l, regexp_matches(s, '[{INDIC}]') AS native FROM x)))",
    ),
    "trade_variants": query([REC, texts("name")], f"SELECT id, array_to_string(list_filter(v, lambda p, i: list_position(v, p) = i), '|') AS variants FROM (SELECT id, {VARIANTS} AS v FROM x)"),
    "block_keys": query([REC, LIGHT, KEYS], "SELECT id AS entity_id, count(*)::INT AS n_keys, sum(w) AS weight, md5(string_agg(key, ',' ORDER BY key)) AS keys_md5 FROM keys GROUP BY id"),
    "optional_keys": query(
        [REC, LIGHT, KEYS],
        f"""SELECT left(key, 1) AS kind, w, count(*) AS n, count(DISTINCT key) AS n_distinct FROM (SELECT w, key FROM keys
  UNION ALL SELECT 8.0, 'S|' || c || '|' || {listed("toks")} FROM light
  UNION ALL SELECT 8.0, 'E|' || n FROM light WHERE length(n) >= 12
  UNION ALL SELECT 1.5, 'T|' || t FROM (SELECT unnest(list_filter(toks, lambda t: length(t) >= 4)) AS t FROM light)
  UNION ALL SELECT 1.5, 'Z|' || t FROM (SELECT unnest(pins) AS t FROM light)
  UNION ALL SELECT 1.25, 'A|' || t FROM (SELECT unnest(atok) AS t FROM light)
  UNION ALL SELECT 0.7, 'G|' || c || '|' || t FROM (SELECT c, unnest({char4("n")}) AS t FROM light)) GROUP BY ALL""",
    ),
    "key_df_trim": query([REC, LIGHT, KEYS, DF], "SELECT key, df FROM dfs"),
    "key_union_join": query([REC, LIGHT, KEYS, DF], "SELECT other_id, count(*) AS n_pairs, sum(weight) AS weight FROM (SELECT p.id AS other_id, i.id AS s1_id, sum(p.w) AS weight FROM keys p JOIN dfs USING (key) JOIN keys i USING (key) WHERE p.src > 1 AND i.src = 1 GROUP BY ALL) GROUP BY other_id"),
    "posting_budget": query([REC, LIGHT, KEYS, DF, VISITS], "SELECT other_id, key, w, df, nth::INT AS nth FROM visits"),
    "evidence_topk": query([REC, LIGHT, KEYS, DF, VISITS, PRE], "SELECT s1_id, other_id, weight, pre_rank::INT AS pre_rank FROM pre"),
    "evidence_score": query([REC, LIGHT, KEYS, DF, VISITS, PRE, SCORED], "SELECT s1_id, other_id, score::DOUBLE AS score FROM scored"),
    "entity_budget": query(BLOCKED, "SELECT s1_id, other_id, score::DOUBLE AS score, rank::INT AS rank, nth_of_s1::INT AS nth_of_s1 FROM final"),
    "label_pairs": query([*BLOCKED, TRUTH], "SELECT f.s1_id, f.other_id, score::DOUBLE AS score, (t.s1_id IS NOT NULL)::INT AS label FROM final f LEFT JOIN truth t ON t.s1_id = f.s1_id AND t.other_id = f.other_id"),
    "pair_features_a1": features_sql(slice(0, 7)),
    "pair_features_a2": features_sql(slice(7, 14)),
    "pair_features_a3": features_sql(slice(14, 20)),
    "idf_vocab": query([REC, RECB], "SELECT token, df, round(idf, 6) AS idf FROM vocab"),
    "idf_retrieval_topk": query([REC, RECB, RETRIEVED], "SELECT s1_id, tgt_id, round(block_score, 6) AS block_score, rank::INT AS rank FROM top"),
    "pair_features_b": features_b_sql(),
    "state_clusters": query([REC, STATES, CANONICAL], "SELECT country, surface, canon, support FROM named", recursive=True),
    "canonical_states": query([REC, STATES, CANONICAL], "SELECT id AS entity_id, country, coalesce(canon, surface, '') AS state FROM canonical", recursive=True),
    "training_split": query(
        [*BLOCKED, TRUTH, f"lp AS (SELECT f.s1_id, f.other_id, (t.s1_id IS NOT NULL)::INT AS label, {CRC.replace('$', 'f.s1_id')} % 5 <> 0 AS trained FROM final f LEFT JOIN truth t ON t.s1_id = f.s1_id AND t.other_id = f.other_id)"],
        "SELECT trained, label, count(*) AS n, count(DISTINCT s1_id) AS n_entities FROM lp GROUP BY ALL",
    ),
    "global_threshold": query([*BLOCKED, SCORES], f"SELECT s1_id, other_id, round(score, 6) AS score FROM scores WHERE score >= {THRESHOLD}"),
    "accept_rule": query([*BLOCKED, SCORES, _accepted], "SELECT s1_id, other_id AS tgt_id, round(score, 6) AS score FROM acc"),
    "one_owner": query([*BLOCKED, SCORES, _accepted], "SELECT s1_id, other_id AS tgt_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY other_id ORDER BY score DESC, s1_ord) AS o FROM acc) WHERE o = 1"),
    "emit_results": query([*BLOCKED, SCORES], f"SELECT r.ord, r.id AS source1_entity_id, coalesce(string_agg(other_id, ',' ORDER BY other_ord, rank), '') AS matched_entity_ids FROM rec r LEFT JOIN (SELECT * FROM scores WHERE score >= {THRESHOLD}) s ON s.s1_id = r.id WHERE r.src = 1 GROUP BY ALL"),
    "emit_candidates": query(BLOCKED, "SELECT r.ord, r.id AS source1_entity_id, coalesce(string_agg(other_id, ',' ORDER BY other_ord, rank), '') AS candidate_entity_ids FROM rec r LEFT JOIN final s ON s.s1_id = r.id WHERE r.src = 1 GROUP BY ALL"),
    "macro_f05": query([*WHOLE, TRUTH, SCORES, PREDICTED], f"SELECT round(avg({F_HALF}), 6) AS macro_f05, round(avg((m = 0)::INT), 6) AS empty_floor, count(*) AS n FROM counts"),
    "error_breakdown": query([*WHOLE, TRUTH, SCORES, PREDICTED], "SELECT count(*) FILTER (m = 0) AS singletons, count(*) FILTER (m = k AND k = t) AS perfect, count(*) FILTER (m = 0 AND k > 0) AS false_merge, count(*) FILTER (m > 0 AND k = 0) AS missed FROM counts"),
    "threshold_sweep": query(
        [*BLOCKED, TRUTH, SCORES, _entity, "cuts AS (SELECT DISTINCT round(unnest(quantile_cont(score, list_transform(range(0, 101), lambda i: i / 100.0))), 4) AS threshold FROM scores)"],
        f"""SELECT threshold, round(avg({F_HALF}), 6) AS macro_f05 FROM (SELECT c.threshold, e.s1_id, e.m, count(s.s1_id) AS k, count(t.s1_id) AS t FROM cuts c CROSS JOIN ent e
  LEFT JOIN scores s ON s.s1_id = e.s1_id AND s.score >= c.threshold LEFT JOIN truth t ON t.s1_id = s.s1_id AND t.other_id = s.other_id GROUP BY ALL) WHERE threshold <= (SELECT max(score) FROM scores) GROUP BY threshold""",
    ),
    "blocking_recall": query([*BLOCKED, TRUTH], "SELECT known, found, round(found / known, 6) AS recall, round(1.25 * (found / known) / (0.25 + found / known), 6) AS ceiling FROM (SELECT count(*) AS known, count(f.s1_id) AS found FROM truth t LEFT JOIN final f ON f.s1_id = t.s1_id AND f.other_id = t.other_id)"),
    "recall_curve": query([*BLOCKED, TRUTH, f"g AS ({_curve})"], "SELECT gate, round(hit / (SELECT count(*) FROM truth), 6) AS recall, (SELECT count(*) FROM truth) - hit AS lost, pairs, round(pairs / (SELECT count(*) FROM rec WHERE src > 1), 6) AS pairs_per_other FROM g"),
    "entity_retention": query([*BLOCKED, TRUTH], "SELECT sum(m)::BIGINT AS links, sum(hit)::BIGINT AS found, round(sum(hit) / sum(m), 6) AS link_recall, round(avg((m = hit)::INT), 6) AS all_retained FROM (SELECT t.s1_id, count(*) AS m, count(f.s1_id) AS hit FROM truth t LEFT JOIN final f ON f.s1_id = t.s1_id AND f.other_id = t.other_id GROUP BY 1)"),
    "profile_source": query(
        [REC],
        "SELECT count(*) AS n_rows, round(avg((trim(name) = '')::INT), 6) AS blank_name, round(avg((trim(address) = '')::INT), 6) AS blank_address, round(avg(regexp_matches(name, '[^\\x00-\\x7F]')::INT), 6) AS non_ascii_name, "
        + ", ".join(f"round(quantile_cont(length({c})::DOUBLE, {q}), 6) AS {c}_p{int(q * 100)}" for c in ("name", "address") for q in (0.1, 0.5, 0.9, 1.0))
        + " FROM rec",
    ),
    "top_countries": query([REC], "SELECT country, count(*) AS n, round(count(*) / (SELECT count(*) FROM rec), 6) AS share FROM rec GROUP BY country ORDER BY n DESC, country LIMIT 8"),
    "profile_truth": query([REC, TRUTH, _entity], "SELECT least(m, 8)::BIGINT AS bucket, count(*) AS entities, sum(m)::BIGINT AS links FROM ent GROUP BY 1"),
    "stride_sample": query([REC], "SELECT ord, id AS entity_id FROM (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS nth, count(*) OVER () AS total FROM rec) WHERE nth % greatest(1, total // 100) = 0"),
    "label_sample": query(
        [REC, TRUTH, _entity],
        """, chosen AS (SELECT s1_id FROM (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS nth, count(*) OVER () AS total FROM ent) WHERE nth % greatest(1, total // 50) = 0),
hits AS (SELECT DISTINCT other_id FROM truth WHERE s1_id IN (SELECT s1_id FROM chosen)),
n AS (SELECT id, row_number() OVER (ORDER BY ord) - 1 AS nth, count(*) OVER () AS total FROM rec WHERE src > 1)
SELECT id AS entity_id, 'match' AS role FROM n WHERE id IN (SELECT other_id FROM hits)
UNION ALL SELECT id, 'decoy' FROM (SELECT id FROM n WHERE nth % greatest(1, total // 20) = 0 AND id NOT IN (SELECT other_id FROM hits) ORDER BY nth LIMIT 20)""",
    ),
    "validate_rules": query([*BLOCKED, SCORES, _lines], "SELECT file, rule, CASE rule WHEN 'not_candidate' THEN 'warning' ELSE 'error' END AS severity, sum(n)::BIGINT AS n, string_agg(example, ';' ORDER BY example) FILTER (nth <= 5) AS examples FROM per GROUP BY file, rule"),
}
