"""Personal data by proposed spans and boosted trees, as Spark expressions only.

Base spans come from fixed patterns and checks. High-recall generators then
propose further spans (spelled-out e-mail addresses, national telephone forms,
card numbers in odd groups or with a digit wrong); boosted trees over format
and context features score each, and those above a calibrated threshold that
overlap no base span are added. The trees are fitted on the driver to labelled
strings that Spark makes itself from templates (a bounded, fixed number), and
become CASE expressions, so the main path holds no Python, Arrow or RDD code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import given_id, plain

KINDS = ["email", "ip", "card", "phone"]

# The patterns below match what the plain ones in comments match, leftmost first and without overlap. Possessive
# loops and the conditions on what stands before keep them linear in a text of any length; \G is a match's end.
_LOCAL = "A-Za-z0-9._%+-"
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A stretch of digits, spaces and hyphens that may hold matches of [0-9]([\x20-]?[0-9])+ with 13 digits or more; it is cut where two separators meet.
CARD_STRETCH, CARD_CUT = r"[0-9][0-9\x20-]{11,}[0-9]", r"[\x20-]{2,}"

#: Kind and pattern of what is proposed beyond the base.
GENERATORS = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{4}){2}[\x20./_-]{1,3}[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}[\x20./-]{0,2})?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,8}){1,4}(?![0-9A-Za-z])",
}
CONTEXT = 24
#: What stands in the CONTEXT code points around a span.
HINTS = {
    "email": r"(?i)mail|contact|write|reach|address|kontakt|courriel|correo|@",
    "card": r"(?i)card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta|expir|cvv",
    "phone": r"(?i)tel|phone|call|mobile|fax|cell|sms|whatsapp|anruf|handy|appel|llama|ring",
}
AGAINST = r"(?i)order|invoice|isbn|version|page|date|price|serial|\bid\b|build|total|score|room|table|year|\$|€|£"


def let(value: Column, then) -> Column:
    """then(value), with value computed once, also where then uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def prefix_sums(lengths: Column) -> Column:
    """The sum of all elements before each, in blocks, so that even 100,000 of them cost little. lengths: a bound variable."""
    block = 256
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))
    part = lambda b: F.slice(lengths, b * block + 1, block)

    def placed(sums: Column) -> Column:
        before = F.transform(starts, lambda b: total(F.slice(sums, F.lit(1), b)))
        return F.flatten(F.zip_with(starts, before, lambda b, t: let(part(b), lambda ls: F.transform(ls, lambda x, i: t + total(F.slice(ls, F.lit(1), i))))))

    return F.when(F.size(lengths) > 0, let(F.transform(starts, lambda b: total(part(b))), placed)).otherwise(F.array().cast("array<int>"))


def _placed(pairs: Column, base: Column) -> Column:
    """array<struct<s,e,t>> of pairs of texts: b comes before t, and all follow one another from base on."""

    def of(ps: Column) -> Column:
        lengths = F.transform(ps, lambda z: F.length(z["b"]) + F.length(z["t"]))
        ends = let(lengths, lambda ls: F.zip_with(ps, prefix_sums(ls), lambda z, p: F.struct((base + p + F.length(z["b"])).alias("s"), z["t"].alias("t"))))
        return F.transform(ends, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["t"])).alias("e"), x["t"].alias("t")))

    return let(pairs, of)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s,e,t>> of a pattern's matches: start, end (code points) and text. Positions are sums of the lengths of what lies between and of the matches."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return _placed(F.filter(F.arrays_zip(between.alias("b"), found.alias("t")), lambda z: z["t"].isNotNull()), F.lit(0))


def pieces(spans: Column, cut: str) -> Column:
    """Each span cut at a pattern into spans of its own."""

    def of(x: Column) -> Column:
        parts, cuts = F.split(x["t"], cut, -1), F.concat(F.array(F.lit("")), F.regexp_extract_all(x["t"], F.lit(cut), F.lit(0)))
        return _placed(F.arrays_zip(cuts.alias("b"), parts.alias("t")), x["s"])

    return F.flatten(F.transform(spans, of))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * (1 + i % 2)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda s, x: s + x) % 10 == 0


def is_card(text: Column) -> Column:
    return F.length(digits(text)).between(13, 19) & luhn(F.when(F.length(digits(text)).between(13, 19), digits(text)).otherwise("0"))


def is_ip(text: Column) -> Column:
    """Whether all parts are 255 at most, whatever their length."""
    short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(text, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.substring(short(p), 1, 3).cast("int") <= 255))


def _where(text: Column, needed: str, spans: Column) -> Column:
    """spans, where the text has what every match needs at all."""
    return F.when(text.rlike(needed), spans).otherwise(F.array().cast("array<struct<s:int,e:int,t:string>>"))


def base_spans(text: Column) -> dict[str, Column]:
    """Each kind's matches that pass its check."""
    return {
        "email": _where(text, "@", matches(text, EMAIL)),
        "ip": _where(text, r"[0-9]\.[0-9]", F.filter(matches(text, IP), lambda x: is_ip(x["t"]))),
        "card": _where(text, CARD_STRETCH, F.filter(pieces(matches(text, CARD_STRETCH), CARD_CUT), lambda x: is_card(x["t"]))),
        "phone": _where(text, r"\+[0-9]", F.filter(matches(text, PHONE), lambda x: F.length(digits(x["t"])).between(9, 15))),
    }


FEATURES = ["digits", "length", "groups", "luhn", "issuer", "brackets", "zero", "hint", "against", "email_marks", "dotted", "tld", "digit_near", "word_after", "even"]


def features(text: Column, kind: str, x: Column) -> Column:
    """array<double> of format and context features of a span."""
    t, d = x["t"], digits(x["t"])
    before = F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
    after = F.substring(text, x["e"] + 1, F.lit(CONTEXT))
    number = F.when(F.length(d).between(13, 19), d).otherwise("1")
    groups = F.filter(F.split(t, "[^0-9]+"), lambda g: g != "")
    flags = [
        F.length(d),
        F.length(t),
        F.size(groups),
        luhn(number),
        t.rlike("^[3-6]"),
        t.rlike(r"[()\[\]{}]"),
        t.rlike(r"^\(?0"),
        before.rlike(HINTS[kind]) | F.substring(after, 1, 8).rlike(HINTS[kind]),
        before.rlike(AGAINST) | F.substring(after, 1, 3).rlike("[€$£%]"),
        t.rlike(r"(?i)[(\[{]at[)\]}]"),
        t.rlike(r"(?i)[(\[{]dot[)\]}]|\x20dot\x20"),
        t.rlike(r"(?i)(?:\.|dot[)\]}]?\x20?)(com|org|net|edu|gov|de|fr|es|uk|io|info)$"),
        before.rlike(r"[0-9][\x20.,/-]*$") | after.rlike(r"^[\x20.,/-]*[0-9]"),
        after.rlike(r"^\x20?[a-z]"),
        F.size(F.array_distinct(F.transform(groups, F.length))) == 1,
    ]
    return F.array(*[f.cast("double") for f in flags])


# The trees.


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


def grow(x: np.ndarray, gradient: np.ndarray, curve: np.ndarray, depth: int, ridge: float = 1.0) -> Leaf | Split:
    """A regression tree for one Newton step of the logistic loss."""
    score = lambda g, c: g * g / (c + ridge)
    whole = score(gradient.sum(), curve.sum())
    best = (1e-6, None, None)
    for k in range(x.shape[1]) if depth else ():
        order = np.argsort(x[:, k], kind="stable")
        v, g, c = x[order, k], np.cumsum(gradient[order]), np.cumsum(curve[order])
        edge = np.flatnonzero(v[1:] > v[:-1])
        if len(edge):
            gain = score(g[edge], c[edge]) + score(g[-1] - g[edge], c[-1] - c[edge]) - whole
            if gain.max() > best[0]:
                i = edge[gain.argmax()]
                best = (gain.max(), k, (v[i] + v[i + 1]) / 2)
    if best[1] is None:
        return Leaf(float(gradient.sum() / (curve.sum() + ridge)))
    low = x[:, best[1]] <= best[2]
    return Split(best[1], float(best[2]), grow(x[low], gradient[low], curve[low], depth - 1), grow(x[~low], gradient[~low], curve[~low], depth - 1))


def outputs(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, outputs(tree.low, x), outputs(tree.high, x))


def expression(tree: Leaf | Split, f: Column) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(F.element_at(f, tree.feature + 1) <= tree.at, expression(tree.low, f)).otherwise(expression(tree.high, f))


@dataclass(frozen=True)
class Boosted:
    trees: tuple
    rate: float
    start: float
    threshold: float  # on the log odds
    recall: float  # of right proposals, and precision, on templates not learned from
    precision: float

    def margin(self, f: Column) -> Column:
        return sum((self.rate * expression(t, f) for t in self.trees), F.lit(self.start))


def grown(x: np.ndarray, y: np.ndarray, learn: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> tuple[tuple, float, float, np.ndarray]:
    """Trees fitted to the rows that learn, their rate and start, and all rows' log odds."""
    start = float(np.log((y[learn].mean() + 1e-3) / (1 - y[learn].mean() + 1e-3)))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin[learn]))
        trees.append(grow(x[learn], y[learn] - p, p * (1 - p), depth))
        margin += rate * outputs(trees[-1], x)
    return tuple(trees), rate, start, margin


def boost(x: np.ndarray, y: np.ndarray, template: np.ndarray, precision: float) -> Boosted:
    """Trees fitted to four fifths; the threshold is the lowest with the wanted precision on the rest, and at least even odds. The recall and precision stated are those at this threshold of trees that have not seen the templates they judge."""
    rest = np.arange(len(y)) % 5 == 0
    trees, rate, start, margin = grown(x, y, ~rest)
    held, truth = margin[rest], y[rest]
    order = np.argsort(-held, kind="stable")
    right = np.cumsum(truth[order]) / (np.arange(len(order)) + 1)
    good = np.flatnonzero(right >= precision)
    threshold = max(0.0, float(held[order][good[-1]])) if len(good) else float("inf")
    odds = np.zeros(len(y))
    for k in range(FOLDS):
        unseen = template % FOLDS == k
        odds[unseen] = grown(x, y, ~unseen)[3][unseen]
    taken = odds >= threshold
    return Boosted(trees, rate, start, threshold, float(y[taken].sum() / max(1, y.sum())), float(y[taken].mean()) if taken.any() else 1.0)


#: Strings made for each kind, and the share of right ones that a threshold must reach on strings kept aside.
MADE, PRECISION = 4000, 0.995
#: Each fifth of the templates is judged by trees fitted to the others.
FOLDS = 5

# Fixed templates; # is any digit, N one from 2 to 9, W a word. The first list of a kind holds personal data, the second doesn't.
TEMPLATES = {
    "email": (
        ["write to W.W (at) W (dot) com", "contact W##[at]W.com now", "mail W at W dot org", "e-mail: W (at) W.de", "reach me: W_W [at] W [dot] net", "W{at}W{dot}com"],
        ["we met at W.\nThen", "look at W.W is", "stay at W.es W", "W at W. It", "he was at W dot W", "she arrived at W.W of", "W at W . W", "sold at W.## each"],
    ),
    "card": (
        ["card N### #### #### ####", "visa: 4###-####-####-####", "credit card 5###.####.####.####", "payment N###  ####  ####  #### exp", "debit 4###/####/####/####"],
        ["order #### #### #### ####", "serial ####-####-####-####", "values #### #### #### ## of", "years 19## 19## 20## 20## and", "#### #### #### #### #### ####", "invoice ####.####.####.#"],
    ),
    "phone": (
        ["call (N##) N##-####", "tel. N##-N##-####", "phone: 0##/#######", "mobile 0##-### ####", "fax (0##) ### ## ##", "tel 00N# ### ######", "tel. 0# ## ## ## ##", "call 0N## ### ###", "N##-N##-#### W", "(N##) N##-####"],
        ["on 20##-##-## W", "pages ###-### of", "price ##.## and", "version #.##.# W", "in 19##-20## W", "order ###-#######", "about ## ### W", "##/##/20## W", "room ##-## W", "serial ####-####", "id ## ## ## W", "W ###.## W", "isbn ###-#-####", "## ## W", "total ### ### ###"],
    ),
}


def _made(spark: SparkSession, kind: str) -> DataFrame:
    """(text, label, template's number, n) of MADE strings from the kind's templates, with words of syllables around; all by hashes of their number."""
    good, bad = TEMPLATES[kind]
    parts = "an er the on sh re in ti ver lo que mo ka li do su ment aire ung".split()
    syllables = F.array(*map(F.lit, parts))
    pick = lambda array, n, *salt: F.element_at(array, (F.pmod(F.xxhash64("n", *[F.lit(s) if isinstance(s, str) else s for s in salt]), F.lit(n)) + 1).cast("int"))
    word = lambda salt, i: F.concat(*[pick(syllables, len(parts), f"{salt}{k}", i) for k in "abc"])
    label = F.col("n") % 2
    number = F.when(label == 1, pick(F.sequence(F.lit(0), F.lit(len(good) - 1)), len(good), "t")).otherwise(pick(F.sequence(F.lit(0), F.lit(len(bad) - 1)), len(bad), "t") + len(good))
    template = F.element_at(F.array(*map(F.lit, good + bad)), F.col("number") + 1)
    filled = F.array_join(
        F.transform(F.split("template", ""), lambda c, i: F.when(c == "#", F.pmod(F.xxhash64("n", i), F.lit(10)).cast("string")).when(c == "N", (F.pmod(F.xxhash64("n", i), F.lit(8)) + 2).cast("string")).when(c == "W", word("w", i)).otherwise(c)), ""
    )
    around = lambda salt: F.concat_ws(" ", word(salt + "x", F.lit(0)), word(salt + "y", F.lit(0)))
    return spark.range(MADE).select(F.col("id").alias("n")).select("n", label.alias("label"), number.alias("number")).select("n", "label", "number", template.alias("template")).select("n", "label", "number", F.concat_ws(" ", around("l"), filled, around("r")).alias("text"))


@lru_cache(maxsize=4)
def models(spark: SparkSession, precision: float = PRECISION) -> dict[str, Boosted]:
    """A model a kind. At most MADE rows of features a kind come to the driver."""
    out = {}
    for k, (kind, pattern) in enumerate(GENERATORS.items()):
        text = F.col("text")
        spans = _made(spark, kind).select("n", "label", "number", "text", F.explode(matches(text, pattern)).alias("x"))
        rows = spans.select("n", "label", "number", features(text, kind, F.col("x")).alias("f")).orderBy("n", F.col("x.s")).limit(2 * MADE).collect()
        x, y = np.array([r.f for r in rows]), np.array([float(r.label) for r in rows])
        out[kind] = boost(x, y, np.array([r.number for r in rows]), precision)
    return out


def added_spans(text: Column, base: Column, fitted: dict[str, Boosted]) -> dict[str, Column]:
    """Proposals that the trees accept and that overlap no base span (array<struct<s,e>>)."""
    needed = {"email": r"(?i)[(\[{]at[)\]}]|\x20at\x20", "card": r"[0-9]{4}[\x20./_-]{1,3}[0-9]{4}[\x20./_-]{1,3}[0-9]{4}", "phone": r"[0-9]{2}\)?[\x20./-]{1,2}[0-9]{2}"}

    def accepted(kind: str) -> Column:
        proposals = F.filter(matches(text, GENERATORS[kind]), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        scored = F.transform(proposals, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), features(text, kind, x).alias("f")))
        return F.filter(scored, lambda x: fitted[kind].margin(x["f"]) >= fitted[kind].threshold)

    empty = F.array().cast("array<struct<s:int,e:int,t:string>>")
    return {kind: F.when(text.rlike(needed[kind]), F.transform(accepted(kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))).otherwise(empty) for kind in GENERATORS}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, base and found: arrays of (kind, s, e) in code points, by kind and start; found holds base.

    Added spans overlap no base span; where two of different kinds overlap, both
    stay. A null or empty text has no spans; repeated rows are searched one by
    one; an empty table gives no rows.
    """
    fitted = models(docs.sparkSession)
    rows = plain(docs, id_col, text_col)
    text = F.col("txt")
    rows = rows.select("did", "txt", *[c.alias(k) for k, c in base_spans(text).items()])
    rows = rows.withColumn("all_base", F.concat(*[F.col(k) for k in KINDS]))
    rows = rows.select("*", *[c.alias(f"more_{k}") for k, c in added_spans(text, F.col("all_base"), fitted).items()])
    tagged = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    every = {k: F.array_sort(F.concat(F.col(k), F.col(f"more_{k}"))) if k in GENERATORS else F.col(k) for k in KINDS}
    return rows.select(given_id().alias("doc_id"), text.alias("text"), F.concat(*[tagged(F.col(k), k) for k in KINDS]).alias("base"), F.concat(*[tagged(every[k], k) for k in KINDS]).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(found: DataFrame, mask: str = "[{}]") -> DataFrame:
    """find_pii's rows as doc_id and text, each span (or union of overlapping spans) replaced by its kind."""
    ordered = F.array_sort(F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    before, after = mask.split("{}")

    def step(acc: Column, x: Column) -> Column:
        out = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit(before), x["kind"], F.lit(after))
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), out.alias("out")))

    return found.select("doc_id", F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))).alias("text"))
