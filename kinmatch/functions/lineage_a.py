"""Text functions of the key-union lineage, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.unicode import nfkc

# Legal suffixes, dropped from the end of a name only.
LEGAL_SUFFIXES = """
inc incorporated llc ltd limited corp corporation co company plc gmbh pvt pte
private limited liability partners llp srl sarl sa bv nv kg ag oy ab as pty
holdings holding group
""".split()

# Address words that are no keys.
ADDRESS_SKIP = """
road street avenue lane nagar colony block floor building shop plot near near
opposite main cross layout area sector phase extension ext road street
floor ground first second
""".split()

#: Shortest token that is a key, and length of a token's prefix key.
TOKEN_MIN, PREFIX = 4, 4
#: Words are maximal runs of these; to find them takes a tenth of the time of splitting at all others or replacing those.
WORD = "[0-9a-zऀ-ॿ]"
_SUFFIX = "(?:^| )(?:" + "|".join(sorted(set(LEGAL_SUFFIXES))) + ")"
#: Tried where a run of whole suffix words begins only, and possessive: Java then repeats in a loop, while a plain repetition recurs for every word and overflows the stack in a run of thousands.
SUFFIXES = f"(?={_SUFFIX}(?= |$))(?<!{_SUFFIX})(?:{_SUFFIX}(?= |$))++$"
NONE = "array<string>"


def plain_words(s: Column) -> Column:
    """Lower case, runs of other characters to one space, no outer space."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(f"{WORD}+"), F.lit(0)), " ")


def normalize_name(s: Column) -> Column:
    """plain_words without trailing legal suffixes; may become empty."""
    return F.regexp_replace(plain_words(s), SUFFIXES, "")


def tokens(n: Column) -> Column:
    """Distinct words in order; none for an empty string."""
    return F.when(n == "", F.array().cast(NONE)).otherwise(F.array_distinct(F.split(n, " ")))


def bound(value: Column, then) -> Column:
    """then(value), with value computed once, also where then uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _grams(s: Column, n: int) -> Column:
    """From the array of characters: substring() would walk from the start of the string for each."""
    return bound(F.split(s, ""), lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.concat(*[F.element_at(c, i + k) for k in range(n)]))))


def trigrams(s: Column) -> Column:
    """Distinct 3-grams with spaces as underscores; a shorter non-empty string is its own gram."""
    none = F.array().cast(NONE)
    return bound(F.replace(s, F.lit(" "), F.lit("_")), lambda u: F.when(F.length(u) >= 3, _grams(u, 3)).when(u != "", F.array(u)).otherwise(none))


def char4(n: Column) -> Column:
    """Distinct 4-grams; none for shorter strings."""
    return bound(n, lambda u: F.when(F.length(u) >= 4, _grams(u, 4)).otherwise(F.array().cast(NONE)))


def pins(address: Column) -> Column:
    """The first three distinct digit runs of length 5 or 6."""
    runs = F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit("[0-9]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(runs, lambda x: F.length(x).isin(5, 6))), 1, 3)


def country_code(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def address_tokens(address: Column, least: int = TOKEN_MIN) -> Column:
    """Distinct words of the lower-cased address in its compatibility form, with a letter, of at least `least` characters, without the skipped ones."""
    lettered = f"(?<!{WORD})(?=[0-9]*+{WORD}){WORD}{{{max(1, least)},}}"  # tried where a run begins only
    words = F.regexp_extract_all(nfkc(F.lower(F.coalesce(address, F.lit("")))), F.lit(lettered), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in sorted(set(ADDRESS_SKIP))]))


def address_tokens_stripped(address: Column, least: int = TOKEN_MIN) -> Column:
    """The older form: white-space words without outer punctuation, under the same filters."""
    words = F.transform(F.split(F.lower(F.coalesce(address, F.lit(""))), r"\s+"), lambda t: F.btrim(t, F.lit(".,;:()[]{}'\"-")))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= least) & t.rlike(r"\p{L}") & ~t.isin(*sorted(set(ADDRESS_SKIP)))))


def record_tokens(address: Column) -> Column:
    """The plain record form: all distinct white-space words, unfiltered."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(address, F.lit(""))), r"\s+"), lambda t: t != ""))


def token_prefixes(n: Column, k: int = PREFIX) -> Column:
    return F.array_distinct(F.transform(tokens(n), lambda t: F.substring(t, 1, k)))


def numeric_tokens(n: Column) -> Column:
    """Tokens whose first character is a digit."""
    return F.filter(tokens(n), lambda t: t.rlike("^[0-9]"))


def common_prefix_length(a: Column, b: Column) -> Column:
    """In one pass over both strings' characters."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    both = F.least(F.length(a), F.length(b))
    return F.when(both == 0, 0).when(first == 0, both).otherwise(F.least(first - 1, both)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without duplicates; two empty ones are equal (1.0)."""
    overlap = bound(F.size(F.array_intersect(a, b)), lambda k: k / (F.size(a) + F.size(b) - k))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(overlap)
