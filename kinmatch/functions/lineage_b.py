"""Text and set functions of the IDF-retrieval lineage, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.unicode import fold_latin_accents

NONE = "array<string>"
APOSTROPHES = "[’‘'`]"
SPLIT = "[^0-9a-zऀ-ൿ]+"
# Domain endings that carry no identity.
DOMAINS = "com net org co in io biz info us fr".split()
# Tried where a run of its characters begins (or the last domain ended), and once: else each letter of each word looks for a dot.
DOMAIN = r"(?:(?<![a-z0-9-])|\G)([a-z0-9-]++)\.(?:" + "|".join(DOMAINS) + r")\b"
# Words between a legal and a trade name.
TRADE_MARKS = r"\b(?:dba|d/b/a|t/a|t\\a|f/k/a|fka|a/k/a|aka)\b"
# Names and code blocks of the scripts told apart from Latin.
SCRIPTS = {
    "DEVANAGARI": ("ऀ", "ॿ"),
    "BENGALI": ("ঀ", "৿"),
    "GURMUKHI": ("਀", "੿"),
    "GUJARATI": ("઀", "૿"),
    "ORIYA": ("଀", "୿"),
    "TAMIL": ("஀", "௿"),
    "TELUGU": ("ఀ", "౿"),
    "KANNADA": ("ಀ", "೿"),
    "MALAYALAM": ("ഀ", "ൿ"),
}


def has_native_script(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike("[ऀ-ൿ]")


def dominant_script(s: Column) -> Column:
    """The script with most letters; among equals the one met first; LATIN without letters."""
    letters = F.regexp_replace(F.coalesce(s, F.lit("")), r"[^\p{L}]", "")
    options = []
    for name, (low, high) in SCRIPTS.items():
        options.append((name, F.regexp_replace(letters, f"[^{low}-{high}]", ""), f"[{low}-{high}]"))
    options.append(("LATIN", F.regexp_replace(letters, "[ऀ-ॿঀ-ൿ]", ""), "[^ऀ-ൿ]"))
    ranked = [F.struct(F.length(kept).alias("n"), (-F.length(F.regexp_extract(letters, f"^(?s)(.*?){pattern}", 1))).alias("first"), F.lit(name).alias("script")) for name, kept, pattern in options]
    best = F.array_max(F.filter(F.array(*ranked), lambda x: x["n"] > 0))
    return F.coalesce(best["script"], F.lit("LATIN"))


def split_domains(s: Column) -> Column:
    """name.tld to the name with hyphens as spaces, @handle and #handle to the handle."""
    parts, names = F.split(s, DOMAIN, -1), F.regexp_extract_all(s, F.lit(DOMAIN), F.lit(1))
    zipped = F.arrays_zip(parts.alias("p"), names.alias("n"))  # one more part than names
    spread = F.transform(zipped, lambda z: F.when(z["n"].isNotNull(), F.concat(z["p"], F.lit(" "), F.replace(z["n"], F.lit("-"), F.lit(" ")), F.lit(" "))).otherwise(z["p"]))
    return F.regexp_replace(F.array_join(spread, ""), "[@#]([a-z0-9_]+)", " $1 ")


def basic_clean(s: Column, fold: bool = True) -> Column:
    """Trim, fold Latin accents, lower case, drop apostrophes, spell out &, take domains and handles apart."""
    t = F.trim(F.coalesce(s, F.lit("")))
    t = F.lower(fold_latin_accents(t) if fold else t)
    return split_domains(F.replace(F.regexp_replace(t, APOSTROPHES, ""), F.lit("&"), F.lit(" and ")))


def tokenize(s: Column) -> Column:
    """All words, with duplicates."""
    return F.filter(F.split(s, SPLIT), lambda t: t != "")


def normalize_number(t: Column) -> Column:
    """Without the leading zeros of its digits; 0 where all are."""
    return F.regexp_replace(t, r"^0+([0-9])", "$1")


def name_tokens(s: Column, fold: bool = True) -> Column:
    return tokenize(basic_clean(s, fold))


def address_tokens(s: Column, fold: bool = True) -> Column:
    return F.transform(name_tokens(s, fold), lambda t: F.when(t.rlike("[0-9]"), normalize_number(t)).otherwise(t))


def numeric_tokens(ts: Column) -> Column:
    return F.transform(F.filter(ts, lambda t: t.rlike("[0-9]")), normalize_number)


def trade_name_variants(s: Column, fold: bool = True) -> Column:
    """The cleaned name's distinct parts around trade-name marks, and the whole, in order."""
    clean = basic_clean(s, fold)
    parts = F.filter(F.transform(F.split(clean, TRADE_MARKS), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.filter(F.concat(parts, F.array(F.trim(clean))), lambda p: p != ""))


def last_components(address: Column) -> Column:
    """struct(city, state): the tokenised last two comma components; nulls where there are fewer than two or one has no word."""
    parts = F.filter(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p) != "")
    words = lambda i: F.when(F.size(parts) >= 2, F.array_join(tokenize(F.lower(F.try_element_at(parts, F.lit(i)))), " "))
    city, state = words(-2), words(-1)
    usable = (city != "") & (state != "")
    return F.struct(F.when(usable, city).alias("city"), F.when(usable, state).alias("state"))


def source_prefix(entity_id: Column) -> Column:
    return F.substring_index(entity_id, "-", 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without duplicates; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / total)
