"""Similarity features of candidate pairs, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions import fuzzy
from kinmatch.functions import lineage_a as A
from kinmatch.functions import lineage_b as B
from kinmatch.operators.state_maps import canonical_state


def _flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


def pair_features_a(l: Column, r: Column, grams: tuple[Column, Column], prefixes: tuple[Column, Column]) -> dict[str, Column]:  # noqa: E741
    """The 20 features of two light records, in the trained order. grams, prefixes: columns of both names' trigrams and token prefixes, each used several times."""
    n1, n2, t1, t2 = l["n"], r["n"], l["toks"], r["toks"]
    l1, l2 = F.length(n1), F.length(n2)
    shortest, longest = F.least(l1, l2), F.greatest(l1, l2)
    few, many = F.least(F.size(t1), F.size(t2)), F.greatest(F.size(t1), F.size(t2))
    shared = F.size(F.array_intersect(t1, t2))
    a_few, a_many = F.least(F.size(l["atok"]), F.size(r["atok"])), F.greatest(F.size(l["atok"]), F.size(r["atok"]))
    numbered = lambda a: F.filter(a, lambda t: t.rlike("^[0-9]"))
    edge = lambda n, i: F.element_at(F.split(n, " "), i)
    both = few > 0
    return {
        "name_exact": _flag((n1 == n2) & (n1 != "")),
        "name_jacc": A.jaccard(t1, t2),
        "name_tri": A.jaccard(*grams),
        "name_pre3": _flag((l1 >= 3) & (F.substring(n1, 1, 3) == F.substring(n2, 1, 3))),
        "addr_jacc": A.jaccard(l["atok"], r["atok"]),
        "pin_eq": _flag(F.arrays_overlap(l["pins"], r["pins"])),
        "country_eq": _flag(F.lower(l["c"]) == F.lower(r["c"])),
        "len_ratio": F.when(longest == 0, 1.0).otherwise(shortest / longest),
        "tok_contain": F.when(few == 0, 0.0).otherwise(shared / few),
        "sig_eq": _flag(both & (shared == many)),
        "first_tok_eq": _flag(both & (edge(n1, 1) == edge(n2, 1))),
        "last_tok_eq": _flag(both & (edge(n1, -1) == edge(n2, -1))),
        "lcp_ratio": F.when(longest == 0, 1.0).otherwise(A.common_prefix_length(n1, n2) / longest),
        "num_tok_jacc": A.jaccard(numbered(t1), numbered(t2)),
        "addr_num_eq": _flag(F.arrays_overlap(numbered(l["atok"]), numbered(r["atok"]))),
        "sub_str": _flag((n1 != "") & (n2 != "") & (F.contains(n1, n2) | F.contains(n2, n1))),
        "min_len_log": F.when(longest == 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(shortest) / 5.0)),
        "addr_len_ratio": F.when(a_many == 0, 1.0).otherwise(a_few / a_many),
        "tok_min_log": F.when(many == 0, 0.0).otherwise(F.least(F.lit(1.0), few / 6.0)),
        "tok_pre4_jacc": A.jaccard(*prefixes),
    }


# The first lineage's features, in the order that models are trained in.
FEATURES_A = "name_exact name_jacc name_tri name_pre3 addr_jacc pin_eq country_eq len_ratio tok_contain sig_eq first_tok_eq last_tok_eq lcp_ratio num_tok_jacc addr_num_eq sub_str min_len_log addr_len_ratio tok_min_log tok_pre4_jacc".split()


def with_features_a(pairs: DataFrame) -> DataFrame:
    """Pairs (with sides l and r) and their 20 features."""
    once = pairs.withColumns({"_g1": A.trigrams(F.col("l.n")), "_g2": A.trigrams(F.col("r.n")), "_p1": A.token_prefixes(F.col("l.n")), "_p2": A.token_prefixes(F.col("r.n"))})
    features = pair_features_a(F.col("l"), F.col("r"), (F.col("_g1"), F.col("_g2")), (F.col("_p1"), F.col("_p2")))
    return once.select("*", *[c.cast("double").alias(k) for k, c in features.items()]).drop("l", "r", "_g1", "_g2", "_p1", "_p2")


def records_b(records: DataFrame, fold: bool = True, clusters: DataFrame | None = None) -> DataFrame:
    """entity_id, src, country and what the second lineage compares: nt, at, num, state (by its name in the state maps), script, name, no_address."""
    state = F.coalesce(B.last_components(F.col("business_address"))["state"], F.lit(""))
    records = records.withColumn("state", state) if clusters is None else canonical_state(records, clusters)
    name, address = F.col("business_name"), F.col("business_address")
    at = B.address_tokens(address, fold)
    return records.select(
        "entity_id", "ord", "src", "country", F.array_distinct(B.name_tokens(name, fold)).alias("nt"), F.array_distinct(at).alias("at"), F.array_distinct(B.numeric_tokens(at)).alias("num"),
        "state", B.dominant_script(name).alias("script"), B.basic_clean(name, fold).alias("name"), (F.trim(F.coalesce(address, F.lit(""))) == "").alias("no_address"),
    )


# The second lineage's features that are expressions, and the three fuzzy ones.
FEATURES_B = "name_jaccard name_containment name_dice name_exact addr_jaccard addr_containment addr_dice num_overlap num_contradict state_agree script_match either_native tgt_addr_empty max_shared_name_idf max_shared_addr_idf n_shared_name n_shared_addr block_score block_rank is_s3".split()
FUZZY_B = "name_token_set_ratio name_partial_ratio addr_token_set_ratio".split()


def with_features_b(pairs: DataFrame, records: DataFrame, idf: DataFrame, fuzzy_ratios: bool = True, truth: DataFrame | None = None) -> DataFrame:
    """Retrieved pairs (s1_id, tgt_id, rank, block_score) with the 23 features, and with truth (s1_id, other_id) their label; pairs with an unknown side are dropped.

    pairs and records are used several times, so they should be stored tables.

    The highest shared IDF comes from exploding shared tokens and joining the
    vocabulary, so the vocabulary is never carried with the pairs.
    """
    fields = ["nt", "at", "num", "state", "script", "name", "no_address"]
    side = lambda key, name: records.select(F.col("entity_id").alias(key), F.struct(*fields).alias(name))
    both = pairs.join(side("s1_id", "l"), "s1_id").join(side("tgt_id", "r"), "tgt_id")
    both = both.withColumns({"sn": F.array_intersect("l.nt", "r.nt"), "sa": F.array_intersect("l.at", "r.at")})
    shared = both.select("s1_id", "tgt_id", F.explode(F.concat(F.transform("sn", lambda t: F.struct(F.lit("n").alias("kind"), t.alias("token"))), F.transform("sa", lambda t: F.struct(F.lit("a").alias("kind"), t.alias("token"))))).alias("x"))
    best = shared.select("s1_id", "tgt_id", "x.kind", "x.token").join(idf.select("token", "idf"), "token").groupBy("s1_id", "tgt_id").agg(F.max(F.when(F.col("kind") == "n", F.col("idf"))).alias("bn"), F.max(F.when(F.col("kind") == "a", F.col("idf"))).alias("ba"))
    both = both.join(best, ["s1_id", "tgt_id"], "left")
    l, r = F.col("l"), F.col("r")  # noqa: E741
    n_shared = F.size(F.array_intersect(l["num"], r["num"]))
    columns = {
        "name_jaccard": B.jaccard(l["nt"], r["nt"]), "name_containment": B.containment(l["nt"], r["nt"]), "name_dice": B.dice(l["nt"], r["nt"]), "name_exact": _flag((l["name"] != "") & (l["name"] == r["name"])),
        "addr_jaccard": B.jaccard(l["at"], r["at"]), "addr_containment": B.containment(l["at"], r["at"]), "addr_dice": B.dice(l["at"], r["at"]),
        "num_overlap": B.jaccard(l["num"], r["num"]), "num_contradict": _flag((F.size(l["num"]) > 0) & (F.size(r["num"]) > 0) & (n_shared == 0)), "state_agree": _flag((l["state"] != "") & (l["state"] == r["state"])),
        "script_match": _flag(l["script"] == r["script"]), "either_native": _flag((l["script"] != "LATIN") | (r["script"] != "LATIN")), "tgt_addr_empty": _flag(r["no_address"]),
        "max_shared_name_idf": F.coalesce("bn", F.lit(0.0)), "max_shared_addr_idf": F.coalesce("ba", F.lit(0.0)), "n_shared_name": F.size("sn"), "n_shared_addr": F.size("sa"),
        "block_score_f": F.col("block_score"), "block_rank": F.col("rank"), "is_s3": _flag(F.col("tgt_id").startswith("S3-")),
    }
    if fuzzy_ratios:
        joined = lambda a: F.array_join(F.array_sort(a), " ")
        columns |= {"name_token_set_ratio": fuzzy.token_set_column(l["name"], r["name"]), "name_partial_ratio": fuzzy.partial_column(l["name"], r["name"]), "addr_token_set_ratio": fuzzy.token_set_column(joined(l["at"]), joined(r["at"]))}
    out = both.select("s1_id", "tgt_id", *[c.cast("double").alias(k.removesuffix("_f")) for k, c in columns.items()])
    if truth is None:
        return out
    known = truth.select("s1_id", F.col("other_id").alias("tgt_id")).distinct().withColumn("label", F.lit(1))
    return out.join(known, ["s1_id", "tgt_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
