"""Macro F0.5, threshold sweeps and blocking recall, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.sources.records import numbered

GATES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12)


def f_half(m: Column, k: Column, t: Column) -> Column:
    """Of one entity with m true, k predicted and t right matches."""
    return F.when((m == 0) & (k == 0), 1.0).when((m == 0) | (k == 0), 0.0).otherwise(1.25 * t / (0.25 * m + k))


def entity_counts(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1_id, m, k, t) for every entity (s1_id); truth and predicted are (s1_id, other_id) sets. One union and one aggregation, no join of lists."""
    rows = truth.select("s1_id", "other_id", F.lit(1).alias("m"), F.lit(0).alias("k")).unionByName(predicted.select("s1_id", "other_id", F.lit(0).alias("m"), F.lit(1).alias("k")))
    pairs = rows.groupBy("s1_id", "other_id").agg(F.max("m").alias("m"), F.max("k").alias("k"))
    counts = pairs.groupBy("s1_id").agg(F.sum("m").alias("m"), F.sum("k").alias("k"), F.sum(F.col("m") * F.col("k")).alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entities.select("s1_id").join(counts, "s1_id", "left").select("s1_id", zero("m"), zero("k"), zero("t"))


def macro_f_half(counts: DataFrame) -> DataFrame:
    return counts.agg(F.avg(f_half(F.col("m"), F.col("k"), F.col("t"))).alias("macro_f05"), F.avg((F.col("m") == 0).cast("double")).alias("empty_floor"), F.count("*").alias("n"))


def error_breakdown(counts: DataFrame) -> DataFrame:
    m, k, t = F.col("m"), F.col("k"), F.col("t")
    return counts.agg(F.count_if(m == 0).alias("singletons"), F.count_if((m == k) & (k == t)).alias("perfect"), F.count_if((m == 0) & (k > 0)).alias("false_merge"), F.count_if((m > 0) & (k == 0)).alias("missed"))


def percentiles(rows: DataFrame, column: str, parts: int = 100) -> DataFrame:
    """(share, value): the exact percentiles 0 to `parts` of a column, with linear interpolation. Ranges are sorted in parallel, and only the rows at the wanted places, two a percentile, meet."""
    n = numbered(rows.select(F.col(column).cast("double").alias("v")).filter("v is not null"), "v")
    at = F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: i / F.lit(parts) * (F.col("total") - 1))
    wanted = F.filter(F.transform(at, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: (F.floor(p["x"]) == F.col("nth")) | (F.ceil(p["x"]) == F.col("nth")))
    ends = n.select("nth", "v", F.explode(wanted).alias("p")).groupBy(F.col("p.i").alias("i"), F.col("p.x").alias("x")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ends.select((F.col("i") / parts).alias("share"), (F.col("low") + (F.col("high") - F.col("low")) * (F.col("x") - F.floor("x"))).alias("value"))


def threshold_sweep(entities: DataFrame, truth: DataFrame, scores: DataFrame) -> DataFrame:
    """(threshold, macro_f05) at the distinct rounded percentiles of scores (s1_id, other_id, score).

    A pair counts for each of the 101 thresholds at most that it reaches, and
    pairs add up per entity and threshold before they are averaged; entities
    without a scored pair enter through their number alone.
    """
    cuts = percentiles(scores, "score").agg(F.array_sort(F.collect_set(F.round("value", 4))).alias("cuts"))
    known = truth.select("s1_id", "other_id").distinct().withColumn("y", F.lit(1))
    rows = scores.join(known, ["s1_id", "other_id"], "left").select("s1_id", "score", F.coalesce("y", F.lit(0)).alias("y"))
    reached = rows.join(F.broadcast(cuts), F.lit(True)).select("s1_id", "y", F.explode(F.filter("cuts", lambda c: c <= F.col("score"))).alias("threshold"))
    per = reached.groupBy("threshold", "s1_id").agg(F.count("*").alias("k"), F.sum("y").alias("t"))
    m = entities.select("s1_id").join(truth.select("s1_id", "other_id").distinct().groupBy("s1_id").agg(F.count("*").alias("m")), "s1_id", "left").select("s1_id", F.coalesce("m", F.lit(0)).alias("m"))
    all_ = m.agg(F.count("*").alias("n"), F.count_if(F.col("m") == 0).alias("empty"))
    got = per.join(m, "s1_id").groupBy("threshold").agg(F.sum(f_half(F.col("m"), F.col("k"), F.col("t"))).alias("points"), F.count_if(F.col("m") == 0).alias("spoiled"))
    return got.join(F.broadcast(all_), F.lit(True)).select("threshold", ((F.col("points") + F.col("empty") - F.col("spoiled")) / F.col("n")).alias("macro_f05"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold with the best score."""
    return sweep.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def window_truth(truth: DataFrame, s1_ids: DataFrame, other_ids: DataFrame) -> DataFrame:
    """Known links with both ends in the window (one id column each)."""
    return truth.join(s1_ids, "s1_id", "left_semi").join(other_ids, "other_id", "left_semi").distinct()


def best_evidence(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("s1_id", "other_id").agg(F.max("score").alias("score"))


def blocking_recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links known, links found among pairs, recall and the ceiling of the score that it leaves."""
    found = truth.join(pairs.select("s1_id", "other_id").distinct().withColumn("found", F.lit(1)), ["s1_id", "other_id"], "left")
    out = found.agg(F.count("*").alias("known"), F.count("found").alias("found"))
    recall = F.when(F.col("known") > 0, F.col("found") / F.col("known"))
    return out.withColumn("recall", recall).withColumn("ceiling", 1.25 * F.col("recall") / (0.25 + F.col("recall")))


def recall_curve(truth: DataFrame, best: DataFrame, others: int, gates: tuple = GATES) -> DataFrame:
    """For each gate: links found, recall, lost, pairs kept and pairs per probe record. One pass: each pair counts for the gates it reaches."""
    rows = best.withColumn("is_pair", F.lit(1)).join(truth.select("s1_id", "other_id").distinct().withColumn("known", F.lit(1)), ["s1_id", "other_id"], "full")
    agg = rows.agg(F.count("known").alias("known"), *[F.count_if(F.col("score") >= g).alias(f"p{g}") for g in gates], *[F.count_if((F.col("score") >= g) & F.col("known").isNotNull()).alias(f"h{g}") for g in gates])
    long = agg.select("known", F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"p{g}").alias("pairs"), F.col(f"h{g}").alias("hit")) for g in gates])).alias("x")).select("known", "x.*")
    return long.select("gate", F.when(F.col("known") > 0, F.col("hit") / F.col("known")).otherwise(0.0).alias("recall"), (F.col("known") - F.col("hit")).alias("lost"), "pairs", (F.col("pairs") / F.lit(max(1, others))).alias("pairs_per_other"))


def entity_retention(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Micro link recall, and the share of entities all of whose links were retrieved."""
    hits = truth.join(pairs.select("s1_id", "other_id").distinct().withColumn("found", F.lit(1)), ["s1_id", "other_id"], "left")
    per = hits.groupBy("s1_id").agg(F.count("*").alias("m"), F.count("found").alias("hit"))
    return per.agg(F.sum("m").alias("links"), F.sum("hit").alias("found"), (F.sum("hit") / F.sum("m")).alias("link_recall"), F.avg((F.col("m") == F.col("hit")).cast("double")).alias("all_retained"))
