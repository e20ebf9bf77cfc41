"""From scored pairs to final matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def above(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.filter(F.col("score") >= threshold)


def grouped(pairs: DataFrame, order: str = "pair_ord") -> DataFrame:
    """(s1_id, matched): each source-1 record's matches as an array in pair order."""
    return pairs.groupBy("s1_id").agg(F.sort_array(F.collect_list(F.struct(order, "other_id"))).alias("m")).select("s1_id", F.transform("m", lambda x: x["other_id"]).alias("matched"))


def emitted(required: DataFrame, matched: DataFrame, ids: str = "matched_entity_ids") -> DataFrame:
    """One row per required source-1 record, in its order: ord, source1_entity_id, comma list (empty without a match)."""
    return required.select("ord", F.col("entity_id").alias("s1_id")).join(matched, "s1_id", "left").select("ord", F.col("s1_id").alias("source1_entity_id"), F.coalesce(F.array_join("matched", ","), F.lit("")).alias(ids))


def accept(scores: DataFrame, threshold: float = 0.5, best_floor: float = 0.30, most: int = 11) -> DataFrame:
    """Pairs (s1_id, s1_ord, tgt_id, score) at the threshold, at most `most` of a record; where none is, its single best if that reaches best_floor."""
    w = Window.partitionBy("s1_id").orderBy(F.desc("score"), "tgt_id")
    r = scores.withColumn("r", F.row_number().over(w))
    return r.filter(((F.col("score") >= threshold) & (F.col("r") <= most)) | ((F.col("r") == 1) & (F.col("score") >= best_floor))).drop("r")


def one_owner(accepted: DataFrame) -> DataFrame:
    """Each target stays with its highest-scoring claimer, the earlier record among equals."""
    w = Window.partitionBy("tgt_id").orderBy(F.desc("score"), "s1_ord")
    return accepted.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
