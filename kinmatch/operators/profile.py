"""Profiles and label-preserving samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.sources.records import numbered


def profile_source(records: DataFrame) -> DataFrame:
    """One row: counts, blank shares, length percentiles and non-ASCII share, in a single aggregation over all rows."""
    name, address = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    share = lambda c: F.avg(c.cast("double"))
    lengths = [F.percentile(F.length(c), F.lit(q)).alias(f"{k}_p{int(q * 100)}") for k, c in (("name", name), ("address", address)) for q in (0.1, 0.5, 0.9, 1.0)]
    return records.agg(F.count("*").alias("n_rows"), share(F.trim(name) == "").alias("blank_name"), share(F.trim(address) == "").alias("blank_address"), share(name.rlike("[^\\x00-\\x7F]")).alias("non_ascii_name"), *lengths)


def top_countries(records: DataFrame, k: int = 8) -> DataFrame:
    """The report's k most frequent countries with their share."""
    counts = records.groupBy("country").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(records.agg(F.count("*").alias("total"))), F.lit(True)).select("country", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "country").limit(k)


def profile_truth(per_entity: DataFrame) -> DataFrame:
    """(bucket, entities, links) for entities (s1_id, m): buckets 0 (singletons) to 7, and 8 for more."""
    return per_entity.groupBy(F.least("m", F.lit(8)).alias("bucket")).agg(F.count("*").alias("entities"), F.sum("m").alias("links"))


def stride(total: Column, target: int) -> Column:
    return F.greatest(F.lit(1), F.floor(total / max(1, target)))


def stride_sample(rows: DataFrame, target: int, order: str = "ord") -> DataFrame:
    """Every k-th row for about `target` rows (a sampling operator)."""
    return numbered(rows, order).filter(F.col("nth") % stride(F.col("total"), target) == 0).drop("nth", "total")


def only_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "entity_id", "left_semi")


def sample_truth(per_entity: DataFrame, target: int, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Strided truth rows (s1_id, ids, ord), and the distinct ids that they match."""
    chosen = stride_sample(per_entity, target, order)
    return chosen, chosen.select(F.explode("ids").alias("entity_id")).distinct()


def sample_source(rows: DataFrame, keep: DataFrame, decoys: int, order: str = "ord") -> DataFrame:
    """All rows whose entity_id is in keep, and strided others, the first `decoys` of them; column role tells which."""
    n = numbered(rows, order).join(keep.select("entity_id").distinct().withColumn("hit", F.lit(1)), "entity_id", "left")
    hits = n.filter("hit is not null").withColumn("role", F.lit("match"))
    others = n.filter((F.col("hit").isNull()) & (F.col("nth") % stride(F.col("total"), decoys) == 0)).orderBy("nth").limit(decoys).withColumn("role", F.lit("decoy"))
    return hits.unionByName(others).drop("nth", "total", "hit")
