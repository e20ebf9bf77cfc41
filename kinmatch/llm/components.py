"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import clear, new_path


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for each node of edges (a, b), all longs; component is the smallest node reachable.

    Each round is written to the shared folder, which cuts the lineage; the
    one before it is deleted. Ends when a round changes nothing.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema("node long, to long").parquet(path), path

    def star(df: DataFrame, both: DataFrame, small: bool) -> DataFrame:
        """Every neighbour of a node (the larger ones, or the smaller ones and itself) links to the smallest of all."""
        least = both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("least"))
        linked = both.join(least, "node")
        if small:
            out = linked.filter("to < node").select(F.col("to").alias("node"), "least").unionByName(linked.select("node", "least"))
        else:
            out = linked.filter("to > node").select(F.col("to").alias("node"), "least")
        return out.filter("node <> least").select("node", F.col("least").alias("to")).distinct()

    turned = lambda df: df.unionByName(df.select(F.col("to").alias("node"), F.col("node").alias("to")))
    now, path = kept(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).filter("node <> to").distinct())
    before = None
    while True:
        large = star(now, turned(now), small=False)
        after, new = kept(star(large, large, small=True))
        size = after.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        clear(spark, [path])
        now, path = after, new
        if tuple(size) == before:
            break
        before = tuple(size)
    roots = now.select(F.col("to").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select("node", F.col("to").alias("component")).unionByName(roots)
