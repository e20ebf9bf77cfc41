"""Surface forms of states, clustered by the cities they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import lineage_b as B
from kinmatch.sources.settled import shared_dir

MOST_SURFACES, MOST_OF_CITY, SHARED = 201, 50, 2


def surface_counts(records: DataFrame) -> DataFrame:
    """(country, state, city, n) of addresses whose last two comma components are words."""
    x = B.last_components(F.col("business_address"))
    rows = records.select("country", "ord", x["state"].alias("state"), x["city"].alias("city")).filter("state is not null")
    return rows.groupBy("country", "state", "city").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def state_clusters(counts: DataFrame, shared: int = SHARED) -> DataFrame:
    """(country, surface, canon, support): surfaces linked by `shared` cities or more form a cluster, named by its best-supported member (ties by name).

    Only surfaces as well supported as the 201st of their country (and `shared`
    times) take part, at most 50 of a city, so the graph stays small whatever
    the input; the others stand for themselves. Labels spread over links until
    nothing changes; each round starts from the surfaces kept by checkpoint().
    """
    if counts.sparkSession.sparkContext.getCheckpointDir() is None:
        counts.sparkSession.sparkContext.setCheckpointDir(shared_dir(counts.sparkSession))
    support = counts.groupBy("country", "state").agg(F.sum("n").alias("support"))
    nth = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("support"), "state"))
    least = support.withColumn("nth", nth).filter(F.col("nth") <= MOST_SURFACES).groupBy("country").agg(F.greatest(F.lit(shared), F.min("support")).alias("least"))
    eligible = support.join(least, "country").filter("support >= least").select("country", "state")
    of_city = F.row_number().over(Window.partitionBy("country", "city").orderBy("first", "state"))
    places = counts.join(eligible, ["country", "state"]).withColumn("nth", of_city).filter(F.col("nth") <= MOST_OF_CITY)
    a = places.select("country", "city", F.col("state").alias("a"))
    b = places.select("country", "city", F.col("state").alias("b"))
    links = a.join(b, ["country", "city"]).filter("a <> b").groupBy("country", "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= shared).select("country", "a", "b").checkpoint()
    labels = eligible.withColumn("label", F.col("state")).checkpoint()
    while True:
        offered = links.join(labels.withColumnRenamed("state", "b"), ["country", "b"]).groupBy("country", "a").agg(F.min("label").alias("offer"))
        new = labels.join(offered.withColumnRenamed("a", "state"), ["country", "state"], "left").select("country", "state", F.least("label", "offer").alias("label"), (F.col("offer") < F.col("label")).alias("moved")).checkpoint()
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    named = support.join(labels, ["country", "state"], "left").withColumn("label", F.coalesce("label", "state"))
    best = F.first("state").over(Window.partitionBy("country", "label").orderBy(F.desc("support"), "state"))
    return named.select("country", F.col("state").alias("surface"), best.alias("canon"), "support")


def canonical_state(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """records with column state: the last comma component of the address by its cluster's name, as it is where no cluster has it, empty where there is none."""
    surface = F.coalesce(B.last_components(F.col("business_address"))["state"], F.lit(""))
    names = clusters.filter("surface <> canon").select("country", F.col("surface").alias("_surface"), "canon")  # a few hundred a country at most
    out = records.withColumn("_surface", surface).join(names, ["country", "_surface"], "left")
    return out.withColumn("state", F.coalesce("canon", "_surface")).drop("_surface", "canon")


def save_maps(clusters: DataFrame, path: str) -> None:
    """(country, surface, canon, support), a file a country."""
    clusters.write.mode("overwrite").partitionBy("country").json(path)


def load_maps(spark, path: str) -> DataFrame:
    return spark.read.schema("country string, surface string, canon string, support long").json(path)
