"""Training sets, boosted-tree classifiers and batch scoring of pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelParams:
    rounds: int = 40
    step: float = 0.1
    depth: int = 6
    negatives: float = 0.15
    balance: bool = False  # weigh positives by the ratio of negatives, as the second lineage does
    validate: float = 0.0  # this share of entities stops rounds that no longer help
    seed: int = 0


def held_out(s1_id: Column) -> Column:
    """The fifth of entities kept for validation."""
    return F.crc32(s1_id.cast("binary")) % 5 == 0


def hash_share(c: Column, share: float, seed: int = 42) -> Column:
    """A deterministic Bernoulli draw from a column's hash."""
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def training_rows(pairs: DataFrame, p: ModelParams = ModelParams()) -> DataFrame:
    """Labelled pairs of training entities: all positives, and negatives by a hash of the pair."""
    draw = hash_share(F.concat_ws("|", "s1_id", "other_id"), p.negatives, p.seed)
    return pairs.filter("label is not null").filter(~held_out(F.col("s1_id"))).filter((F.col("label") == 1) | draw)


def fit(rows: DataFrame, features: list[str], p: ModelParams = ModelParams()) -> PipelineModel:
    rows = rows.select("s1_id", F.col("label").cast("double").alias("label"), *features)
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=p.rounds, stepSize=p.step, maxDepth=p.depth, seed=p.seed)
    if p.balance:
        n = rows.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
        weight = (n.n - n.p) / n.p if n.p else 1.0
        rows, gbt = rows.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0)), gbt.setWeightCol("weight")
    if p.validate:
        rows = rows.withColumn("kept_back", hash_share(F.col("s1_id"), p.validate))
        if rows.select("kept_back").distinct().count() == 2:  # a few entities may all fall on one side
            gbt = gbt.setValidationIndicatorCol("kept_back")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), gbt]).fit(rows)


def score(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Pairs with score, the probability of a match."""
    out = model.transform(pairs).withColumn("score", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, features: list[str], k: int = 10) -> list[tuple[str, float]]:
    """The k features with most gain."""
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]


def save(model: PipelineModel, path: str, meta: dict) -> None:
    """The model and a one-row JSON of its threshold, curve and counts."""
    import json

    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(path: str) -> tuple[PipelineModel, dict]:
    import json

    from pyspark.sql import SparkSession

    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.getActiveSession().read.text(f"{path}/meta").first().value)
