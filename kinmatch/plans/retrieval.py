"""Whole runs of the second lineage: state maps, IDF retrieval, features, a balanced classifier, acceptance and one owner a target.

    python -m kinmatch.plans.retrieval train --source1 ... --source2 ... --source3 ... --truth ... --out DIR
    python -m kinmatch.plans.retrieval test --source1 ... --source2 ... --source3 ... --model DIR --out DIR2
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.operators import decide as D
from kinmatch.operators import features as X
from kinmatch.operators import metrics as M
from kinmatch.operators import model as L
from kinmatch.operators import retrieval as R
from kinmatch.operators import state_maps as S
from kinmatch.operators import validate as V
from kinmatch.plans.linkage import load_records, stage, validation
from kinmatch.sources.records import read_truth, write_results
from kinmatch.sources.settled import settled

FEATURES = X.FEATURES_B + X.FUZZY_B


@dataclass(frozen=True)
class RetrievalParams:
    top_k: int = R.TOP_K
    cap: int = R.FIRST_OF_TOKEN
    hold_out: float = 0.1  # this share of entities judges the model and is not learned from
    threshold: float = 0.5
    floor: float = 0.30
    most: int = 11


def featured(records: DataFrame, clusters: DataFrame, p: RetrievalParams, truth: DataFrame | None = None) -> DataFrame:
    vocabulary, pairs = R.retrieve_candidates(records, p.top_k, p.cap)
    return X.with_features_b(settled(pairs, "retrieved"), settled(X.records_b(records, clusters=clusters), "records"), vocabulary, truth=truth)


def matches(records: DataFrame, scored: DataFrame, p: RetrievalParams) -> DataFrame:
    """Accepted pairs after each target has chosen its owner."""
    ords = records.filter("src = 1").select(F.col("entity_id").alias("s1_id"), F.col("ord").alias("s1_ord"))
    return D.one_owner(D.accept(scored.join(ords, "s1_id"), p.threshold, p.floor, p.most))


def train(spark: SparkSession, paths: list[str], truth_path: str, out: str, p: RetrievalParams = RetrievalParams(), m: L.ModelParams = L.ModelParams(balance=True, validate=0.1)) -> DataFrame:
    """Fit and store the state maps and the model; one row of how it does on entities held out: links found by retrieval, and the macro score."""
    records = load_records(spark, paths)
    truth = read_truth(spark, truth_path, singletons=False).select("s1_id", F.explode("ids").alias("other_id"))
    S.save_maps(S.state_clusters(S.surface_counts(records)), f"{out}/states")
    pairs = stage(spark, f"{out}/features", lambda: featured(records, S.load_maps(spark, f"{out}/states"), p, truth))
    judged = L.hash_share(F.col("s1_id"), p.hold_out)
    model = L.fit(pairs.filter(~judged), FEATURES, m)
    entities = records.filter("src = 1").select(F.col("entity_id").alias("s1_id")).filter(judged)
    known = truth.join(entities, "s1_id", "left_semi")
    held = settled(L.score(model, pairs.filter(judged)).select("s1_id", "tgt_id", "score"), "held-out")
    predicted = matches(records, held, p).select("s1_id", F.col("tgt_id").alias("other_id"))
    retained = M.entity_retention(known, held.withColumnRenamed("tgt_id", "other_id"))
    result = M.macro_f_half(M.entity_counts(entities, known, predicted)).join(retained, F.lit(True))
    best = result.first()
    L.save(model, f"{out}/model", {"threshold": p.threshold, "floor": p.floor, "most": p.most, "macro_f05": best.macro_f05, "link_recall": best.link_recall, "features": FEATURES, "gains": L.importances(model, FEATURES)})
    return result


def test(spark: SparkSession, paths: list[str], model_dir: str, out: str, p: RetrievalParams = RetrievalParams()) -> DataFrame:
    """Results and candidates of new sources by a stored model, written and validated; returns the report."""
    records = load_records(spark, paths)
    model, meta = L.load(f"{model_dir}/model")
    pairs = stage(spark, f"{out}/features", lambda: featured(records, S.load_maps(spark, f"{model_dir}/states"), p))
    scored = settled(L.score(model, pairs).select("s1_id", "tgt_id", "score", "block_rank"), "scored")
    required = records.filter("src = 1").select("ord", "entity_id")
    named = lambda rows, order: D.grouped(rows.select("s1_id", F.col("tgt_id").alias("other_id"), F.struct(order, "tgt_id").alias("pair_ord")))
    final = matches(records, scored, RetrievalParams(p.top_k, p.cap, p.hold_out, meta["threshold"], meta["floor"], meta["most"]))
    write_results(D.emitted(required, named(final, (-F.col("score")).alias("by"))), f"{out}/matching_results")
    write_results(D.emitted(required, named(scored, "block_rank"), "candidate_entity_ids"), f"{out}/candidate_pairs")
    return validation(spark, records, out)


def main(args: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("mode", choices=["train", "test"])
    for k in (1, 2, 3):
        ap.add_argument(f"--source{k}", required=True)
    ap.add_argument("--truth")
    ap.add_argument("--model")
    ap.add_argument("--out", required=True)
    a = ap.parse_args(args)
    spark, paths = SparkSession.builder.getOrCreate(), [a.source1, a.source2, a.source3]
    if a.mode == "train":
        train(spark, paths, a.truth, a.out).show(20, truncate=False)
        return 0
    report = test(spark, paths, a.model or a.out, a.out)
    report.show(50, truncate=False)
    return V.exit_code(report)


if __name__ == "__main__":
    sys.exit(main())
