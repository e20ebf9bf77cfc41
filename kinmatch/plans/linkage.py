"""Whole runs: block, train, predict, and the parameter sweep; stages resume from what is already committed.

    python -m kinmatch.plans.linkage full --source1 ... --source2 ... --source3 ... --truth ... --out DIR
    modes: full, recall, sweep, predict, validate, score

Files written by full and predict are validated; errors make the exit code 1.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinmatch.operators import blocking as K
from kinmatch.operators import decide as D
from kinmatch.operators import features as X
from kinmatch.operators import metrics as M
from kinmatch.operators import model as L
from kinmatch.operators import validate as V
from kinmatch.sources import records as S

#: (post_budget, cap, gate, budget) of the sweep.
SWEEP = ((400, 600, 3.0, 15), (400, 600, 0.0, 40), (800, 800, 3.0, 40))


def done(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, written once; a committed folder is read instead."""
    if not done(spark, path):
        S.write_shards(make(), path)
    return spark.read.parquet(path)


def load_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sources 1 to 3 as records; ord follows the ids, as rows of a distributed file have no order of their own."""
    out = None
    for src, path in enumerate(paths, 1):
        rows = S.read_source(spark, path).withColumn("src", F.lit(src)).withColumn("ord", F.coalesce(F.substring_index("entity_id", "-", -1).try_cast("bigint"), F.xxhash64("entity_id")))
        out = rows if out is None else out.unionByName(rows)
    return out


def known_links(spark: SparkSession, path: str) -> DataFrame:
    return S.read_truth(spark, path, singletons=False).select("s1_id", F.explode("ids").alias("other_id"))


def validation(spark: SparkSession, data: DataFrame, out: str) -> DataFrame:
    """The report on the results and candidates in a folder."""
    required, known = data.filter("src = 1").select(F.col("entity_id").alias("s1_id")), data.filter("src > 1").select(F.col("entity_id").alias("other_id"))
    return V.validated(spark, f"{out}/matching_results", f"{out}/candidate_pairs", required, known)


def score_file(spark: SparkSession, results_path: str, truth_path: str) -> DataFrame:
    """One row: the macro score and the kinds of errors of a results file, over all records that the truth names."""
    predicted = S.read_truth(spark, results_path, singletons=False).select("s1_id", F.explode("ids").alias("other_id")).distinct()
    counts = M.entity_counts(S.read_truth(spark, truth_path).select("s1_id").distinct(), known_links(spark, truth_path), predicted)
    return M.macro_f_half(counts).join(M.error_breakdown(counts), F.lit(True))


def observed(pairs: DataFrame, truth: DataFrame | None, name: str) -> tuple[DataFrame, Observation]:
    """pairs, which count themselves (and their known links) while they are written."""
    seen = Observation(name)
    rows = pairs if truth is None else K.labelled(pairs, truth)
    counts = [F.count(F.lit(1)).alias("pairs"), F.approx_count_distinct("other_id").alias("probes")] + ([] if truth is None else [F.sum("label").alias("positives")])
    return rows.observe(seen, *counts), seen


def run(spark: SparkSession, mode: str, paths: list[str], truth_path: str | None, out: str, p: K.BlockingParams = K.BlockingParams(), m: L.ModelParams = L.ModelParams(), threshold: float | None = None, limit: int | None = None, s1_limit: int | None = None) -> DataFrame:
    """limit, s1_limit: only the first records of each other source, and of source 1; recall then counts the links inside that window."""
    if mode == "validate":  # needs no more than the ids
        ids = [S.read_ids(spark, path).withColumn("src", F.lit(k)) for k, path in enumerate(paths, 1)]
        return validation(spark, ids[0].unionByName(ids[1]).unionByName(ids[2]), out)
    if mode == "score":
        return score_file(spark, f"{out}/matching_results", truth_path)
    data = load_records(spark, paths)
    truth = known_links(spark, truth_path) if truth_path else None
    if limit is not None or s1_limit is not None:
        data = S.first_rows(data, limit, s1_limit)
        if truth is not None:
            truth = M.window_truth(truth, data.filter("src = 1").select(F.col("entity_id").alias("s1_id")), data.filter("src > 1").select(F.col("entity_id").alias("other_id")))

    def pairs_of(params: K.BlockingParams, name: str) -> DataFrame:
        if done(spark, f"{out}/{name}"):
            return spark.read.parquet(f"{out}/{name}")
        rows, seen = observed(X.with_features_a(K.block(data, params)[1]), truth, name)
        S.write_shards(rows.drop("label"), f"{out}/{name}")
        print(f"{name}: {seen.get}", file=sys.stderr)
        return spark.read.parquet(f"{out}/{name}")

    if mode == "sweep":
        result = None
        for post, cap, gate, budget in SWEEP:
            q = replace(p, post_budget=post, token_cap=cap, prefix_cap=cap, gate=gate, budget=budget)
            row = M.blocking_recall(truth, pairs_of(q, f"pairs-{post}-{cap}-{gate:g}-{budget}")).withColumn("post_budget", F.lit(post)).withColumn("cap", F.lit(cap)).withColumn("gate", F.lit(gate)).withColumn("budget", F.lit(budget))
            result = row if result is None else result.unionByName(row)
        return result
    pairs = pairs_of(p, "pairs")
    if mode == "recall":
        return M.blocking_recall(truth, pairs)
    if mode == "full":
        labelled = K.labelled(pairs, truth)
        model = L.fit(L.training_rows(labelled, m), X.FEATURES_A, m)
        entities = data.filter("src = 1").select(F.col("entity_id").alias("s1_id")).filter(L.held_out(F.col("s1_id")))
        known = truth.join(entities, "s1_id", "left_semi")
        best = M.best_threshold(M.threshold_sweep(entities, known, L.score(model, labelled).join(entities, "s1_id", "left_semi").select("s1_id", "other_id", "score"))).first()
        L.save(model, f"{out}/model", {"threshold": best.threshold if best else 1.0, "macro_f05": best.macro_f05 if best else None, "features": X.FEATURES_A, "gains": L.importances(model, X.FEATURES_A)})
    model, meta = L.load(f"{out}/model")
    scored = L.score(model, pairs).withColumn("pair_ord", F.struct("other_ord", "rank"))
    required = data.filter("src = 1").select("ord", "entity_id")
    results = D.emitted(required, D.grouped(D.above(scored, meta["threshold"] if threshold is None else threshold)))
    S.write_results(results, f"{out}/matching_results")
    S.write_results(D.emitted(required, D.grouped(scored), "candidate_entity_ids"), f"{out}/candidate_pairs")
    return results


def main(args: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("mode", choices=["full", "recall", "sweep", "predict", "validate", "score"])
    for k in (1, 2, 3):
        ap.add_argument(f"--source{k}", required=True)
    ap.add_argument("--truth")
    ap.add_argument("--out", required=True)
    ap.add_argument("--threshold", type=float)
    ap.add_argument("--limit", type=int)
    ap.add_argument("--s1-limit", type=int)
    a = ap.parse_args(args)
    spark, paths = SparkSession.builder.getOrCreate(), [a.source1, a.source2, a.source3]
    out = run(spark, a.mode, paths, a.truth, a.out, threshold=a.threshold, limit=a.limit, s1_limit=a.s1_limit)
    out.show(20, truncate=False)
    if a.mode not in ("full", "predict", "validate"):
        return 0
    report = out if a.mode == "validate" else validation(spark, S.first_rows(load_records(spark, paths), a.limit, a.s1_limit), a.out)
    if a.mode != "validate":
        report.show(50, truncate=False)
    return V.exit_code(report)


if __name__ == "__main__":
    sys.exit(main())
