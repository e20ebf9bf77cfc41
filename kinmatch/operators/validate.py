"""The output contract as relational checks."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.functions.lineage_b import source_prefix
from kinmatch.sources.settled import settled

RESULT_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")
SHOWN = 5
ERRORS = ("malformed", "duplicate_s1", "repeated_id", "self_match", "bad_prefix", "unknown_id", "missing_s1", "extra_s1", "header")
WARNINGS = ("not_candidate", "no_candidates")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def header_errors(first_line: str | None, header: tuple[str, str]) -> list[str]:
    """What is wrong with a file's first line."""
    if not first_line:
        return ["empty file"]
    if tuple(x.strip().lower() for x in first_line.split("\t")) == header:
        return []
    return ["comma-separated, not tab-separated" if re.split(r"\s*,\s*", first_line.strip().lower()) == list(header) else "wrong header"]


def parsed(lines: DataFrame) -> DataFrame:
    """Result lines (line) without blank ones: line, s1_id, ids; s1_id is null in a line without a tab."""
    at = F.split("line", "\t", 3)
    rows = lines.filter(F.trim("line") != "")
    ok = F.contains("line", F.lit("\t"))
    ids = F.filter(F.transform(F.split(F.get(at, 1), ","), lambda p: F.trim(p)), lambda x: x != "")
    return rows.select("line", F.when(ok, F.trim(F.get(at, 0))).alias("s1_id"), F.when(ok, ids).alias("ids"))


def violations(rows: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, example) for each violation in parsed rows; required: s1_id; known: other_id, asks for the check of unknown ids.

    One pass finds what a row shows by itself, one grouping by s1_id compares
    rows with required records, and one anti join finds unknown ids.
    """
    source = source_prefix
    named = lambda rule, c: F.struct(F.lit(rule).alias("rule"), c.cast("string").alias("example"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    inside = F.concat(
        F.when(F.col("s1_id").isNull(), F.array(named("malformed", F.col("line")))).otherwise(F.array().cast("array<struct<rule:string,example:string>>")),
        F.when(F.size(ids) != F.size(F.array_distinct(ids)), F.array(named("repeated_id", F.col("s1_id")))).otherwise(F.array().cast("array<struct<rule:string,example:string>>")),
        F.transform(F.filter(ids, lambda x: source(x) == "S1"), lambda x: named("self_match", x)),
        F.transform(F.filter(ids, lambda x: ~source(x).isin("S1", "S2", "S3")), lambda x: named("bad_prefix", x)),
    )
    found = rows.select(F.explode(inside).alias("x")).select("x.rule", "x.example")
    good = rows.filter("s1_id is not null")
    both = good.select("s1_id", F.lit(1).alias("n"), F.lit(0).alias("wanted")).unionByName(required.select("s1_id", F.lit(0).alias("n"), F.lit(1).alias("wanted")))
    per = both.groupBy("s1_id").agg(F.sum("n").alias("n"), F.max("wanted").alias("wanted"))
    rules = F.array_compact(F.array(F.when(F.col("n") > 1, F.lit("duplicate_s1")), F.when(F.col("n") == 0, F.lit("missing_s1")), F.when(F.col("wanted") == 0, F.lit("extra_s1"))))
    found = found.unionByName(per.select(F.explode(rules).alias("rule"), F.col("s1_id").alias("example")))
    if known is not None:
        each = good.select(F.explode("ids").alias("id")).filter(source(F.col("id")).isin("S2", "S3"))
        found = found.unionByName(each.join(known.select(F.col("other_id").alias("id")), "id", "left_anti").select(F.lit("unknown_id").alias("rule"), F.col("id").alias("example")))
    return found


def not_candidates(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warnings (rule, example): matches that are no candidates of their record."""
    a = results.filter("s1_id is not null").select("s1_id", F.explode("ids").alias("id")).distinct()
    b = candidates.filter("s1_id is not null").select("s1_id", F.explode("ids").alias("id")).distinct()
    return a.join(b, ["s1_id", "id"], "left_anti").select(F.lit("not_candidate").alias("rule"), F.concat_ws(">", "s1_id", "id").alias("example"))


def report(found: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(rule, severity, n, examples): the number of violations and the first few distinct examples in order, kept small by a second grouping before they are listed."""
    per = found.groupBy("rule", "example").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("example"))
    counts = per.groupBy("rule").agg(F.sum("n").alias("n"))
    first = per.withColumn("nth", nth).filter(F.col("nth") <= shown).groupBy("rule").agg(F.array_join(F.sort_array(F.collect_list("example")), ";").alias("examples"))
    return counts.join(first, "rule").select("rule", F.when(F.col("rule").isin(*WARNINGS), "warning").otherwise("error").alias("severity"), "n", "examples")


def validated(spark: SparkSession, results_path: str, candidates_path: str | None, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The report on written files, their headers included; a candidate file that is not there is a warning."""

    def lines(path: str, header: tuple[str, str]) -> tuple[DataFrame, list[str]]:
        got = read_lines(spark, path)
        heads = got.filter(F.lower(F.col("line")).startswith(header[0])).select("line").distinct().limit(SHOWN).collect()
        wrong = [e for r in heads for e in header_errors(r.line, header)] if heads else ["no header"] if not got.isEmpty() else ["empty file"]
        return got.filter(~F.lower(F.col("line")).startswith(header[0])), wrong

    results, wrong = lines(results_path, RESULT_HEADER)
    rows = settled(parsed(results), "results")
    found = violations(rows, required, known)
    try:
        candidates, more = lines(candidates_path, CANDIDATE_HEADER) if candidates_path else (None, [])
        wrong = wrong + more
    except AnalysisException:
        candidates = None
    if candidates is None:
        found = found.unionByName(spark.sql("SELECT 'no_candidates' AS rule, 'the candidate file is missing' AS example"))
    else:
        found = found.unionByName(not_candidates(rows, settled(parsed(candidates), "candidates")))
    for w in wrong:
        found = found.unionByName(spark.range(1).select(F.lit("header").alias("rule"), F.lit(w).alias("example")))
    return report(found)


def exit_code(summary: DataFrame) -> int:
    return 0 if summary.filter("severity = 'error'").isEmpty() else 1
