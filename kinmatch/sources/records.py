"""Readers and writers of linkage data, and the view of the driver's documents as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.sources.settled import settled

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An unquoted TSV with a header; short rows are padded and nothing is null."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema=schema, mode="PERMISSIVE", nullValue="\u0000", emptyValue="")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, RECORD)


def read_truth(spark: SparkSession, path: str, singletons: bool = True) -> DataFrame:
    """(s1_id, ids) with ids an array; with singletons, also those without a match."""
    rows = _tsv(spark, path, TRUTH).select(F.col("source1_entity_id").alias("s1_id"), id_list(F.col("matched_entity_ids")).alias("ids"))
    return rows if singletons else rows.filter(F.size("ids") > 0)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank first columns only."""
    return read_source(spark, path).select(F.trim("entity_id").alias("entity_id")).filter("entity_id <> ''")


def id_list(c: Column) -> Column:
    """A comma list as an array without empty entries."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p)), lambda x: x != "")


def write_shards(df: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Parquet, committed as a whole; no file has more rows than asked for."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result rows (source1_entity_id, list column, ord) as a headed TSV in the order of ord."""
    ordered = results.orderBy("ord").drop("ord")
    ordered.write.mode("overwrite").option("emptyValue", "").csv(path, sep="\t", header=True, quote="\u0000")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Rows with nth from 0 in the order of a column, and total; ranges are sorted in parallel, and only their sizes are summed.

    The ranges are stored: drawn twice, their bounds differ, as each draw samples the rows anew and AQE merges ranges as it sees fit.
    """
    ranged = settled(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = ranged.agg(F.count("*").alias("total"))
    return within.join(F.broadcast(before), "_part").join(F.broadcast(total), F.lit(True)).withColumn("nth", F.col("_nth") - 1 + F.col("_before")).drop("_part", "_nth", "_n", "_before")


def first_rows(records: DataFrame, limit: int | None = None, s1_limit: int | None = None) -> DataFrame:
    """The window of a shorter run: the first s1_limit records of source 1 and the first `limit` of each other source, by ord (None: all)."""
    if limit is None and s1_limit is None:
        return records
    parts = [records.filter(F.col("src") == k) for k in (1, 2, 3)]
    for k, most in ((0, s1_limit), (1, limit), (2, limit)):
        if most is not None:
            parts[k] = numbered(parts[k], "ord").filter(F.col("nth") < most).drop("nth", "total")
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: ord, entity_id, src (1 to 3), business_name (the first line), business_address (the other lines), country (lang), text."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    src = F.col("doc_id") % 3 + 1
    at = F.instr(text, "\n")
    return docs.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("S"), src, F.lit("-"), F.col("doc_id")).alias("entity_id"), src.alias("src"), F.substring_index(text, "\n", 1).alias("business_name"),
        F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("").alias("business_address"), F.coalesce("lang", F.lit("")).alias("country"), text.alias("text"),
    )


def text_key() -> Column:
    """Of a document record: equal where texts are equal but for case and white space."""
    return F.sha2(F.lower(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")), 256)


def document_truth_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, s1_id, m): of all records of source 1, the number of their pairs in document_truth(), which are not made."""
    same = document_records(spark, sf_dir).select("src", "ord", "entity_id", text_key().alias("k"))
    sizes = same.filter("src > 1").groupBy("k").agg(F.count("*").alias("m"))
    return same.filter("src = 1").join(sizes, "k", "left").select("ord", F.col("entity_id").alias("s1_id"), F.coalesce("m", F.lit(0)).alias("m"))


def document_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, other_id): records of source 1 and of the others whose texts are equal but for case and white space."""
    same = document_records(spark, sf_dir).select("src", "entity_id", text_key().alias("k"))
    one, rest = same.filter("src = 1"), same.filter("src > 1")
    return one.select("k", F.col("entity_id").alias("s1_id")).join(rest.select("k", F.col("entity_id").alias("other_id")), "k").select("s1_id", "other_id")
