"""A citation graph and a library derived from the driver tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, ref_id): customers as works, the parts they ordered as their references."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("work_id"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("ref_id"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("work_id", "ref_id").distinct()


WORK_REFS = "wr AS (SELECT DISTINCT o_custkey AS work_id, l_partkey AS ref_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def part_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, ref_id): parts as works, their suppliers as references."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("ref_id")).distinct()


PART_REFS = "pr AS (SELECT DISTINCT l_partkey AS work_id, l_suppkey AS ref_id FROM lineitem)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, title): the titles of pages, with markup as it is."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.nullif(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit("")).alias("title"))


TITLES = r"ti AS (SELECT page_id, url, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages)"


def norm_sql(c: str) -> str:
    return f"coalesce(regexp_replace(lower({c}), '[^0-9a-z一-龥]', '', 'g'), '')"
