"""Set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table
from .joins import SERIES_SQL, series


@query("U01_row_union", "SELECT s_name AS name, s_acctbal AS bal FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer")
def row_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("bal"), F.col("c_name").alias("name")))


@query("U02_keyed_concat", "SELECT 'supplier' AS src, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier UNION ALL SELECT 'customer', count(*), round(sum(c_acctbal), 2) FROM customer")
def keyed_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, c: table(spark, sf_dir, name).agg(F.count("*").alias("n"), F.round(F.sum(c), 2).alias("total")).select(F.lit(name).alias("src"), "n", "total")
    return one("supplier", "s_acctbal").unionByName(one("customer", "c_acctbal"))


def _years(spark: SparkSession, sf_dir: str, y: int) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == y).select("o_custkey")


@query("U03_intersection", "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1999")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years(spark, sf_dir, 1996).intersect(_years(spark, sf_dir, 1999))


@query("U04_difference", "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1999")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years(spark, sf_dir, 1996).subtract(_years(spark, sf_dir, 1999))


@query("U05_exact_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only digests are shuffled."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("U06_all_duplicates", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1")
def all_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.withColumn("n", F.count("*").over(Window.partitionBy("sha"))).filter("n > 1").select("doc_id")


@query("U07_melt", "SELECT c_custkey, k, v FROM (SELECT c_custkey, c_acctbal AS bal, c_nationkey::DOUBLE AS nation FROM customer) UNPIVOT (v FOR k IN (bal, nation))")
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.unpivot(["c_custkey"], ["bal", "nation"], "k", "v")


@query("U08_pivot", SERIES_SQL + "SELECT seg, round(max(v) FILTER (y = 1996), 2) AS y1996, round(max(v) FILTER (y = 1998), 2) AS y1998, round(max(v) FILTER (y = 2000), 2) AS y2000 FROM s GROUP BY 1")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series(spark, sf_dir).withColumn("c", F.concat(F.lit("y"), F.col("y").cast("string")))
    return p.groupBy("seg").pivot("c", ["y1996", "y1998", "y2000"]).agg(F.round(F.max("v"), 2))
