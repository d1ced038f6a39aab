"""The question bank as a view of the given tables: an order is a paper, a line of it a question, a part its topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Q = """q AS (
  SELECT l_orderkey || '_q' || l_linenumber AS id, l_orderkey AS paper, l_linenumber AS number, CAST(l_quantity AS INTEGER) % 10 + 1 AS marks,
    p_brand AS topic, p_type AS subtopic, c_mktsegment AS unit, CAST(year(o_orderdate) AS INTEGER) AS year,
    CASE WHEN month(o_orderdate) <= 4 THEN 'January' WHEN month(o_orderdate) <= 8 THEN 'June' ELSE 'October' END AS session,
    CASE WHEN l_linenumber <= 2 THEN 'mcq' ELSE 'theory' END AS kind, l_partkey AS part, l_suppkey AS supp, l_shipdate AS shipped, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
#: A total order of the rows of one question id.
TIES = ["part", "supp", "shipped", "quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_columns() -> list[Column]:
    """What a row of lineitem is as a question; queries that join take them behind the join, which then moves numbers and no texts."""
    return [
        F.concat(F.col("l_orderkey").cast("string"), F.lit("_q"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_orderkey").alias("paper"),
        F.col("l_linenumber").alias("number"),
        (F.col("l_quantity").cast("int") % 10 + 1).alias("marks"),
        F.when(F.col("l_linenumber") <= 2, "mcq").otherwise("theory").alias("kind"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_shipdate").alias("shipped"),
        F.col("l_quantity").alias("quantity"),
    ]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without their dimensions: no join at all."""
    return table(spark, sf_dir, "lineitem").select(*line_columns())


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.month("o_orderdate")
    session = F.when(month <= 4, "January").when(month <= 8, "June").otherwise("October")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("year"), session.alias("session"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("dated"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with topic, subtopic, unit, year and session."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("topic"), F.col("p_type").alias("subtopic"))
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("unit"))
    q = lines(spark, sf_dir).join(papers(spark, sf_dir).select("paper", "cust", "year", "session").join(units, "cust"), "paper").join(parts, "part")
    return q.select("id", "paper", "number", "marks", "topic", "subtopic", "unit", "year", "session", "kind", *TIES)


def total(column: str) -> F.Column:
    return F.sum(column).cast("long")


def many() -> F.Column:
    return F.count(F.lit(1))
