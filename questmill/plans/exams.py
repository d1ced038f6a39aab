"""Selections with exact or closest totals, one request a customer unit and paper group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.exam import seeded_order, select_exams
from ..registry import query
from .base import Q, line_columns, lines, papers, questions, table


def _made():
    """A question's id and its order in a pool, of the numbers of its row."""
    name = F.concat(F.col("paper").cast("string"), F.lit("_q"), F.col("number").cast("string"))
    return {"id": F.concat_ws(":", name, "part", "supp", "quantity", F.col("shipped").cast("string")), "order": F.unhex(seeded_order(name, "1"))}


def _rows(spark, sf_dir, target: int):
    """Each customer's questions are one request's pool: rows of numbers, of which ``_made`` gives id and order."""
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("request"))
    q = table(spark, sf_dir, "lineitem").join(papers, "l_orderkey").select("request", *line_columns())
    return q.select("request", F.lit(target).alias("target"), "paper", "number", "part", "supp", "quantity", "shipped", "marks")


def _pool(spark, sf_dir, target: int):
    return _rows(spark, sf_dir, target).withColumns(_made()).select(F.col("request").cast("string").alias("request"), "target", "id", "marks", "order")


def selected(spark, sf_dir, target: int, closest: bool = True):
    return select_exams(_rows(spark, sf_dir, target), closest=closest, made=_made())


@query()
def q_exam_exact(spark, sf_dir):
    return selected(spark, sf_dir, 75, closest=False)


@query()
def q_exam_closest(spark, sf_dir):
    return selected(spark, sf_dir, 80)


@query()
def q_exam_full(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("request", F.concat_ws(":", "unit", "year", "session", (F.col("paper") % 50).cast("string")))
    pool = q.select("request", F.lit(60).alias("target"), F.concat_ws(":", "id", "part", "supp", "quantity", F.col("shipped").cast("string")).alias("id"), "marks", "kind", "topic", F.col("paper").cast("string").alias("paper"), (50 + F.when(F.col("kind") == "mcq", 0).otherwise(20)).alias("priority"), seeded_order(F.col("id"), "2").alias("order"))
    return select_exams(pool, mcq_share=0.22)


@query("""WITH RECURSIVE m AS (SELECT o_custkey AS cust, CAST(l_quantity AS INTEGER) % 10 + 1 AS marks, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT cust, CAST(0 AS BIGINT) AS n, CAST(0 AS INTEGER) AS s FROM (SELECT DISTINCT cust FROM m) UNION SELECT r.cust, m.n, unnest([s, s + marks]) FROM r JOIN m ON m.cust = r.cust AND m.n = r.n + 1 WHERE s <= 40)
SELECT cust, count(DISTINCT s) AS sums FROM r WHERE s <= 40 GROUP BY cust""")
def q_reachable_sums(spark, sf_dir):
    """How many totals up to 40 each customer's questions can reach: a fold over a set, no pairs. Of equal marks m no more than 40 / m
    can be used, so a count for each mark is all that a customer's row holds."""
    held = lines(spark, sf_dir).join(papers(spark, sf_dir).select("paper", "cust"), "paper").groupBy("cust", "marks").agg(F.count(F.lit(1)).alias("n"))
    used = F.array_repeat(F.col("marks"), F.least("n", F.floor(40 / F.col("marks"))).cast("int"))
    marks = held.select("cust", used.alias("marks")).groupBy("cust").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    sums = F.aggregate("marks", F.array(F.lit(0)), lambda acc, m: F.array_union(acc, F.filter(F.transform(acc, lambda s: s + m), lambda s: s <= 40)))
    return marks.select("cust", F.size(sums).cast("long").alias("sums"))


@query(f"""WITH RECURSIVE {Q}, m AS (SELECT unit || ':' || year || ':' || session || ':' || (paper % 50) AS request, marks, row_number() OVER (PARTITION BY unit, year, session, paper % 50 ORDER BY id, part, supp, shipped, quantity) AS n FROM q),
r AS (SELECT request, CAST(0 AS BIGINT) AS n, CAST(0 AS INTEGER) AS s FROM (SELECT DISTINCT request FROM m) UNION SELECT r.request, m.n, unnest([s, s + marks]) FROM r JOIN m ON m.request = r.request AND m.n = r.n + 1 WHERE s <= 60)
SELECT DISTINCT request, CAST(60 AS BIGINT) AS total, TRUE AS whole, TRUE AS own FROM r WHERE s = 60""")
def q_exam_full_totals(spark, sf_dir):
    """Papers that meet their total: all whose questions can; each question once, and of the request's own pool."""
    chosen = q_exam_full(spark, sf_dir)
    # what a request may use is looked up for chosen questions alone: a request takes at most its total of them, so they are few
    key = F.concat_ws(":", "id", "part", "supp", "quantity", F.col("shipped").cast("string"))
    used = lines(spark, sf_dir).select("paper", key.alias("id")).join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi").distinct()
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("unit"))
    pool = used.join(papers(spark, sf_dir), "paper").join(units, "cust").select(F.concat_ws(":", "unit", "year", "session", (F.col("paper") % 50).cast("string")).alias("of"), "id")
    chosen = chosen.join(pool.distinct(), "id", "left")
    sums = chosen.groupBy("request").agg(F.sum("marks").cast("long").alias("total"), (F.count_distinct("id") == F.count("id")).alias("whole"), F.bool_and(F.coalesce(F.col("of") == F.col("request"), F.lit(False))).alias("own"))
    return sums.where("total = 60")
