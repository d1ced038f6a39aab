"""Totals per paper, reconciliation, coverage, issue lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from .base import Q, TIES, lines, many, papers, questions, table, total


@query("""SELECT paper, n, marks, n_mcq, mcq_marks, expected, marks - expected AS off, marks = expected AS agrees FROM (
SELECT l_orderkey AS paper, count(*) AS n, CAST(sum(m) AS BIGINT) AS marks, count(*) FILTER (l_linenumber <= 2) AS n_mcq, CAST(sum(CASE WHEN l_linenumber <= 2 THEN m ELSE 0 END) AS BIGINT) AS mcq_marks FROM (SELECT *, CAST(l_quantity AS INTEGER) % 10 + 1 AS m FROM lineitem) GROUP BY l_orderkey)
JOIN (SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 20 WHEN 'O' THEN 25 ELSE 30 END AS INTEGER) AS expected FROM orders) ON o_orderkey = paper""")
def q_paper_reconcile(spark, sf_dir):
    sums = lines(spark, sf_dir).groupBy("paper").agg(many().alias("n"), total("marks").alias("marks"), F.count_if(F.col("kind") == "mcq").alias("n_mcq"), F.sum(F.when(F.col("kind") == "mcq", F.col("marks")).otherwise(0)).cast("long").alias("mcq_marks"))
    expected = papers(spark, sf_dir).select("paper", F.when(F.col("state") == "F", 20).when(F.col("state") == "O", 25).otherwise(30).alias("expected"))
    return sums.join(expected, "paper").withColumn("off", F.col("marks") - F.col("expected")).withColumn("agrees", F.col("marks") == F.col("expected"))


@query(f"WITH {Q} SELECT coalesce(unit, 'TOTAL') AS unit, count(*) AS n, CAST(sum(marks) AS BIGINT) AS marks, count(DISTINCT paper) AS n_papers FROM q GROUP BY ROLLUP (unit)")
def q_unit_rollup(spark, sf_dir):
    out = questions(spark, sf_dir).rollup("unit").agg(many().alias("n"), total("marks").alias("marks"), F.count_distinct("paper").alias("n_papers"))
    return out.withColumn("unit", F.coalesce("unit", F.lit("TOTAL")))


@query("""SELECT lang, count(*) FILTER (n_chars < 100) AS short, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def q_issue_pivot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = {"short": F.col("n_chars") < 100, "poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "unlabelled": F.col("quality").isNull()}
    issues = docs.select("lang", F.explode_outer(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("code"))
    return issues.groupBy("lang").pivot("code", list(rules)).count().na.fill(0)


@query("""SELECT paper, n_mcq, keyed, n_mcq = 2 AND keyed = n_mcq AS complete FROM (SELECT l_orderkey AS paper, count(*) FILTER (l_linenumber <= 2) AS n_mcq, count(*) FILTER (l_linenumber <= 2 AND l_returnflag IN ('A', 'N', 'R') AND l_quantity > 5) AS keyed FROM lineitem GROUP BY l_orderkey)""")
def q_mcq_completeness(spark, sf_dir):
    mcq = F.col("l_linenumber") <= 2
    keyed = mcq & F.col("l_returnflag").isin("A", "N", "R") & (F.col("l_quantity") > 5)
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.count_if(mcq).alias("n_mcq"), F.count_if(keyed).alias("keyed"))
    return out.withColumn("complete", (F.col("n_mcq") == 2) & (F.col("keyed") == F.col("n_mcq")))


@query("""SELECT p_brand AS topic, count(DISTINCT p_partkey) AS n_all, count(DISTINCT l_partkey) AS n_covered, round(count(DISTINCT l_partkey) * 100.0 / count(DISTINCT p_partkey), 2)::DOUBLE AS percent FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 45 GROUP BY p_brand""")
def q_coverage(spark, sf_dir):
    used = lines(spark, sf_dir).where(F.col("quantity") >= 45).select("part").distinct().withColumn("used", F.lit(1))
    dim = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("topic"))
    out = dim.join(used, "part", "left").groupBy("topic").agg(many().alias("n_all"), F.count("used").alias("n_covered"))
    return out.withColumn("percent", F.round(F.col("n_covered") * 100.0 / F.col("n_all"), 2).cast("double"))


@query("SELECT l_orderkey AS paper, l_linenumber AS number, array_to_string(list(l_partkey ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity), ',') AS siblings, count(*) AS n FROM lineitem GROUP BY 1, 2")
def q_sibling_lists(spark, sf_dir):
    held = F.array_sort(F.collect_list(F.struct(*TIES)))
    return lines(spark, sf_dir).groupBy("paper", "number").agg(F.array_join(F.transform(held, lambda s: s["part"].cast("string")), ",").alias("siblings"), many().alias("n"))


@query("SELECT l_orderkey AS paper, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity)) AS first_supp FROM lineitem GROUP BY l_orderkey")
def q_first_of_group(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("paper").agg(F.min_by("supp", F.struct("number", *TIES)).alias("first_supp"))


@query(f"WITH {Q} SELECT unit, round(count(*) FILTER (subtopic = least_) * 100.0 / count(*), 2)::DOUBLE AS share FROM (SELECT *, min(subtopic) OVER () AS least_ FROM q) GROUP BY unit")
def q_first_bucket_share(spark, sf_dir):
    least = table(spark, sf_dir, "part").join(lines(spark, sf_dir).select(F.col("part").alias("p_partkey")), "p_partkey", "left_semi").agg(F.min("p_type").alias("least"))
    counts = questions(spark, sf_dir).groupBy("unit", "subtopic").agg(many().alias("n"))
    out = counts.join(least, F.col("subtopic") == F.col("least"), "left").groupBy("unit").agg(F.sum(F.when(F.col("least").isNotNull(), F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("n"))
    return out.select("unit", F.round(F.col("k") * 100.0 / F.col("n"), 2).cast("double").alias("share"))


@query("""SELECT l_returnflag AS flag, count(*) FILTER (was <> now) AS changed, count(*) FILTER (was IS NULL) AS added, count(*) AS n FROM (SELECT l_returnflag, nullif(l_linestatus, 'F') AS was, CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END AS now FROM lineitem) GROUP BY l_returnflag""")
def q_change_statistics(spark, sf_dir):
    was, now = F.nullif("l_linestatus", F.lit("F")), F.when(F.col("l_quantity") > 25, "O").otherwise("F")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(was != now).alias("changed"), F.count_if(was.isNull()).alias("added"), many().alias("n"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'HEIGHT_OUTLIER' END, CASE WHEN contains(lower(text), 'license') THEN 'BANNED_TEXT' END, CASE WHEN regexp_matches(text, '[0-9]{12,}') THEN 'BARCODE_LEAK' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents""")
def q_audit_issues(spark, sf_dir):
    rules = [F.when(F.col("n_chars") < 200, "HEIGHT_OUTLIER"), F.when(F.lower("text").contains("license"), "BANNED_TEXT"), F.when(F.col("text").rlike("[0-9]{12,}"), "BARCODE_LEAK")]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_compact(F.array(*rules)), ",").alias("issues"))


@query("SELECT l_orderkey AS paper, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_orderkey")
def q_bounds(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS talk FROM conversations GROUP BY conv_id")
def q_text_concat(spark, sf_dir):
    part = F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("t"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]), "|").alias("talk"))


@query("SELECT * FROM (SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS place FROM lineitem) WHERE place <= 3")
def q_topk_per_group(spark, sf_dir):
    w = Window.partitionBy("paper").orderBy(F.col("quantity").desc(), "number", "part", "supp", "shipped")
    return lines(spark, sf_dir).select("paper", "number", "part", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")
