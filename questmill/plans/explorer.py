"""Filtering, search, facets, totals, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..functions.text import matches_all, matches_any
from ..operators.explore import FilterSpec, facet, facet_all, facet_many, latest_first, series_bucket, unit_matches
from ..operators.ordered import page_of
from ..registry import query
from .base import Q, TIES, lines, many, papers, questions, table, total


@query(f"""WITH {Q} SELECT id, unit, year, session, marks, topic FROM q WHERE unit IN ('BUILDING', 'MACHINERY') AND year IN (1996, 1997) AND session IN ('January', 'October')
ORDER BY lower(unit), year DESC, CASE session WHEN 'October' THEN 3 WHEN 'June' THEN 2 ELSE 1 END DESC, paper, number, id, part, supp, shipped, quantity LIMIT 20 OFFSET 20""")
def q_explore_page(spark, sf_dir):
    spec = FilterSpec(units=["BUILDING", "MACHINERY"], years=[1996, 1997], series=["January", "October"])
    page = questions(spark, sf_dir).where(spec.predicate()).orderBy(*latest_first(), *TIES).offset(20).limit(20)
    return page.select("id", "unit", "year", "session", "marks", "topic")


@query(f"WITH {Q} SELECT unit, count(*) AS n, CAST(sum(marks) AS BIGINT) AS marks FROM q GROUP BY unit")
def q_multi_filter_empty_is_all(spark, sf_dir):
    return questions(spark, sf_dir).where(FilterSpec().predicate()).groupBy("unit").agg(many().alias("n"), total("marks").alias("marks"))


@query(f"WITH {Q} SELECT id, topic, subtopic, unit, part FROM q WHERE contains(lower(id), 'brand#1') OR contains(lower(unit), 'brand#1') OR contains(lower(topic), 'brand#1') OR contains(lower(subtopic), 'brand#1')")
def q_search_any_field(spark, sf_dir):
    return questions(spark, sf_dir).where(FilterSpec(search="brand#1").predicate()).select("id", "topic", "subtopic", "unit", "part")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'version')")
def q_search_all_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(matches_all(F.col("text"), "the version x")).select("doc_id", "lang")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a') OR contains(lower(p_type), 'a')")
def q_search_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").where(matches_any("A", F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select("p_partkey", "p_name")


@query("SELECT l_orderkey AS paper, CASE WHEN m <= 3 THEN '1-3' WHEN m <= 6 THEN '4-6' ELSE '7+' END AS band, count(*) AS n FROM (SELECT l_orderkey, CAST(l_quantity AS INTEGER) % 10 + 1 AS m FROM lineitem) GROUP BY 1, 2")
def q_mark_band(spark, sf_dir):
    band = F.when(F.col("marks") <= 3, "1-3").when(F.col("marks") <= 6, "4-6").otherwise("7+")
    return lines(spark, sf_dir).groupBy("paper", band.alias("band")).agg(many().alias("n"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE replace(lower(c_mktsegment), ' ', '') = 'building' OR trim(string_split(lower(c_mktsegment), ':')[1]) = 'building'")
def q_unit_match(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(unit_matches(F.col("c_mktsegment"), "Building: all")).select("c_custkey", "c_mktsegment")


@query("SELECT c_mktsegment AS unit, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def q_facet_unit_year(spark, sf_dir):
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("unit"))
    return facet(papers(spark, sf_dir).join(units, "cust"), "unit", "year")


@query("""SELECT bucket, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN m <= 4 THEN 'January' END, CASE WHEN m > 4 AND m <= 8 THEN 'May/June' END, CASE WHEN m > 8 THEN 'October' END, CASE WHEN m > 4 AND m <= 8 THEN 'Summer' END], lambda x: x IS NOT NULL)) AS bucket
FROM (SELECT month(o_orderdate) AS m FROM orders)) GROUP BY bucket""")
def q_facet_series_multi(spark, sf_dir):
    buckets = {b: series_bucket(F.col("session"), b) for b in ("January", "May/June", "October")}
    return facet_many(papers(spark, sf_dir), buckets | {"Summer": F.col("session") == "June"})


@query("SELECT p_partkey AS part, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 49 GROUP BY p_partkey")
def q_facet_subtopic_zero_fill(spark, sf_dir):
    rare = lines(spark, sf_dir).where(F.col("quantity") >= 49)
    return facet_all(rare, "part", table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")))


@query("SELECT count(*) AS n_questions, count(DISTINCT l_orderkey) AS n_papers, CAST(sum(CAST(l_quantity AS INTEGER) % 10 + 1) AS BIGINT) AS marks FROM lineitem")
def q_global_totals(spark, sf_dir):
    return lines(spark, sf_dir).agg(many().alias("n_questions"), F.count_distinct("paper").alias("n_papers"), total("marks").alias("marks"))


@query("""SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS done, count(*) AS n, CASE WHEN count(*) > 0 THEN least(100.0, round(count(*) FILTER (event_type IN ('purchase', 'signup')) * 100.0 / count(*), 2)) ELSE 0.0 END::DOUBLE AS percent
FROM events GROUP BY user_id""")
def q_progress_pct(spark, sf_dir):
    done = F.count_if(F.col("event_type").isin("purchase", "signup"))
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(done.alias("done"), many().alias("n"))
    return out.withColumn("percent", percent(F.col("done"), F.col("n")).cast("double"))


@query(f"WITH {Q} SELECT unit, year, id, position, CAST((position - 1) // 15 + 1 AS BIGINT) AS page FROM (SELECT *, row_number() OVER (PARTITION BY unit, year ORDER BY paper, number, part, supp, shipped, quantity) AS position FROM q)")
def q_page_numbers(spark, sf_dir):
    out = page_of(questions(spark, sf_dir), ["unit", "year"], F.floor(F.col("paper") / 1024), ["paper", "number", *TIES], 15)
    return out.select("unit", "year", "id", F.col("position").cast("long").alias("position"), F.col("page").cast("long").alias("page"))


@query("SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part, lag(l_partkey) OVER w AS before, lead(l_partkey) OVER w AS after, row_number() OVER w AS position FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity)")
def q_prev_next(spark, sf_dir):
    w = Window.partitionBy("paper").orderBy("number", *TIES)
    return lines(spark, sf_dir).select("paper", "number", "part", F.lag("part").over(w).alias("before"), F.lead("part").over(w).alias("after"), F.row_number().over(w).cast("long").alias("position"))


@query("SELECT user_id, event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 5 FOLLOWING), ',') AS around FROM events")
def q_neighbours_2_5(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-2, 5)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.array_join(F.collect_list(F.col("event_id").cast("string")).over(w), ",").alias("around"))


@query("SELECT DISTINCT p_brand AS topic FROM part")
def q_distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("topic")).distinct()


@query("""WITH p AS (SELECT user_id, max_by(event_type, ts) AS last FROM events GROUP BY user_id) SELECT c_custkey, coalesce(CASE WHEN last = 'purchase' THEN 'mastered' WHEN last = 'error' THEN 'review' END, 'unattempted') AS status FROM customer LEFT JOIN p ON user_id = c_custkey
WHERE coalesce(CASE WHEN last = 'purchase' THEN 'mastered' WHEN last = 'error' THEN 'review' END, 'unattempted') = 'unattempted'""")
def q_user_state_filter(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", "ts").alias("last"))
    status = F.when(F.col("last") == "purchase", "mastered").when(F.col("last") == "error", "review")
    users = table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").withColumn("status", status)
    return users.where(FilterSpec(status="unattempted").user_predicate()).select("c_custkey", F.coalesce("status", F.lit("unattempted")).alias("status"))
