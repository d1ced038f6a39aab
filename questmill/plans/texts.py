"""Text, keys, numbers, taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, numbers, text
from ..operators.ordered import group_rank
from ..operators.taxonomy import apply_rules, classify_by_keywords, code_index, promote, resolve
from ..registry import query
from .base import lines, many, papers, table


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim('Question ' || p_partkey || '(' || p_size || ')' || ' [b] - ' || p_brand)), '^(question|q)', ''), '[*()\[\].\s_/†‡§#-]', '', 'g') AS cid FROM part""")
def q_canonical_id(spark, sf_dir):
    raw = F.concat(F.lit("Question "), F.col("p_partkey").cast("string"), F.lit("("), F.col("p_size").cast("string"), F.lit(") [b] - "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", keys.canonical_id(raw).alias("cid"))


@query(r"SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM pages")
def q_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", keys.slug(F.col("url")).alias("slug"))


@query(r"""SELECT p_brand AS topic, p_partkey AS part, row_number() OVER (PARTITION BY p_brand ORDER BY array_to_string(list_transform(regexp_extract_all(lower('Q' || p_size || '(' || p_type || ')'), '(\d+|\D+)', 1), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(CAST(length(regexp_replace(x, '^0+(.)', '\1')) AS VARCHAR), 8, '0') || regexp_replace(x, '^0+(.)', '\1') ELSE x END), ''), p_partkey) AS place FROM part""")
def q_natural_sort(spark, sf_dir):
    label = F.concat(F.lit("Q"), F.col("p_size").cast("string"), F.lit("("), F.col("p_type"), F.lit(")"))
    keyed = table(spark, sf_dir, "part").select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("part"), keys.natural_key(label).alias("key"))
    return group_rank(keyed, ["topic"], F.col("key"), ["part"]).select("topic", "part", F.col("place").cast("long").alias("place"))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'do not write in this area', ' ', 'gi'), '\*P\d+[A-Z0-9]+\*', ' ', 'g'), '[._]{4,}', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) > 550 THEN rtrim(t[1:550]) || '...' ELSE t END) AS cleaned, length(CASE WHEN length(t) > 550 THEN rtrim(t[1:550]) || '...' ELSE t END) AS n FROM c""")
def q_clean_text(spark, sf_dir):
    t = text.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("cleaned"), F.length("t").cast("long").alias("n"))


@query(r"""WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(regexp_replace(text, '[._\-\s]+', ' ', 'g'), '[A-Za-z]{2,}') AS words FROM conversations)
SELECT conv_id, turn, CAST(2 * len(words) + 25 * len(list_filter(words, lambda x: lower(x) IN ('calculate', 'explain', 'describe', 'state', 'determine', 'identify', 'give', 'write', 'suggest', 'deduce', 'show', 'draw', 'plot', 'outline', 'complete', 'predict', 'name', 'compare', 'justify', 'comment')))
 + CASE WHEN regexp_matches(text, '\(\d+\)') THEN 20 ELSE 0 END + 5 * turn - CASE WHEN len(words) = 0 THEN 100 WHEN len(words) < 3 THEN 50 ELSE 0 END AS DOUBLE) AS score FROM w""")
def q_content_score(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_score(F.col("text"), F.col("turn")).alias("score"))


@query(r"""WITH k AS (SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part, 'Rationale B' || chr(10) || CASE CAST(l_quantity AS INTEGER) % 4 WHEN 0 THEN 'A is the only correct answer' WHEN 1 THEN 'Correct Answer: c' WHEN 2 THEN 'D' ELSE 'none' END AS t, CAST(l_quantity AS INTEGER) % 4 AS m FROM lineitem)
SELECT paper, number, part, CASE m WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'D' END AS answer FROM k""")
def q_key_extract(spark, sf_dir):
    m = F.col("quantity").cast("int") % 4
    note = F.concat(F.lit("Rationale B\n"), F.when(m == 0, "A is the only correct answer").when(m == 1, "Correct Answer: c").when(m == 2, "D").otherwise("none"))
    return lines(spark, sf_dir).select("paper", "number", "part", text.answer_key(note).alias("answer"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, split_part(url, '?', 1) AS path, regexp_extract(url, '^(https?)', 1) AS scheme FROM pages")
def q_url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"^https?://([^/]+)", 1).alias("host"), F.split(url, r"\?")[0].alias("path"), F.regexp_extract(url, "^(https?)", 1).alias("scheme"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def q_json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(many().alias("n"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def q_sha_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), many().alias("copies"))


@query("""WITH z AS (SELECT DISTINCT (CAST(l_quantity AS INTEGER) - 25) / 5.0::DOUBLE AS z FROM lineitem), p AS (SELECT z, abs(z) AS a, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z),
u AS (SELECT z, a, CASE WHEN a >= 3.9 THEN 1.0::DOUBLE ELSE 1 - 0.3989422804014327::DOUBLE * exp(-a * a / 2) * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE))))) END AS v FROM p)
SELECT z, round(CASE WHEN z < 0 THEN 1 - v ELSE v END, 4) AS phi FROM u""")
def q_phi(spark, sf_dir):
    z = (F.col("quantity").cast("int") - 25) / F.lit(5.0)
    return lines(spark, sf_dir).select(z.alias("z")).distinct().select("z", numbers.normal_cdf(F.col("z")).alias("phi"))


@query("""WITH s AS (SELECT l_orderkey AS paper, CAST(sum(CAST(l_quantity AS INTEGER) % 10 + 1) AS BIGINT) AS marks FROM lineitem GROUP BY 1), m AS (SELECT paper, marks, CAST(CASE WHEN marks <= 0 THEN 0 WHEN paper % 3 = 0 THEN round(marks * 1.2) WHEN marks = 80 THEN 90 WHEN marks = 90 THEN 105 WHEN marks = 50 OR (paper % 3 = 1 AND abs(marks - 50) <= 2) THEN CASE WHEN paper % 2 = 0 THEN 80 ELSE 75 END ELSE round(marks * 1.15) END AS INTEGER) AS minutes FROM s)
SELECT paper, marks, minutes, CASE WHEN minutes // 60 = 0 THEN minutes || 'm' WHEN minutes % 60 = 0 THEN (minutes // 60) || 'h' ELSE (minutes // 60) || 'h ' || (minutes % 60) || 'm' END AS shown FROM m""")
def q_duration(spark, sf_dir):
    s = lines(spark, sf_dir).groupBy("paper").agg(F.sum("marks").alias("marks"))
    p = F.col("paper")
    m = s.withColumn("minutes", numbers.exam_minutes(F.col("marks"), p % 3 == 0, p % 3 == 1, p % 2 == 0))
    return m.withColumn("shown", numbers.format_minutes(F.col("minutes")))


@query("""WITH s AS (SELECT l_orderkey AS paper, CAST(sum(CAST(l_quantity AS INTEGER) % 10 + 1) AS BIGINT) AS earned, CAST(count(*) * 10 AS BIGINT) AS most FROM lineitem GROUP BY 1), p AS (SELECT *, earned * 100.0::DOUBLE / most AS pc FROM s)
SELECT paper, earned, most, CASE WHEN pc >= 85 THEN 'A*' WHEN pc >= 75 THEN 'A' WHEN pc >= 65 THEN 'B' WHEN pc >= 55 THEN 'C' WHEN pc >= 45 THEN 'D' WHEN pc >= 35 THEN 'E' ELSE 'U' END AS grade FROM p""")
def q_grade(spark, sf_dir):
    s = lines(spark, sf_dir).groupBy("paper").agg(F.sum("marks").alias("earned"), (many() * 10).alias("most"))
    return s.withColumn("grade", numbers.grade(F.col("earned"), F.col("most")))


@query("SELECT DISTINCT l_quantity / 2 AS x, round(l_quantity / 2) AS half_up, round_even(l_quantity / 2, 0) AS half_even FROM lineitem")
def q_rounding(spark, sf_dir):
    x = F.col("quantity") / 2
    return lines(spark, sf_dir).select(x.alias("x")).distinct().select("x", F.round("x").alias("half_up"), F.bround("x").alias("half_even"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), '@') OR contains(lower(text), 'token') THEN 'private' WHEN contains(lower(text), ' | ') THEN 'table' ELSE 'prose' END AS label FROM documents")
def q_keyword_classify(spark, sf_dir):
    rules = [("legal", ["license"]), ("private", ["@", "token"]), ("table", [" | "])]
    return table(spark, sf_dir, "documents").select("doc_id", classify_by_keywords(F.col("text"), rules, "prose").alias("label"))


@query("""WITH i AS (SELECT unit, code, arg_min(label, (p, label)) AS label FROM (SELECT p_brand AS unit, p_name AS label, unnest([1, 2, 3]) AS p, unnest([lower(p_name), lower(trim(string_split(p_name, ':')[1])), lower(regexp_split_to_array(p_name, '\\s+')[1])]) AS code FROM part) WHERE code <> '' GROUP BY unit, code),
g AS (SELECT p_partkey AS part, p_brand AS unit, lower(CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name || ': more' ELSE regexp_split_to_array(p_name, '\\s+')[1] || ' unknown tail' END) AS given FROM part)
SELECT g.part, coalesce(a.label, b.label, c.label) AS label FROM g LEFT JOIN i a ON a.unit = g.unit AND a.code = g.given LEFT JOIN i b ON b.unit = g.unit AND b.code = trim(string_split(g.given, ':')[1]) LEFT JOIN i c ON c.unit = g.unit AND c.code = regexp_split_to_array(g.given, '\\s+')[1]""".replace("\\\\", "\\"))
def q_code_resolve(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = F.split("p_name", r"\s+")[0]
    given = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(": more"))).otherwise(F.concat(first, F.lit(" unknown tail")))
    items = part.select(F.col("p_partkey").alias("part"), "p_brand", given.alias("given"))
    return resolve(items, code_index(part, "p_brand", "p_name"), ["part"], F.col("p_brand"), F.col("given")).select("part", "label")


@query("""WITH b AS (SELECT p_partkey AS part, p_brand AS main, list_distinct([p_type, p_brand, 'extra']) AS rel, p_size < 15 AS generic FROM part),
m AS (SELECT part, CASE WHEN generic THEN p_type ELSE main END AS main, p_type, main AS was, generic FROM b JOIN (SELECT p_partkey, p_type FROM part) ON p_partkey = part)
SELECT part, main, CASE WHEN generic THEN was ELSE p_type END AS related FROM m""")
def q_rule_promote(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("main"), F.array("p_type", "p_brand", F.lit("extra")).alias("related"), F.col("p_size"))
    out = apply_rules(rows, "main", "related", [promote(F.col("p_size") < 15)])
    return out.select("part", "main", F.get("related", F.lit(0)).alias("related"))


@query("""SELECT o_orderkey AS paper, lower(o_orderpriority || '_' || CAST(year(o_orderdate) AS VARCHAR) || '_' || CASE WHEN month(o_orderdate) <= 4 THEN 'January' WHEN month(o_orderdate) <= 8 THEN 'June' ELSE 'October' END) AS pid, CASE WHEN month(o_orderdate) <= 4 THEN 'January' WHEN month(o_orderdate) <= 8 THEN 'May/June' ELSE 'October' END AS season FROM orders""")
def q_paper_ids(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.select("paper", keys.paper_id(F.col("priority"), F.lit(""), F.col("year"), F.col("session")).alias("pid"), keys.season(F.col("session")).alias("season"))


@query("SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part, coalesce(nullif(l_quantity, 1), 7) AS marks, coalesce(nullif(l_returnflag, 'N'), nullif(l_linestatus, 'O'), 'General') AS topic FROM lineitem")
def q_alias_coalesce(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem")
    flag, status = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus"))
    return raw.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.coalesce(F.nullif("l_quantity", F.lit(1.0)), F.lit(7.0)).alias("marks"), keys.first_text(flag, status, F.lit("General")).alias("topic"))


