"""Pairing, fallback, incremental, merge, as-of, nearest, range."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import overlap_share
from ..operators.match import anti_any, asof_join, contained_join, fallback_join, nearest_join
from ..operators.merge import merge_progress, replace_by
from ..registry import query
from .base import TIES, lines, many, papers, table


@query("SELECT o_orderkey AS paper, l_linenumber AS number, l_partkey AS part, o_orderstatus AS state FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def q_pair_inner(spark, sf_dir):
    left = papers(spark, sf_dir).where("state = 'F'").select("paper", "state")
    return left.join(lines(spark, sf_dir).select("paper", "number", "part"), "paper")


@query("""WITH ms AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS paper, v AS variant, coalesce(a.part, b.part) AS part, a.part IS NULL AS by_base FROM (SELECT o_orderkey, CAST(o_orderkey % 5 + 1 AS INTEGER) AS v FROM orders)
LEFT JOIN ms a ON a.l_orderkey = o_orderkey AND a.l_linenumber = v LEFT JOIN ms b ON b.l_orderkey = o_orderkey AND b.l_linenumber = 1""")
def q_pair_variant_fallback(spark, sf_dir):
    ms = lines(spark, sf_dir).groupBy(F.concat_ws(":", "paper", "number").alias("key")).agg(F.min("part").alias("part"))
    left = papers(spark, sf_dir).select("paper", (F.col("paper") % 5 + 1).cast("int").alias("variant"))
    found = fallback_join(left, ms, ["paper", "variant"], [F.concat_ws(":", "paper", "variant"), F.concat(F.col("paper").cast("string"), F.lit(":1"))], "key")
    base_only = (F.col("variant") != F.lit(1)) & (F.col("matched_by") == 2)
    return found.select("paper", "variant", "part", F.when(F.col("matched_by").isNull() | base_only, True).otherwise(False).alias("by_base"))


@query("""WITH e AS (SELECT user_id, max(value) AS best FROM events GROUP BY user_id)
SELECT o_orderkey AS paper, CASE WHEN a.user_id IS NOT NULL THEN 1 WHEN b.user_id IS NOT NULL THEN 2 WHEN c.user_id IS NOT NULL THEN 3 END AS matched_by, coalesce(a.best, b.best, c.best) AS best
FROM orders LEFT JOIN e a ON a.user_id = o_orderkey LEFT JOIN e b ON b.user_id = o_custkey LEFT JOIN e c ON c.user_id = o_custkey % 10""")
def q_fallback_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("value").alias("best"))
    left = papers(spark, sf_dir).select("paper", "cust")
    keys = [F.col("paper").cast("string"), F.col("cust").cast("string"), (F.col("cust") % 10).cast("string")]
    return fallback_join(left, e, ["paper", "cust"], keys, "key").select("paper", "matched_by", "best")


@query("""SELECT o_orderkey AS paper FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_orderkey AND event_type = 'purchase') AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderstatus = 'P' AND x.o_totalprice = o.o_totalprice)""")
def q_incremental_skip(spark, sf_dir):
    done = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("paper"), F.lit(None).cast("double").alias("price"))
    hashed = papers(spark, sf_dir).where("state = 'P'").select(F.lit(None).cast("long").alias("paper"), "price")
    return anti_any(papers(spark, sf_dir).select("paper", "price"), done.unionByName(hashed), [["paper"], ["price"]]).select("paper")


@query("SELECT a.doc_id, a.n_chars FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id = a.doc_id + 1 AND b.source <> 'src0' AND b.n_chars >= a.n_chars)")
def q_delta_next(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.select("doc_id", "n_chars")
    b = docs.where("source <> 'src0'").select((F.col("doc_id") - 1).alias("doc_id"), F.col("n_chars").alias("other"))
    return a.join(b, "doc_id", "left").where("other is null or other < n_chars").select("doc_id", "n_chars")


@query("SELECT doc_id AS key, n_chars AS size FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.quality = n_chars % 2)")
def q_delta_key_size(spark, sf_dir):
    here = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("size"), (F.col("n_chars") % 2).cast("int").alias("v"))
    there = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("v"))
    return here.join(there, ["key", "v"], "left_anti").select("key", "size")


@query("SELECT p_partkey AS part FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def q_orphans(spark, sf_dir):
    used = lines(spark, sf_dir).where("quantity > 48").select("part")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).join(used, "part", "left_anti")


_SIDES = """a AS (SELECT user_id, max_by(event_type, ts) AS t, bool_or(event_type = 'click') AS b, max_by(CASE WHEN value > 50 THEN CAST(event_id AS VARCHAR) ELSE '' END, ts) AS v FROM events WHERE event_id % 2 = 0 AND user_id % 7 <> 0 GROUP BY user_id),
b AS (SELECT user_id, max_by(event_type, ts) AS t, bool_or(event_type = 'click') AS b, max_by(CASE WHEN value > 50 THEN CAST(event_id AS VARCHAR) ELSE '' END, ts) AS v FROM events WHERE event_id % 2 = 1 AND user_id % 5 <> 0 GROUP BY user_id)"""
_STATUS = "CASE {0} WHEN 'purchase' THEN 'mastered' WHEN 'error' THEN 'review' WHEN 'signup' THEN 'correct' ELSE 'unattempted' END"
_MERGED = f"""WITH {_SIDES}, m AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, {_STATUS.format('a.t')} AS ls, {_STATUS.format('b.t')} AS rs, a.b AS lb, b.b AS rb, nullif(a.v, '') AS la, nullif(b.v, '') AS ra, b.user_id IS NOT NULL AS there FROM a FULL OUTER JOIN b ON a.user_id = b.user_id),
o AS (SELECT *, CASE WHEN ls <> 'unattempted' THEN ls ELSE rs END AS status, coalesce(lb, false) OR coalesce(rb, false) AS is_bookmarked, coalesce(la, ra) AS user_answer FROM m)"""


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.max_by("event_type", "ts")
    status = F.when(kind == "purchase", "mastered").when(kind == "error", "review").when(kind == "signup", "correct").otherwise("unattempted")
    answer = F.max_by(F.when(F.col("value") > 50, F.col("event_id").cast("string")).otherwise(""), "ts")
    state = [status.alias("status"), F.bool_or(F.col("event_type") == "click").alias("is_bookmarked"), answer.alias("user_answer")]
    return e.where("event_id % 2 = 0 and user_id % 7 <> 0").groupBy("user_id").agg(*state), e.where("event_id % 2 = 1 and user_id % 5 <> 0").groupBy("user_id").agg(*state)


@query(_MERGED + " SELECT user_id, status, is_bookmarked, user_answer FROM o")
def q_full_outer_merge(spark, sf_dir):
    return merge_progress(*_sides(spark, sf_dir), ["user_id"]).drop("migrate")


@query(_MERGED + " SELECT user_id, status FROM o WHERE (NOT there OR status IS DISTINCT FROM rs OR is_bookmarked IS DISTINCT FROM rb OR user_answer IS DISTINCT FROM ra) AND (status <> 'unattempted' OR is_bookmarked OR user_answer IS NOT NULL)")
def q_migrate_rows(spark, sf_dir):
    return merge_progress(*_sides(spark, sf_dir), ["user_id"]).where("migrate").select("user_id", "status")


@query("""SELECT e.event_id, e.user_id, a.event_id AS anchor FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') a ON e.user_id = a.user_id AND e.ts >= a.ts""")
def q_asof_anchor(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    anchors = e.where("event_type = 'signup'").select("user_id", "at", F.col("event_id").alias("anchor"))
    return asof_join(e.where("event_type <> 'signup'").select("user_id", "at", "event_id"), anchors, ["user_id"], "at", "anchor").select("event_id", "user_id", "anchor")


@query("""WITH e AS (SELECT event_id, user_id, value, event_type FROM events), h AS (
SELECT l.event_id, l.user_id, l.value, r.event_id AS near, abs(r.value - l.value) AS d, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.value - l.value), r.value, r.event_id) AS n
FROM e l JOIN e r ON l.user_id = r.user_id AND r.event_type = 'purchase' AND abs(r.value - l.value) <= 5 WHERE l.event_type = 'click')
SELECT c.event_id, c.user_id, h.near FROM e c LEFT JOIN h ON h.event_id = c.event_id AND h.n = 1 WHERE c.event_type = 'click'""")
def q_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "value")
    right = e.where("event_type = 'purchase'").select("user_id", "value", F.col("event_id").alias("near"))
    return nearest_join(left, right, ["user_id"], "value", "near", 5.0).select("event_id", "user_id", "near")


@query("""SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate + INTERVAL 10 DAY AND l_shipdate <= o_orderdate + INTERVAL 60 DAY""")
def q_range_contain(spark, sf_dir):
    spans = papers(spark, sf_dir).select("paper", "dated")
    day = F.make_dt_interval
    out = contained_join(lines(spark, sf_dir).select("paper", "number", "part", "shipped"), spans, ["paper"], F.col("dated") + day(F.lit(10)), F.col("dated") + day(F.lit(60)), F.col("shipped"))
    return out.select("paper", "number", "part")


@query("""WITH s AS (SELECT l_orderkey AS paper, l_linenumber AS number, min(l_quantity) AS lo, max(l_quantity) + 5 AS hi FROM lineitem GROUP BY 1, 2)
SELECT a.paper, a.number, b.number AS other, round(greatest(0.0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / greatest(0.001, least(a.hi - a.lo, b.hi - b.lo)), 6)::DOUBLE AS share FROM s a JOIN s b ON a.paper = b.paper AND a.number < b.number
WHERE greatest(0.0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / greatest(0.001, least(a.hi - a.lo, b.hi - b.lo)) > 0.15""")
def q_overlap(spark, sf_dir):
    s = lines(spark, sf_dir).groupBy("paper", "number").agg(F.min("quantity").alias("lo"), (F.max("quantity") + 5).alias("hi"))
    t = s.select("paper", F.col("number").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    share = overlap_share(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"))
    return s.join(t, "paper").where("number < other").where(share > 0.15).select("paper", "number", "other", F.round(share, 6).alias("share"))


@query("""WITH r AS (SELECT o_orderkey AS paper, unnest(generate_series(1, CAST(o_orderkey % 4 + 1 AS BIGINT))) AS number FROM orders), n AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT paper, CAST(number AS INTEGER) AS number, coalesce(n, 0) AS n FROM r LEFT JOIN n ON l_orderkey = paper AND l_linenumber = number""")
def q_expand_ranges(spark, sf_dir):
    wanted = papers(spark, sf_dir).select("paper", F.explode(F.sequence(F.lit(1), (F.col("paper") % 4 + 1).cast("int"))).alias("number"))
    n = lines(spark, sf_dir).groupBy("paper", "number").agg(many().alias("n"))
    return wanted.join(n, ["paper", "number"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""WITH c AS (SELECT c_custkey AS cust, unnest([c_custkey % 50 + 7, c_custkey % 30 + 1, 999999999]) AS part, unnest([1, 2, 3]) AS pos FROM customer) SELECT cust, part, CAST(pos AS INTEGER) AS pos, p_name FROM c JOIN part ON p_partkey = part""")
def q_cart_order(spark, sf_dir):
    cart = F.array(F.col("c_custkey") % 50 + 7, F.col("c_custkey") % 30 + 1, F.lit(999999999))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.posexplode(cart).alias("pos", "part"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name")
    return rows.join(parts, "part").select("cust", "part", (F.col("pos") + 1).alias("pos"), "p_name")


@query("""WITH n AS (SELECT o_orderkey, o_totalprice + 1 AS price FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey AS paper, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n""")
def q_replace_by_paper(spark, sf_dir):
    old = papers(spark, sf_dir).select("paper", "price", "state")
    new = old.where("state = 'P'").select("paper", (F.col("price") + 1).alias("price"))
    return replace_by(old.drop("state"), new, ["paper"])


@query("""SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 10) GROUP BY 1, 2, 3""")
def q_semi_valid(spark, sf_dir):
    small = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("part"))
    return lines(spark, sf_dir).join(small, "part", "left_semi").groupBy("paper", "number", "part").agg(many().alias("n"))


@query("""WITH x AS (SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part, l_suppkey AS supp, l_shipdate AS shipped, l_quantity AS quantity FROM lineitem)
SELECT a.paper, a.number, a.part, b.part AS sibling FROM x a JOIN x b ON a.paper = b.paper AND a.number = b.number AND (a.part, a.supp, a.shipped, a.quantity) < (b.part, b.supp, b.shipped, b.quantity)""")
def q_siblings(spark, sf_dir):
    a = lines(spark, sf_dir).select("paper", "number", "part", F.struct(*TIES).alias("t"))
    b = a.select("paper", "number", F.col("part").alias("sibling"), F.col("t").alias("u"))
    return a.join(b, ["paper", "number"]).where("t < u").select("paper", "number", "part", "sibling")
