"""Order-dependent queries and folds of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.merge import ghost_purge, latest, partial_latest, toggled
from ..operators.ordered import before_cutoff, carry_forward, fold_machine, group_rank, islands, keep_best, round_robin, running_max
from ..registry import query
from .base import Q, TIES, lines, many, questions, table


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def q_keep_best_dup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("hash"))
    best = docs.groupBy("hash").agg(F.min_by(F.struct("doc_id", "source", "n_chars"), F.struct(-F.col("n_chars"), "doc_id")).alias("v"))
    return best.select("v.*")


@query("SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part, l_quantity AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_shipdate) AS n FROM lineitem) WHERE n = 1")
def q_keep_best_question(spark, sf_dir):
    return keep_best(lines(spark, sf_dir), ["paper", "number"], F.col("quantity").desc(), "part", "supp", "shipped").select("paper", "number", "part", "quantity")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def q_carry_forward(spark, sf_dir):
    out = carry_forward(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.length("text").cast("long")), "asked")
    return out.select("conv_id", "turn", "asked")


@query("SELECT conv_id, turn, max(CAST(CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS stage FROM conversations")
def q_state_monotone(spark, sf_dir):
    rank = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return running_max(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], rank, "stage").select("conv_id", "turn", "stage")


@query("SELECT conv_id, turn, role FROM (SELECT *, max(CASE WHEN length(text) > 800 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cut FROM conversations) WHERE cut = 0")
def q_cutoff(spark, sf_dir):
    return before_cutoff(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.length("text") > 800).select("conv_id", "turn", "role")


@query("SELECT user_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts), -1) AS boundary FROM events")
def q_next_boundary(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.lead("event_id").over(w), F.lit(-1)).alias("boundary"))


@query("""WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b FROM events), g AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 7200000000 OR lag(a) OVER (PARTITION BY user_id ORDER BY a, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM s)
SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g""")
def q_islands(spark, sf_dir):
    a = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", a.alias("a"), (a + 3_600_000_000).alias("b"))
    return islands(e, ["user_id"], ["a", "event_id"], F.col("a"), F.col("b"), F.lit(7_200_000_000)).select("user_id", "event_id", F.col("island").cast("long").alias("island"))


@query("""WITH RECURSIVE s AS (SELECT user_id, CAST(floor(value) AS INTEGER) % 6 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), f AS (
SELECT user_id, 0 AS last, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT f.user_id, CASE WHEN s.x = f.last + 1 THEN s.x ELSE f.last END, s.n FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
SELECT user_id, CAST(max(last) AS INTEGER) AS reached FROM f GROUP BY user_id""")
def q_sequential_gate(spark, sf_dir):
    """Numbers are accepted one after the other: a machine of six states, folded day by day."""
    x = F.floor("value").cast("int") % 6
    return fold_machine(table(spark, sf_dir, "events"), ["user_id"], F.to_date("ts"), ["ts"], x, 6, lambda s, n: F.when(n == s + 1, n).otherwise(s), name="reached")


@query("""WITH d AS (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) SELECT p_brand AS topic, p_partkey AS part, row_number() OVER (PARTITION BY p_brand ORDER BY n, p_type) AS turn FROM d""")
def q_round_robin(spark, sf_dir):
    out = round_robin(table(spark, sf_dir, "part"), ["p_brand"], "p_type", [F.col("p_retailprice").desc(), "p_partkey"])
    return out.select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("part"), F.col("turn").cast("long").alias("turn"))


@query("SELECT user_id, event_id, round(sum(CAST(value AS DECIMAL(18, 4))) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 2)::DOUBLE AS ink FROM events")
def q_moving_sum(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-2, 2)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.sum(F.col("value").cast("decimal(18,4)")).over(w), 2).cast("double").alias("ink"))


@query("SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS INTEGER) % 10, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS place FROM lineitem")
def q_exam_order_math(spark, sf_dir):
    w = Window.partitionBy("paper").orderBy("marks", "number", *TIES)
    return lines(spark, sf_dir).select("paper", "number", "part", F.row_number().over(w).cast("long").alias("place"))


@query("""WITH m AS (SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part, l_suppkey AS supp, l_shipdate AS shipped, l_quantity AS quantity, CAST(l_quantity AS INTEGER) % 10 + 1 AS marks FROM lineitem),
c AS (SELECT *, max(marks) OVER (PARTITION BY paper, number) AS most, sum(marks) OVER (PARTITION BY paper, number) AS tot FROM m)
SELECT paper, number, part, row_number() OVER (PARTITION BY paper ORDER BY CASE WHEN number <= 2 THEN 0 WHEN most < 6 THEN 1 ELSE 2 END, CASE WHEN number <= 2 THEN 0 ELSE tot END, number, part, supp, shipped, quantity) AS place FROM c""")
def q_exam_order_science(spark, sf_dir):
    cluster = Window.partitionBy("paper", "number")
    q = lines(spark, sf_dir).withColumn("most", F.max("marks").over(cluster)).withColumn("tot", F.sum("marks").over(cluster))
    mcq = F.col("kind") == "mcq"
    w = Window.partitionBy("paper").orderBy(F.when(mcq, 0).when(F.col("most") < 6, 1).otherwise(2), F.when(mcq, 0).otherwise(F.col("tot")), "number", *TIES)
    return q.select("paper", "number", "part", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT p_brand AS topic, p_partkey AS part, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey || 'seed'), p_partkey) AS place FROM part")
def q_seeded_shuffle(spark, sf_dir):
    key = F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("seed")).cast("binary"))
    keyed = table(spark, sf_dir, "part").select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("part"), key.alias("key"))
    return group_rank(keyed, ["topic"], F.substring("key", 1, 2), ["key", "part"]).select("topic", "part", F.col("place").cast("long").alias("place"))


@query("SELECT user_id AS id FROM events UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier UNION SELECT conv_id FROM conversations")
def q_union_ids(spark, sf_dir):
    t = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("id"))
    return t("events", "user_id").union(t("customer", "c_custkey")).union(t("supplier", "s_suppkey")).union(t("conversations", "conv_id")).distinct()


@query("""WITH a AS (SELECT l_orderkey AS paper, list_sort(list_distinct(list(l_linenumber))) AS nums FROM lineitem GROUP BY l_orderkey)
SELECT paper, array_to_string(list_filter(nums, lambda x: x NOT IN (1, 3)), ',') AS without, array_to_string(list_filter(nums, lambda x: x IN (1, 2, 3)), ',') AS common, len(list_filter(nums, lambda x: x IN (1, 2, 3)))::INTEGER AS score FROM a""")
def q_set_ops(spark, sf_dir):
    a = lines(spark, sf_dir).groupBy("paper").agg(F.array_sort(F.collect_set("number")).alias("nums"))
    odd, low = F.array(F.lit(1), F.lit(3)), F.array(F.lit(1), F.lit(2), F.lit(3))
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    return a.select("paper", text(F.array_except("nums", odd)).alias("without"), text(F.array_intersect("nums", low)).alias("common"), F.size(F.array_intersect("nums", low)).alias("score"))


@query("SELECT user_id, max_by(event_type, ts) AS status, max_by(event_id, ts) AS event_id FROM events GROUP BY user_id")
def q_latest_state(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), ["user_id"], ["ts"], "event_type", "event_id").select("user_id", F.col("event_type").alias("status"), "event_id")


@query("SELECT user_id, max_by(CASE WHEN event_type = 'error' THEN event_id END, CASE WHEN event_type = 'error' THEN ts END) AS last_error, max_by(CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_type = 'view' THEN ts END) AS last_view FROM events GROUP BY user_id")
def q_partial_update(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("last_error", F.when(F.col("event_type") == "error", F.col("event_id"))).withColumn("last_view", F.when(F.col("event_type") == "view", F.col("value")))
    return partial_latest(e, ["user_id"], ["ts"], "last_error", "last_view")


@query("SELECT user_id, count(*) % 2 = 1 AS bookmarked FROM events WHERE event_type = 'click' GROUP BY user_id")
def q_toggle_parity(spark, sf_dir):
    return toggled(table(spark, sf_dir, "events").where("event_type = 'click'"), ["user_id"], "bookmarked")


@query("SELECT user_id, CASE count(*) % 3 WHEN 0 THEN 'unattempted' WHEN 1 THEN 'review' ELSE 'mastered' END AS status FROM events WHERE event_type = 'view' GROUP BY user_id")
def q_status_cycle(spark, sf_dir):
    names = F.array(F.lit("unattempted"), F.lit("review"), F.lit("mastered"))
    n = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg((many() % 3).cast("int").alias("n"))
    return n.select("user_id", F.get(names, F.col("n")).alias("status"))


@query("SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS part FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = 5 * a.l_linenumber AND b.l_linenumber > 4)")
def q_ghost_purge(spark, sf_dir):
    q = lines(spark, sf_dir)
    parent_of = F.when((F.col("number") > 4) & (F.col("number") % 5 == 0), (F.col("number") / 5).cast("int"))
    return ghost_purge(q, ["paper"], F.col("number"), parent_of).select("paper", "number", "part")


@query(f"WITH {Q} SELECT paper, number, part, CASE WHEN n > 1 THEN number || '(a)' ELSE CAST(number AS VARCHAR) END AS label FROM (SELECT *, count(*) OVER (PARTITION BY paper, number) AS n FROM q)")
def q_promote_standalone(spark, sf_dir):
    n = many().over(Window.partitionBy("paper", "number"))
    text = F.col("number").cast("string")
    return questions(spark, sf_dir).select("paper", "number", "part", F.when(n > 1, F.concat(text, F.lit("(a)"))).otherwise(text).alias("label"))
