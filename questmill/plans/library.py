"""Lookups, corrections, user events, structure and classification over columns made from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import library as L
from ..operators import structure as S
from ..operators.exam import prepare_pool, preset_requests, seeded_order, select_exams, soft_filter
from ..operators.explore import FilterSpec
from ..operators.ordered import group_rank
from ..operators.normalize import box, marks_of, normalize, question_type, subject
from ..operators.taxonomy import apply_rules, consistency, led_by, promote, replaced, resolve_number, scoped, specific_first, stripped
from ..registry import query
from .base import Q, lines, many, questions, table
from .exams import selected

PARTS = "p_partkey AS part, p_brand AS unit, p_type AS label, p_size AS size, p_name AS name"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("unit"), F.col("p_type").alias("label"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))


def s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


@query("""SELECT part, CASE k WHEN 0 THEN 'Correct' WHEN 1 THEN 'Incorrect' WHEN 2 THEN 'Review' ELSE 'Unattempted' END AS shown FROM (SELECT p_partkey AS part, p_size % 5 AS k FROM part)""")
def q_status_label(spark, sf_dir):
    k = F.col("size") % 5
    given = F.when(k == 0, "correct").when(k == 1, "incorrect").when(k == 2, "review").when(k == 3, "odd")
    return parts(spark, sf_dir).select("part", L.status_label(given).alias("shown"))


@query(f"""WITH {Q} SELECT id, part, supp, CASE WHEN unit = 'BUILDING' THEN CASE WHEN marks <= 5 THEN 'short' WHEN marks <= 9 THEN 'medium' ELSE 'long' END ELSE CASE WHEN marks <= 3 THEN 'short' WHEN marks <= 6 THEN 'medium' ELSE 'long' END END AS band FROM q""")
def q_mark_band_subject(spark, sf_dir):
    given = F.when(F.col("unit") == "BUILDING", "mathematics").otherwise("chemistry")
    return questions(spark, sf_dir).select("id", "part", "supp", L.mark_band(F.col("marks"), given).alias("band"))


@query("""WITH a AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN 'I' || (p_partkey % 90 + 10) || ' text of it' WHEN p_partkey % 3 = 1 THEN ' I' || (p_partkey % 90 + 10) || ' ' ELSE 'none' END AS k FROM part), n AS (SELECT 'I' || p_size AS key, max(p_partkey) AS v FROM part GROUP BY 1)
SELECT a.part, coalesce(x.v, y.v) AS v, CASE WHEN x.v IS NOT NULL THEN 1 WHEN y.v IS NOT NULL THEN 2 END AS matched_by FROM a LEFT JOIN n x ON x.key = trim(a.k) LEFT JOIN n y ON y.key = nullif(regexp_extract(trim(a.k), '^(I\\d{2,3})\\b', 1), '')""".replace("\\\\", "\\"))
def q_prefix_key(spark, sf_dir):
    p = parts(spark, sf_dir)
    code = F.concat(F.lit("I"), s(F.col("part") % 90 + 10))
    k = F.when(F.col("part") % 3 == 0, F.concat(code, F.lit(" text of it"))).when(F.col("part") % 3 == 1, F.concat(F.lit(" "), code, F.lit(" "))).otherwise("none")
    known = p.groupBy(F.concat(F.lit("I"), s("size")).alias("key")).agg(F.max("part").alias("v"))
    return L.prefix_match(p.select("part", k.alias("k")), known, ["part"], F.col("k"), r"^(I\d{2,3})\b").select("part", "v", "matched_by")


@query("""WITH f AS (SELECT DISTINCT 'crops/' || p_brand || '/' || (p_partkey % 7) || '.png' AS path FROM part WHERE p_size > 25 UNION SELECT DISTINCT p_brand || '.png' FROM part WHERE p_size < 5), r AS (SELECT p_partkey AS part, 'crops/' || p_brand || '/' || (p_size % 7) || '.png' AS a, p_brand || '.png' AS b FROM part)
SELECT part, CASE WHEN a IN (SELECT path FROM f) THEN a WHEN b IN (SELECT path FROM f) THEN b END AS found FROM r""")
def q_candidate_paths(spark, sf_dir):
    p = parts(spark, sf_dir)
    path = lambda n: F.concat(F.lit("crops/"), F.col("unit"), F.lit("/"), s(n), F.lit(".png"))
    whole = F.concat("unit", F.lit(".png"))
    files = p.where("size > 25").select(path(F.col("part") % 7).alias("path")).union(p.where("size < 5").select(whole))
    rows = p.select("part", path(F.col("size") % 7).alias("a"), whole.alias("b"))
    return L.first_existing(rows, files, ["part"], [F.col("a"), F.col("b")]).select("part", F.col("matched_key").alias("found"))


@query("""WITH e AS (SELECT l_orderkey AS paper, l_linenumber AS cid, max(CAST(l_quantity AS INTEGER) % 10 + 1) AS mark FROM lineitem GROUP BY 1, 2), m AS (
SELECT paper, cid, CASE WHEN paper % 4 = 0 AND cid = 2 THEN 9 ELSE mark END AS mark, paper % 2 = 0 AND cid = 3 AND mark > 0 AND mark = 2 AS one, paper % 2 = 0 AND cid = 5 AS two FROM e),
t AS (SELECT paper, CASE WHEN one THEN 1 WHEN two THEN 3 ELSE cid END AS cid, CASE WHEN one THEN 1 WHEN two THEN 2 ELSE -1 END AS place, mark FROM m)
SELECT paper, cid, arg_min(mark, place) AS mark, min(place) >= 0 AS moved FROM t GROUP BY paper, cid""")
def q_errata(spark, sf_dir):
    e = lines(spark, sf_dir).groupBy("paper", F.col("number").cast("long").alias("cid")).agg(F.max("marks").alias("mark"))
    papers = e.select("paper").distinct()
    rule = lambda every, place, old, new, hint, mark: papers.where(F.col("paper") % every == 0).select("paper", F.lit(place).alias("place"), F.lit(old).cast("long").alias("ms_cid"), F.lit(new).cast("long").alias("qp_cid"), F.lit(hint).cast("int").alias("mark_hint"), F.lit(mark).cast("int").alias("override_mark"))
    rules = rule(2, 1, 3, 1, 2, None).union(rule(2, 2, 5, 3, None, None)).union(rule(4, 3, 2, 2, None, 9))
    return L.apply_errata(e, rules)


@query("SELECT p_partkey AS part, CASE WHEN p_size % 6 = 0 THEN 'curated ' || p_brand ELSE p_type END AS label FROM part")
def q_overrides(spark, sf_dir):
    p = parts(spark, sf_dir)
    curated = p.where("size % 6 = 0").select("part", F.concat(F.lit("curated "), "unit").alias("label"))
    return L.with_overrides(p.select("part", "label"), curated, "part", "label")


@query("""WITH q AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 2 = 0 THEN 'wx1' || (p_size % 4 + 1) END AS code, 'Unit ' || (p_size % 6 + 1) || ': ' || p_brand AS unit FROM part), p AS (SELECT 'P' || n AS preset, n AS n FROM range(1, 5) t(n))
SELECT part, preset FROM q JOIN p ON upper(code) = 'WX1' || n OR substr(unit, 6, 1) = CAST(n AS VARCHAR)""")
def q_preset_pool(spark, sf_dir):
    p = parts(spark, sf_dir)
    q = p.select("part", F.when(F.col("part") % 2 == 0, F.concat(F.lit("wx1"), s(F.col("size") % 4 + 1))).alias("unit_code"), F.concat(F.lit("Unit "), s(F.col("size") % 6 + 1), F.lit(": "), "unit").alias("unit"))
    presets = spark.createDataFrame([(f"P{n}", f"Wx1{n}") for n in range(1, 5)], "preset string, unit_code string")
    return L.preset_pool(q, presets, ["WX1"]).select("part", "preset")


@query("SELECT p_brand AS topic, p_type AS child, count(*) AS n FROM part WHERE contains(lower(p_brand), '#1') OR contains(lower(p_type), '#1') GROUP BY 1, 2")
def q_taxonomy_search(spark, sf_dir):
    dim = parts(spark, sf_dir).select(F.col("unit").alias("topic"), F.col("label").alias("child"))
    return L.taxonomy_search(dim, "topic", "child", " #1 ").groupBy("topic", "child").agg(many().alias("n"))


@query(f"""WITH {Q}, f AS (SELECT *, topic IN ('Brand#11', 'Brand#12') AS hit FROM q WHERE topic IN ('Brand#11', 'Brand#12') OR subtopic IN (SELECT min(p_type) FROM part))
SELECT CASE WHEN hit THEN 0 ELSE 1 END AS first, count(*) AS n, min(marks) AS low FROM f GROUP BY 1""")
def q_primary_first(spark, sf_dir):
    """Rows that match by their main label sort before those that match by another one."""
    least = table(spark, sf_dir, "part").agg(F.min("p_type").alias("least"))
    q = questions(spark, sf_dir).withColumn("was", F.col("subtopic")).join(least.withColumn("subtopic", F.col("least")), "subtopic", "left")
    q = q.withColumn("related", F.when(F.col("least").isNotNull(), F.array(F.lit("Brand#12"))).otherwise(F.array().cast("array<string>"))).withColumn("subtopic", F.col("topic"))
    wanted = ["Brand#11", "Brand#12"]
    hits = q.where(FilterSpec(subtopics=wanted).predicate()).select("marks", L.primary_first(F.col("subtopic"), wanted)[0].alias("first"))
    return hits.groupBy("first").agg(many().alias("n"), F.min("marks").alias("low"))


@query("SELECT unit, count(*) AS n FROM (SELECT p_brand AS unit FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')) GROUP BY unit")
def q_primary_only(spark, sf_dir):
    q = parts(spark, sf_dir).select("unit", F.col("unit").alias("subtopic"), F.array(F.lit("Brand#11")).alias("related"))
    return q.where(FilterSpec(subtopics=["Brand#11", "Brand#12"], primary_only=True).predicate()).groupBy("unit").agg(many().alias("n"))


@query("SELECT part, row_number() OVER (PARTITION BY size ORDER BY CASE WHEN unit = 'Brand#12' THEN 0 ELSE 1 END, unit, part) AS place FROM (SELECT " + PARTS + " FROM part)")
def q_active_first(spark, sf_dir):
    first = L.active_first(F.col("unit"), "Brand#12")
    chunk = F.struct(*(c.alias(f"k{k}") for k, c in enumerate(first)), "unit")
    return group_rank(parts(spark, sf_dir), ["size"], chunk, ["part"]).select("part", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 600 >= 300 THEN 1 ELSE 0 END, event_id % 37, event_id % 600, event_id) AS place FROM events")
def q_reading_order(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(*L.reading_order(F.col("event_id") % 600, F.col("event_id") % 37, 300), "event_id")
    return e.select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("""WITH e AS (SELECT user_id, event_id % 5 AS item, ts, event_id, CASE WHEN event_type = 'view' THEN '  ' ELSE ' ' || event_type || ' ' END AS given, CASE WHEN event_id % 3 = 0 THEN TRUE WHEN event_id % 3 = 1 THEN FALSE END AS ok FROM events),
x AS (SELECT user_id, item, (ts, event_id) AS k, nullif(trim(given), '') AS answer, CASE WHEN trim(given) = '' THEN 'unattempted' WHEN ok THEN 'correct' WHEN NOT ok THEN 'incorrect' END AS effect FROM e)
SELECT user_id, item, arg_max_null(answer, k) AS answer, coalesce(arg_max(effect, k) FILTER (effect IS NOT NULL), 'unattempted') AS status FROM x GROUP BY user_id, item""")
def q_answer_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    given = F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    ok = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    rows = e.select("user_id", (F.col("event_id") % 5).alias("item"), "ts", "event_id", given.alias("given"), ok.alias("ok"))
    return L.answered(rows, ["user_id", "item"], ["ts", "event_id"], "given", "ok")


@query("""WITH o AS (SELECT user_id, max(ts) AS gone FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 GROUP BY 1)
SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN o USING (user_id) WHERE o.gone IS NULL OR e.ts > o.gone GROUP BY 1""")
def q_sign_out(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = e.where("event_type = 'purchase' and user_id % 2 = 0").select("user_id", "ts")
    return L.after_sign_out(e.select("user_id", "ts"), out, "user_id", "ts").groupBy("user_id").agg(many().alias("n"))


@query("""WITH e AS (SELECT user_id, event_id % 4 AS item, (ts, event_id) AS k, event_id % 3 <> 0 AS added FROM events), f AS (SELECT *, added AND NOT coalesce(lag(added) OVER (PARTITION BY user_id, item ORDER BY k), FALSE) AS fresh FROM e),
g AS (SELECT user_id, item, arg_max(added, k) AS held, max(k) FILTER (fresh) AS since FROM f GROUP BY 1, 2)
SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY since) AS place FROM g WHERE held""")
def q_carts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("item"), "ts", "event_id")
    return L.carts(e, "user_id", "item", ["ts", "event_id"], F.col("event_id") % 3 != 0).withColumn("place", F.col("place").cast("long"))


@query("SELECT p_partkey AS part FROM part WHERE regexp_matches(CASE WHEN p_size % 2 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) || '.' END, '[A-Za-z]{2,}') OR p_size % 3 = 0 OR p_partkey % 7 = 0")
def q_phantoms(spark, sf_dir):
    shown = F.when(F.col("size") % 2 == 0, F.col("name")).otherwise(F.concat(s("size"), F.lit(".")))
    return L.without_phantoms(parts(spark, sf_dir), shown, F.when(F.col("size") % 3 == 0, "A").otherwise("B"), F.col("part") % 7 == 0).select("part")


@query("""WITH t AS (SELECT p_partkey AS part, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS a, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN '' END AS b, p_size % 5 = 0 AS sub FROM part)
SELECT part, CASE WHEN a <> '' AND length(a) > length(coalesce(b, '')) THEN a WHEN coalesce(b, '') = '' AND NOT sub THEN 'parent' ELSE coalesce(b, '') END AS own FROM t""")
def q_own_text(spark, sf_dir):
    a = F.when(F.col("size") % 2 == 0, F.col("name")).otherwise("")
    b = F.when(F.col("size") % 3 == 0, F.col("label")).when(F.col("size") % 3 == 1, "")
    return parts(spark, sf_dir).select("part", L.own_text(a, b, F.lit("parent"), F.col("size") % 5 == 0).alias("own"))


@query("SELECT event_id, CAST(greatest(1, round_even((event_id % 5000) / 800.0::DOUBLE, 0)) AS INTEGER) AS pages, CAST((event_id % 90000) // 3600 AS VARCHAR) || ':' || lpad(CAST((event_id % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS shown FROM events")
def q_countdown(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", L.page_span(F.col("event_id") % 5000, 800.0).alias("pages"), L.countdown(F.col("event_id") % 90000).alias("shown"))


@query("""SELECT p_partkey AS part, p_brand AS main, CASE WHEN p_size % 3 = 2 THEN 0 ELSE 2 END AS n_related, CASE WHEN p_size % 3 = 2 THEN NULL ELSE p_type END AS first FROM part""")
def q_answer_shapes(spark, sf_dir):
    both = F.array("unit", "label", F.lit("x"))
    obj = F.to_json(F.struct(F.col("unit").alias("main"), F.array("label", F.lit("x")).alias("related")))
    raw = F.when(F.col("size") % 3 == 0, obj).when(F.col("size") % 3 == 1, F.to_json(both)).otherwise(F.concat(F.lit(" "), "unit", F.lit(" ")))
    got = parts(spark, sf_dir).select("part", L.labels_of(raw).alias("l"))
    return got.select("part", F.col("l.main").alias("main"), F.size("l.related").alias("n_related"), F.get("l.related", F.lit(0)).alias("first"))


@query("""WITH legal AS (SELECT DISTINCT p_brand AS unit, p_type AS label FROM part WHERE p_size > 10), t AS (SELECT p_partkey AS part, p_brand AS unit, p_type AS a, CASE WHEN p_size % 2 = 0 THEN 'General' ELSE p_type END AS main FROM part),
c AS (SELECT t.*, l.label IS NOT NULL AS ok FROM t LEFT JOIN legal l ON l.unit = t.unit AND l.label = t.a), i AS (
SELECT part, unnest(list_filter([CASE WHEN main = 'General' OR NOT ok THEN 'foreign_main' END, 'foreign_related', CASE WHEN main = 'General' AND ok THEN 'generic_main' END, 'many_related', CASE WHEN part % 3 = 0 THEN 'repeated_related' END, CASE WHEN main = a THEN 'main_repeated' END], lambda x: x IS NOT NULL)) AS issue FROM c)
SELECT issue, count(*) AS n, min(part) AS first FROM i GROUP BY issue""")
def q_diagnostics(spark, sf_dir):
    p = parts(spark, sf_dir)
    legal = p.where("size > 10").groupBy("unit").agg(F.collect_set("label").alias("legal"))
    related = F.concat(F.array("label", F.lit("elsewhere")), F.when(F.col("part") % 3 == 0, F.array(F.lit("elsewhere"))).otherwise(F.array().cast("array<string>")))
    main = F.when(F.col("size") % 2 == 0, "General").otherwise(F.col("label"))
    issues = p.join(legal, "unit", "left").select("part", F.explode(L.diagnose(main, related, F.col("legal"), ["General"])).alias("issue"))
    return issues.groupBy("issue").agg(many().alias("n"), F.min("part").alias("first"))


@query("SELECT unit, head, count(*) AS n, min(label) AS first FROM (SELECT DISTINCT p_brand AS unit, string_split(p_type, ' ')[1] AS head, p_type AS label FROM part) GROUP BY unit, head HAVING count(*) > 1")
def q_prefix_collisions(spark, sf_dir):
    return L.prefix_collisions(parts(spark, sf_dir), "unit", "label", F.split("label", " ")[0])


@query("""WITH r AS (SELECT p_partkey AS part, p_size AS size, p_brand AS unit, p_type AS label FROM part), a AS (SELECT *, CASE WHEN size < 15 THEN label ELSE unit END AS m1, CASE WHEN size < 15 THEN unit ELSE label END AS r1 FROM r),
b AS (SELECT *, CASE WHEN size % 4 = 0 THEN 'pattern' ELSE m1 END AS m2 FROM a), c AS (SELECT *, CASE WHEN size % 5 = 0 THEN NULL ELSE r1 END AS r2 FROM b)
SELECT part, m2 AS main, CASE WHEN r2 <> m2 THEN r2 END AS related FROM c""")
def q_rule_chain(spark, sf_dir):
    """Ordered rules: a generic main label gives way, a pattern sets it, some related labels are stripped, one at most stays."""
    size = F.col("size")
    rules = [promote(size < 15), lambda m, r: (F.when(size % 4 == 0, "pattern").otherwise(m), r), lambda m, r: (m, F.when(size % 5 == 0, F.array().cast("array<string>")).otherwise(r))]
    rows = parts(spark, sf_dir).select("part", "size", F.col("unit").alias("main"), F.array("label").alias("related"))
    return apply_rules(rows, "main", "related", rules).select("part", "main", F.get("related", F.lit(0)).alias("related"))


@query("""SELECT p_partkey AS part, CASE WHEN p_size % 4 = 0 THEN 'theory' WHEN p_size % 4 = 1 THEN 'mcq' WHEN p_size % 4 = 2 THEN 'theory' WHEN p_size > 20 THEN 'theory' ELSE 'mcq' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'mathematics' WHEN p_partkey % 3 = 1 THEN 'physics' ELSE 'chemistry' END AS subject FROM part""")
def q_question_type(spark, sf_dir):
    k, none = F.col("size") % 4, F.lit(None).cast("string")
    kind = question_type(F.when(k == 0, "mathematics").otherwise("chemistry"), F.lit("Unit 1"), F.lit("WCH11"), F.when(k == 1, "A").when(k == 2, "B"), none, s("size"), s("size"), none)
    code = F.when(F.col("part") % 3 == 0, "WMA11").when(F.col("part") % 3 == 1, "WPH11").otherwise("WCH11")
    named = subject(code, none, none, none, {"mathematics": ["wma"], "physics": ["wph"]}, "chemistry")
    return parts(spark, sf_dir).select("part", kind.alias("kind"), named.alias("subject"))


@query("""WITH c AS (SELECT p_partkey AS part, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 1000.0 END::DOUBLE AS k, (p_size % 10) / 10.0::DOUBLE AS a, (p_size % 7) / 8.0::DOUBLE AS b FROM part), d AS (SELECT part, CASE WHEN k = 1000 AND a * k <= 1 AND b * k <= 1 THEN 1000.0::DOUBLE WHEN k = 1 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS f, a * k AS a, b * k AS b FROM c)
SELECT part, least(a, b) * f AS ymin, least(a, b) * f AS xmin, greatest(a, b) * f AS ymax, greatest(a, b) * f AS xmax FROM d""")
def q_box(spark, sf_dir):
    k = F.when(F.col("size") % 2 == 0, 1.0).otherwise(1000.0)
    a, b = (F.col("size") % 10) / F.lit(10.0) * k, (F.col("size") % 7) / F.lit(8.0) * k
    return parts(spark, sf_dir).select("part", box(F.array(a, b, b, a)).alias("b")).select("part", "b.*")


@query("""SELECT p_partkey AS part, CAST(CASE WHEN p_size % 3 = 0 THEN coalesce(nullif(p_size % 5, 0), nullif(p_size % 4, 0), 1) ELSE coalesce(nullif(p_size % 4, 0), nullif(p_size % 5, 0), 1) END AS INTEGER) AS marks FROM part""")
def q_marks_cascade(spark, sf_dir):
    """The same sources in each subject's own order."""
    scheme, printed = (F.col("size") % 5).cast("int"), (F.col("size") % 4).cast("int")
    return parts(spark, sf_dir).select("part", F.when(F.col("size") % 3 == 0, marks_of(scheme, printed)).otherwise(marks_of(printed, scheme)).alias("marks"))


@query("""WITH t AS (SELECT p_partkey AS part, p_size % 9 AS n, p_size % 4 AS k FROM part)
SELECT part, CASE WHEN k IN (0, 1) THEN chr(97 + CAST(n AS INTEGER)) END AS letter, CAST(part % 50 AS INTEGER) AS number, CAST(CASE WHEN k IN (0, 1) THEN n + 1 ELSE 0 END AS INTEGER) AS letter_rank, CAST(CASE WHEN k = 1 THEN 3 WHEN k = 2 THEN 4 ELSE 0 END AS INTEGER) AS roman_rank FROM (SELECT part, CASE WHEN n = 8 THEN 7 ELSE n END AS n, k FROM t)""")
def q_marker_ranks(spark, sf_dir):
    n, k = F.least(F.col("size") % 9, F.lit(7)), F.col("size") % 4
    letter = F.concat(F.lit("("), F.chr(n + 97), F.lit(")"))
    tail = F.when(k == 0, letter).when(k == 1, F.concat(letter, F.lit("(iii)"))).when(k == 2, F.lit("(iv)")).otherwise("")
    rows = parts(spark, sf_dir).select("part", F.concat(s(F.col("part") % 50), tail).alias("raw"))
    rank = S.marker_rank(F.col("raw"))
    return rows.select("part", S.alpha_letter(F.col("raw")).alias("letter"), rank["number"].alias("number"), rank["letter"].alias("letter_rank"), rank["roman"].alias("roman_rank"))


@query("""SELECT p_partkey AS part, CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '(b)(iv)' WHEN p_partkey % 3 = 1 THEN '(a)(ii)' ELSE '' END AS full_id, CAST(p_size AS VARCHAR) AS parent FROM part""")
def q_hierarchical_id(spark, sf_dir):
    none = F.lit(None).cast("string")
    k = F.col("part") % 3
    number = F.when(k == 0, F.concat(F.lit("Q "), s("size"), F.lit(" (b) (iv)"))).when(k == 1, F.lit("(ii)")).otherwise(s("size"))
    got = S.hierarchical_id(number, F.when(k == 1, s("size")), none, none, F.lit("a"))
    return parts(spark, sf_dir).select("part", got.alias("g")).select("part", F.col("g.full").alias("full_id"), F.col("g.parent").alias("parent"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN chr(97 + CAST(event_id % 4 AS INTEGER)) END AS l, CASE WHEN event_type = 'click' THEN event_id % 20 END AS h, (event_id % 100)::DOUBLE AS y FROM events), f AS (
SELECT *, last_value(l IGNORE NULLS) OVER w AS c, max(h) OVER w AS parent_no, lead(y) OVER (PARTITION BY user_id ORDER BY event_id) AS ny FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN c IS NOT DISTINCT FROM lag(c) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS d FROM f)
SELECT user_id, event_id, parent_no, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS letter_group, least(y + 30, coalesce(ny - 4, y + 30)) AS y1 FROM g""")
def q_letter_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.chr(F.col("event_id") % 4 + 97)).alias("l"), (F.col("event_id") % 20).alias("h"), (F.col("event_type") == "click").alias("known"), (F.col("event_id") % 100).cast("double").alias("y"))
    rows = S.letter_groups(e, ["user_id"], ["event_id"], F.col("l"))
    rows = S.guard_parent(rows, ["user_id"], ["event_id"], F.col("h"), F.col("known"))
    rows = S.clamp_to_next(rows.withColumn("y1", F.col("y") + 30), ["user_id"], ["event_id"], "y", "y1")
    return rows.select("user_id", "event_id", "parent_no", F.col("letter_group").cast("long").alias("letter_group"), "y1")


@query("""WITH t AS (SELECT p_partkey AS part, p_size % 6 + 1 AS a, p_size % 3 + 1 AS b FROM part)
SELECT part, CASE WHEN a IN (3, 6) AND b IN (3, 6) THEN 'unit3_6' WHEN a IN (4, 5) AND b IN (4, 5) THEN 'ia2' WHEN a IN (1, 2) AND b IN (1, 2) THEN 'as' ELSE 'mixed_or_all' END AS category, CASE WHEN a = 1 THEN 'WXX11' WHEN a = 2 THEN 'WXX12' ELSE 'WXX14' END AS code FROM t""")
def q_unit_category(spark, sf_dir):
    a, b = s(F.col("size") % 6 + 1), s(F.col("size") % 3 + 1)
    units = F.array(F.concat(F.lit("Unit "), a, F.lit(": x")), F.concat(F.lit("WXX1"), b))
    named = F.when(a == "1", "Structure").when(a == "2", "see wxx12 there").otherwise("no code")
    return parts(spark, sf_dir).select("part", S.unit_category(units).alias("category"), S.unit_code(named, {"structure": "WXX11"}, r"wxx1[1-6]", "WXX14").alias("code"))


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'image/png' WHEN page_id % 3 = 1 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime, concat_ws(' | ', nullif(CASE WHEN page_id % 2 = 0 THEN 'a' ELSE '' END, ''), 'p' || page_id) AS context, trim('x ' || page_id || ' y2') AS bare FROM pages""")
def q_asset_texts(spark, sf_dir):
    k = F.col("page_id") % 3
    path = F.concat(s("page_id"), F.when(k == 0, ".PNG").when(k == 1, ".pdf").otherwise(".dat"))
    latex = F.concat(F.lit("$\\frac{x}{"), s("page_id"), F.lit("} \\alpha y_2$"))
    return table(spark, sf_dir, "pages").select("page_id", text.mime_type(path).alias("mime"), text.join_context(F.when(F.col("page_id") % 2 == 0, "a").otherwise(""), F.concat(F.lit("p"), s("page_id"))).alias("context"), F.trim(F.regexp_replace(text.strip_latex(latex), r"^x", "x ")).alias("bare"))


@query("""WITH legal AS (SELECT DISTINCT p_brand AS unit, p_type AS label FROM part WHERE p_size > 25), f AS (SELECT unit, min(label) AS low FROM legal GROUP BY unit), i AS (SELECT p_partkey AS id, p_brand AS unit, p_type AS label FROM part)
SELECT i.id, i.unit, l.label IS NOT NULL AND i.id % 2 = 0 AS reused, CASE WHEN l.label IS NOT NULL THEN i.label ELSE coalesce(f.low, i.label) END AS label FROM i LEFT JOIN legal l ON l.unit = i.unit AND l.label = i.label LEFT JOIN f ON f.unit = i.unit""")
def q_cache_and_repair(spark, sf_dir):
    p = parts(spark, sf_dir).select(F.col("part").alias("id"), "unit", "label", "size")
    legal = p.where("size > 25").select("unit", "label").distinct()
    hit, miss = S.split_by_cache(p.select("id", "unit"), p.where("id % 2 = 0").select("id", "unit", "label"), legal)
    reused = hit.select("id", F.lit(True).alias("reused")).union(miss.select("id", F.lit(False)))
    return S.repair(p.drop("size"), legal).join(reused, "id").select("id", "unit", "reused", "label")


@query("""WITH b AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 10.0 ELSE 400.0 END AS y FROM conversations), k AS (SELECT conv_id, CASE WHEN y < 32 OR regexp_matches(text, '(?i)^\\s*\\(?total\\b.*\\d+\\s*marks?\\)?') OR regexp_matches(text, '^[.\\s_]{4,}$') OR contains(text, 'DO NOT WRITE') OR contains(text, '*P') OR contains(text, 'BLANK PAGE') OR contains(text, 'Turn over') THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[A-Za-z]{2,}'))) END AS n FROM b)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS words, sum(n) < 5 AS blank FROM k GROUP BY conv_id""".replace("\\\\", "\\"))
def q_blank_pages(spark, sf_dir):
    b = table(spark, sf_dir, "conversations").select("conv_id", "text", F.when(F.col("turn") % 3 == 0, 10.0).otherwise(400.0).alias("y0"), F.lit(842.0).alias("page_height"))
    return S.blank_pages(b, ["conv_id"]).select("conv_id", F.col("words").cast("long").alias("words"), "blank")


@query("SELECT p_partkey AS part FROM part WHERE p_size % 4 < 2")
def q_measures(spark, sf_dir):
    shown = F.when(F.col("size") % 4 == 0, F.concat(s("size"), F.lit(" cm wide"))).when(F.col("size") % 4 == 1, F.concat(F.lit("Q"), s("size"), F.lit(". minutes"))).otherwise(F.concat(s("size"), F.lit(" cats")))
    return parts(spark, sf_dir).where(S.is_measure(shown)).select("part")


@query("""SELECT part, priority FROM (SELECT p_partkey AS part, p_brand AS unit, p_size AS size, p_type AS label FROM part) JOIN (SELECT p_partkey AS part, CAST(CASE WHEN p_size % 3 = 0 OR p_size % 7 = 0 THEN 300 WHEN p_size % 3 = 1 THEN 100 ELSE 20 END + CASE WHEN p_size % 2 = 0 THEN 150 ELSE 0 END + CAST('0x' || substr(md5(p_partkey || '1'), 1, 4) AS INTEGER) % 41 AS INTEGER) AS priority FROM part) USING (part)
WHERE size > 30 OR unit NOT IN (SELECT p_brand FROM part WHERE p_size > 30)""")
def q_priorities(spark, sf_dir):
    """Scores of a review-first pool; each unit keeps its large items where it has any."""
    size = F.col("size")
    pool = parts(spark, sf_dir).select("part", "size", F.col("unit").alias("request"), F.lit(40).alias("target"), s("part").alias("id"), F.lit(1).alias("marks"), F.when(size % 2 == 0, "even").otherwise("odd").alias("subtopic"), F.when(size % 3 == 0, "review").when(size % 3 == 2, "correct").alias("status"), (size % 7 == 0).alias("is_bookmarked"))
    kept = soft_filter(pool, ["request"], size > 30).withColumn("subtopic", F.when(F.col("subtopic") == "even", "even").otherwise("odd"))
    scored = prepare_pool(kept.withColumn("wanted", F.col("subtopic") == "even"), mode="review_first")
    return scored.select("part", (F.col("priority") + F.when(F.col("wanted"), 150).otherwise(0)).cast("int").alias("priority"))


@query("""SELECT p_partkey AS part, CAST(p_size AS VARCHAR) AS "questionNumber", p_type AS "mainSubtopic", p_brand AS "mainTopic", CAST(CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size % 5 END AS INTEGER) AS marks, CASE WHEN p_size % 3 = 0 THEN 2024 ELSE CAST(2000 + p_size AS INTEGER) END AS year, 1 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM part""")
def q_normalize(spark, sf_dir):
    size = F.col("size")
    subs = F.concat(F.array("label", "label"), F.when(F.col("part") % 2 == 0, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>")))
    raw = parts(spark, sf_dir).select(F.concat(F.lit("p"), s("part"), F.lit("_q"), s("size")).alias("id"), F.col("unit").alias("topic"), subs.alias("subtopics"), s(size % 5).alias("marks"), F.when(size % 3 == 0, "x").otherwise(s(size + 2000)).alias("year"))
    got = normalize(raw)
    return got.select(F.regexp_extract("id", "p([0-9]+)_", 1).cast("long").alias("part"), "questionNumber", "mainSubtopic", "mainTopic", "marks", "year", F.size("subtopics").alias("n"))


REACH = """WITH RECURSIVE m AS (SELECT o_custkey AS cust, CAST(l_quantity AS INTEGER) %% 10 + 1 AS marks, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT cust, CAST(0 AS BIGINT) AS n, CAST(0 AS INTEGER) AS s FROM (SELECT DISTINCT cust FROM m) UNION SELECT r.cust, m.n, unnest([s, s + marks]) FROM r JOIN m ON m.cust = r.cust AND m.n = r.n + 1 WHERE s <= %d),
t AS (SELECT cust, CAST(sum(marks) AS INTEGER) AS every FROM m GROUP BY cust), u AS (SELECT DISTINCT cust, s FROM r WHERE s BETWEEN 1 AND %d)"""


@query(REACH % (75, 75) + " SELECT CAST(cust AS VARCHAR) AS request, CAST(75 AS BIGINT) AS total, TRUE AS whole FROM u WHERE s = 75")
def q_exam_exact_totals(spark, sf_dir):
    """Totals of the exact selections, and whether each item was used once."""
    chosen = selected(spark, sf_dir, 75, closest=False)
    return chosen.groupBy("request").agg(F.sum("marks").cast("long").alias("total"), (F.count_distinct("id") == F.count("id")).alias("whole"))


@query(REACH % (92, 92) + " SELECT CAST(u.cust AS VARCHAR) AS request, CAST(CASE WHEN any_value(every) <= 80 THEN any_value(every) ELSE arg_min(s, (abs(s - 80), s)) END AS BIGINT) AS total, TRUE AS whole FROM u JOIN t USING (cust) GROUP BY u.cust")
def q_exam_closest_totals(spark, sf_dir):
    chosen = selected(spark, sf_dir, 80)
    return chosen.groupBy("request").agg(F.sum("marks").cast("long").alias("total"), (F.count_distinct("id") == F.count("id")).alias("whole"))


@query("""WITH d AS (SELECT DISTINCT p_brand AS unit, p_size AS n FROM part), l AS (SELECT *, CASE n % 5 WHEN 0 THEN n || '.1-' || n || '.4: topic ' || n || ' end' WHEN 1 THEN n || 'A: topic ' || n || ' end' WHEN 2 THEN 'Spec ' || n || '-' || (n + 2) || ': topic ' || n || ' end' WHEN 3 THEN '1.' || n || '.2: topic ' || n || ' end' ELSE 'U3.' || n || ': topic ' || n || ' end' END AS label FROM d)
SELECT p_partkey AS part, CASE WHEN p_partkey % 11 = 0 AND p_size % 5 <> 4 THEN NULL ELSE label END AS label FROM part LEFT JOIN l ON unit = p_brand AND n = (p_partkey * 7) % 50 + 1""".replace("p_size % 5 <> 4", "((p_partkey * 7) % 50 + 1) % 5 <> 4"))
def q_number_resolve(spark, sf_dir):
    """Numbers, letters, practical codes, spec ranges and bare topics, each resolved in its unit; foreign units are refused."""
    p = parts(spark, sf_dir)

    def by(n, *forms):
        out = F.when(F.lit(False), "")
        for k, form in enumerate(forms):
            out = out.when(n % 5 == k, F.concat(*(s(x) if not isinstance(x, str) else F.lit(x) for x in form)))
        return out

    n = F.col("n")
    tail = (": topic ", n, " end")
    dim = p.select("unit", F.col("size").alias("n")).distinct().select("unit", "n", by(n, (n, ".1-", n, ".4", *tail), (n, "A", *tail), ("Spec ", n, "-", n + 2, *tail), ("1.", n, ".2", *tail), ("U3.", n, *tail)).alias("label"))
    foreign = F.col("part") % 11 == 0
    given = F.when(foreign & (n % 5 != 4), F.concat(F.lit("P2 "), s(n), F.lit(".2"))).when(F.col("part") % 3 == 0, F.concat(F.lit("Topic "), s(n), F.lit(" END"))).otherwise(by(n, ("see ", n, ".3 of it"), ("part ", n, "A here"), ("Specification ", n + 1), ("1.", n, ".2 in part"), ("u3.", n, ": it")))
    items = p.select("part", "unit", ((F.col("part") * 7) % 50 + 1).alias("n")).withColumn("given", given)
    return resolve_number(items, dim, "unit", "label", "n", ["part"], F.col("given"), foreign=foreign & (n % 5 != 4)).select("part", "label")


@query("""WITH b AS (SELECT p_partkey AS part, p_name AS t, p_size AS k, ['eq', 'names', 'hazard', 'alkane', 'acid', 'far'][p_size % 6 + 1] AS main, [['eq', 'names', 'hazard', 'alkane', 'acid', 'far'][p_partkey % 6 + 1], ['eq', 'names', 'hazard', 'alkane', 'acid', 'far'][(p_partkey // 6) % 6 + 1]] AS r FROM part),
c AS (SELECT *, list_filter(CASE WHEN r[1] = r[2] THEN r[1:1] ELSE r END, lambda x: x <> 'far') AS r1 FROM b),
d AS (SELECT part, k, CASE WHEN main <> 'far' THEN main ELSE coalesce(r1[1], 'eq') END AS main, r1 FROM c), e AS (SELECT part, k, main, list_filter(r1, lambda x: x <> main) AS r FROM d),
f AS (SELECT part, k, main, CASE WHEN k % 4 <> 0 THEN list_filter(r, lambda x: x <> 'hazard') ELSE r END AS r FROM e),
g AS (SELECT part, k, CASE WHEN k % 4 <> 0 AND main = 'hazard' AND len(r) > 0 THEN r[1] ELSE main END AS main, CASE WHEN k % 4 <> 0 AND main = 'hazard' AND len(r) > 0 THEN r[2:] ELSE r END AS r FROM f),
h AS (SELECT part, k, CASE WHEN k % 8 = 0 THEN 'hazard' ELSE main END AS main, CASE WHEN k % 8 = 0 AND main <> 'hazard' THEN list_concat([main], list_filter(r, lambda x: x <> 'hazard')) ELSE r END AS r FROM g),
i AS (SELECT *, list_filter(r, lambda x: x NOT IN ('eq', 'names'))[1] AS first FROM h),
j AS (SELECT part, k, CASE WHEN main IN ('eq', 'names') AND first IS NOT NULL THEN first ELSE main END AS main, CASE WHEN main IN ('eq', 'names') AND first IS NOT NULL THEN list_concat([main], list_filter(r, lambda x: x <> first)) ELSE r END AS r FROM i),
l AS (SELECT part, CASE WHEN main = 'eq' AND k % 3 = 0 THEN 'alkane' ELSE main END AS main, CASE WHEN main = 'eq' AND k % 3 = 0 THEN ['eq'] ELSE r END AS r FROM j)
SELECT part, main, list_filter(r, lambda x: x <> main)[1] AS related FROM l""")
def q_hierarchy_rules(spark, sf_dir):
    """Five ordered rules: labels of the unit, a label that does not belong, one that must lead, specific before generic, a rename."""
    names = F.array(*map(F.lit, ["eq", "names", "hazard", "alkane", "acid", "far"]))
    at = lambda x: F.get(names, x.cast("int"))
    k = F.col("size")
    rows = parts(spark, sf_dir).select("part", "size", at(k % 6).alias("main"), F.array(at(F.col("part") % 6), at(F.floor(F.col("part") / 6) % 6)).alias("related"))
    rules = [scoped(F.slice(names, 1, 5)), stripped("hazard", k % 4 != 0), led_by("hazard", k % 8 == 0), specific_first(["eq", "names"], ["eq", "names"]), replaced("eq", k % 3 == 0, "alkane")]
    return apply_rules(rows, "main", "related", rules).select("part", "main", F.get("related", F.lit(0)).alias("related"))


@query("""WITH b AS (SELECT p_partkey AS part, p_size % 7 AS k, CASE p_size % 7 WHEN 1 THEN 'General' WHEN 2 THEN NULL ELSE p_brand END AS ms, p_brand[1:7] AS parent, CASE WHEN p_size % 5 = 0 THEN 'Brand#1' ELSE p_brand[1:7] END AS mt, p_size % 3 AS m FROM part)
SELECT part, array_to_string(list_filter([CASE WHEN ms IS NULL OR ms = 'General' THEN 'invalid_main' END, CASE WHEN ms IS NULL OR ms = 'General' THEN 'invalid_subtopic' END, CASE WHEN ms IS NULL OR ms = 'General' THEN 'unknown_main' END, CASE WHEN m = 1 THEN 'unknown_related' END,
CASE WHEN ms IS NULL OR ms = 'General' THEN 'foreign_main' END, CASE WHEN mt <> parent THEN 'wrong_parent' END, CASE WHEN m > 0 THEN 'many_related' END, CASE WHEN m = 2 AND ms = own THEN 'main_repeated' END, CASE WHEN m = 1 THEN 'foreign_related' END, CASE WHEN m = 0 AND mt <> parent THEN 'legacy_topic' END,
CASE WHEN ms IS NULL THEN 'legacy_subtopics' END, CASE WHEN mt IS DISTINCT FROM parent THEN 'legacy_topics' END], lambda x: x IS NOT NULL), ',') AS issues FROM b JOIN (SELECT p_partkey, p_brand AS own FROM part) ON p_partkey = part""")
def q_consistency(spark, sf_dir):
    """Rows classified by maker (the head of a brand) and brand against the brands of each maker."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"), F.substring("p_brand", 1, 7).alias("maker"), F.col("p_brand").alias("brand"))
    legal = p.groupBy("maker").agg(F.collect_set("brand").alias("legal"))
    # the syllabus is small: its labels are literals of the plan, and their number is checked
    names = [sorted(r[0] for r in p.select(c).distinct().limit(10_001).collect()) for c in ("brand", "maker")]
    if max(map(len, names)) > 10_000:
        raise ValueError("more than 10,000 labels are no syllabus")
    known, makers = (F.array(*map(F.lit, held)) for held in names)
    k, m = F.col("size") % 7, F.col("size") % 3
    main = F.when(k == 1, "General").when(k != 2, F.col("brand"))
    topic = F.when(F.col("size") % 5 == 0, "Brand#1").otherwise(F.col("maker"))
    rest = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(F.lit("odd"), F.lit("odder"))).otherwise(F.array("brand", "brand"))
    rows = p.join(legal, "maker").withColumns({"main": main, "topic": topic, "rest": rest, "older": F.when(m == 0, F.col("maker")).otherwise(topic)})
    codes = consistency(F.col("topic"), F.col("main"), F.col("rest"), F.col("older"), F.col("main"), F.array("maker"), F.when(F.col("main").isNotNull(), F.array("main")), F.col("maker"), legal=F.col("legal"), known=known, topics=makers)
    return rows.select("part", F.array_join(codes, ",").alias("issues"))


@query(f"""WITH {Q}, c AS (SELECT q.*, CASE unit WHEN 'BUILDING' THEN 'WX11' WHEN 'MACHINERY' THEN 'WX12' END AS code FROM q), p AS (SELECT * FROM (VALUES ('one', 'WX11', 40, 'theory'), ('two', 'wx12', 25, 'mcq'), ('sprint', 'all', 30, 'mcq'), ('lost', 'WX19', 50, 'theory')) t(request, unit_code, target, wanted))
SELECT request, target, count(*) AS n, CAST(sum(marks) AS BIGINT) AS marks, target AS total FROM p JOIN c ON kind = wanted AND (upper(unit_code) = code OR unit_code IN ('all', 'WX19')) GROUP BY request, target""")
def q_preset_exam(spark, sf_dir):
    """Pools of presets and the total that a selection from each reaches."""
    unit = F.col("unit")
    q = questions(spark, sf_dir).withColumn("unit_code", F.when(unit == "BUILDING", "WX11").when(unit == "MACHINERY", "WX12"))
    presets = spark.createDataFrame([("one", "WX11", 40, "theory"), ("two", "wx12", 25, "mcq"), ("sprint", "all", 30, "mcq"), ("lost", "WX19", 50, "theory")], "preset string, unit_code string, target int, kind string")
    pool = preset_requests(q, presets, ["WX1"])
    sizes = pool.groupBy("request", "target").agg(many().alias("n"), F.sum("marks").cast("long").alias("marks"))
    chosen = select_exams(pool.select("request", "target", F.concat_ws(":", "id", "part", "supp", "quantity", F.col("shipped").cast("string")).alias("id"), "marks", seeded_order(F.col("id"), "3").alias("order")))
    return sizes.join(chosen.groupBy("request").agg(F.max("total").alias("total")), "request")


@query("""SELECT conv_id, count(*) AS n, count(*) FILTER (contains(lower(role || ' ' || text), 'question') OR contains(lower(role || ' ' || text), 'acceptable') OR contains(lower(role || ' ' || text), 'additional guidance') OR contains(lower(role || ' ' || text), 'user')) AS headers FROM conversations GROUP BY conv_id""")
def q_header_rows(spark, sf_dir):
    """Turns as rows of cells; one role reads as a header's word."""
    t = table(spark, sf_dir, "conversations")
    cells = F.array("role", "text", F.when(F.lower(F.concat("role", F.lit(" "), "text")).contains("user"), "Question"))
    return t.groupBy("conv_id").agg(many().alias("n"), F.count_if(S.is_header_row(cells)).alias("headers"))
