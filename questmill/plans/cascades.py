"""Marks of maths papers, image addresses, units and searches of questions, the asset store and the table function."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import image_url
from ..operators import normalize as N
from ..operators.exam import prepare_pool, register_build_exam, seeded_order
from ..operators.explore import SEARCH_FIELDS, UNIT_ALIASES, FilterSpec, question_in_unit
from ..operators.library import answers_of, search_tables
from ..operators.ordered import quietest
from ..registry import ORACLES, query
from ..sources.assets import listing, to_upload, upload
from ..sources.names import SUBJECTS, paper_name
from .base import Q, many, questions, table
from .exams import _pool
from .library import q_exam_closest_totals
from .streams import shared_folder


def _last(text: str, pattern: str) -> str:
    return f"TRY_CAST(regexp_extract_all({text}, '{pattern}', 1)[-1] AS INTEGER)"


@query(rf"""WITH t AS (SELECT p_partkey AS part, p_size % 30 AS n, CASE WHEN p_partkey % 3 = 0 THEN 'x (Total for Question ' || (p_size % 30) || ' is ' || (p_size % 9) || ' marks) (Total for Question ' || (p_size % 30 + 1) || ' is 3 marks)' WHEN p_partkey % 3 = 1 THEN '(Total for Question 99 is 8 marks)' END AS paper,
 CASE p_partkey % 4 WHEN 0 THEN '(Total for Question ' || (p_size % 30) || ' is 5 mark) and (Total for Question 77 is 1 marks)' WHEN 1 THEN '(total ' || (p_size % 13) || ' marks) (Total 12  marks)' ELSE '' END AS own,
 CASE p_partkey % 5 WHEN 0 THEN '(6 marks) Total 4' WHEN 1 THEN 'a Total ' || p_size || ' of' WHEN 2 THEN '[Total 9] [total' || (p_size % 20) || ']' WHEN 3 THEN '(Total for Question 3 is 2 marks) [Total 5]' END AS scheme FROM part)
SELECT part, coalesce(TRY_CAST(regexp_extract(list_filter(regexp_extract_all(paper, '{N.TOTAL_OF_QUESTION}', 0), lambda x: regexp_extract(x, '{N.TOTAL_OF_QUESTION}', 1) = CAST(n AS VARCHAR))[-1], '{N.TOTAL_OF_QUESTION}', 2) AS INTEGER),
 TRY_CAST(regexp_extract(list_filter(regexp_extract_all(own, '{N.TOTAL_ANY}', 0), lambda x: regexp_matches(x, '{N.TOTAL_PLAIN}') OR regexp_extract(x, '{N.TOTAL_OF_QUESTION}', 1) = CAST(n AS VARCHAR))[-1], '{N.TOTAL_ANY}', 1) AS INTEGER), {", ".join(_last("scheme", p) for p in N.SCHEME_MARKS)}, 0) AS marks FROM t""")
def q_maths_marks(spark, sf_dir):
    """The five sources of a maths question's marks, the last match of each."""
    part, size = F.col("p_partkey"), F.col("p_size")
    n = (size % 30).cast("string")
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    paper = F.when(part % 3 == 0, text("x (Total for Question ", n, " is ", size % 9, " marks) (Total for Question ", size % 30 + 1, " is 3 marks)")).when(part % 3 == 1, "(Total for Question 99 is 8 marks)")
    own = F.when(part % 4 == 0, text("(Total for Question ", n, " is 5 mark) and (Total for Question 77 is 1 marks)")).when(part % 4 == 1, text("(total ", size % 13, " marks) (Total 12  marks)")).otherwise("")
    scheme = F.when(part % 5 == 0, "(6 marks) Total 4").when(part % 5 == 1, text("a Total ", size, " of")).when(part % 5 == 2, text("[Total 9] [total", size % 20, "]")).when(part % 5 == 3, "(Total for Question 3 is 2 marks) [Total 5]")
    return table(spark, sf_dir, "part").select(part.alias("part"), N.maths_marks(size % 30, paper, own, scheme).alias("marks"))


VERSIONS = {"k7": "3", "crop a.png": "9", "x": "2"}
PATHS = ["/extracted/a b/crop a.png", "crops_math/é(1)/x.png?w=2", "https://host/x.png", "  ", "/other/x%20y''!.png", "crops_physics/p~*.png?v=1"]
SHOWN = [p.replace("''", "'") for p in PATHS]


@query(f"""WITH t AS (SELECT p_partkey AS part, 'k' || (p_size % 9) AS k, trim({"[" + ", ".join(f"'{p}'" for p in PATHS) + "]"}[CAST(p_partkey % 6 AS INTEGER) + 1]) AS path FROM part), m AS (SELECT *, MAP {VERSIONS!r} AS versions, string_split(path, '?')[1] AS bare FROM t),
v AS (SELECT *, regexp_replace(bare, '^.*/', '') AS name FROM m), w AS (SELECT *, coalesce(versions[k], versions[bare], versions[name], versions[regexp_replace(name, '\\.[^/.]+$', '')]) AS version FROM v),
f AS (SELECT part, CASE WHEN path = '' OR contains(path, '?v=') OR version IS NULL THEN path ELSE path || CASE WHEN contains(path, '?') THEN '&' ELSE '?' END || 'v=' || version END AS p FROM w),
r AS (SELECT part, p, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS q FROM f), e AS (SELECT part, p, array_to_string(list_transform(string_split(string_split(q, '?')[1], '/'), lambda x: replace(replace(replace(replace(replace(url_encode(url_decode(x)), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')), '/') AS enc, coalesce('?' || string_split(q, '?')[2], '') AS rest FROM r)
SELECT part, CASE WHEN p = '' THEN '' WHEN starts_with(p, 'https://') THEN p WHEN starts_with(enc, '/extracted/') OR starts_with(enc, '/crops_math/') THEN 'https://files' || enc || rest ELSE enc || rest END AS url FROM e""")
def q_image_url(spark, sf_dir):
    part = F.col("p_partkey")
    path = F.get(F.array(*map(F.lit, SHOWN)), (part % 6).cast("int"))
    versions = F.create_map(*(F.lit(x) for pair in VERSIONS.items() for x in pair))
    url = image_url([F.lit(None).cast("string"), path], F.concat(F.lit("k"), (F.col("p_size") % 9).cast("string")), versions, "https://files", ["/extracted/", "/crops_math/"])
    return table(spark, sf_dir, "part").select(part.alias("part"), url.alias("url"))


WANTED = ["p1", "Unit 2", "wma 12", "3", " unit 4: Other", "S1", "(5)"]


def _unit_sql(want: str) -> str:
    want = want.strip().lower()
    checks = [f"u = '{want}'", f"(c <> '' AND replace(c, ' ', '') = '{want.replace(' ', '')}')", f"regexp_extract(u, '\\(([a-z0-9]+)\\)', 1) = '{want}'", f"trim(string_split(u, ':')[1]) = '{want.split(':')[0].strip()}'"]
    if want in UNIT_ALIASES:
        checks.append(f"c = '{UNIT_ALIASES[want]}'")
    digit = next((w.strip("():") for w in want.split() if w.strip("():") in "123456"), "")
    if digit:
        checks.append(f"regexp_extract(u, '\\b([1-6])\\b', 1) = '{digit}'")
    return " OR ".join(checks)


@query(f"""WITH t AS (SELECT p_partkey AS part, lower(trim(CASE WHEN p_size % 3 = 0 THEN 'Unit ' || (p_size % 7) || ': Pure' WHEN p_size % 3 = 1 THEN 'Mathematics (P' || (p_size % 5) || ')' ELSE 'Unit' || (p_size % 6) END)) AS u, lower(CASE WHEN p_partkey % 4 = 0 THEN 'WMA1' || (p_size % 4) WHEN p_partkey % 4 = 1 THEN 'WST01' ELSE '' END) AS c FROM part)
{" UNION ALL ".join(f"SELECT {k} AS wanted, count(*) AS n, CAST(sum(part) AS BIGINT) AS parts FROM t WHERE {_unit_sql(w)}" for k, w in enumerate(WANTED))}""")
def q_question_in_unit(spark, sf_dir):
    """Which parts belong to each of several wanted units."""
    size = F.col("p_size")
    unit = F.when(size % 3 == 0, F.concat(F.lit("Unit "), (size % 7).cast("string"), F.lit(": Pure"))).when(size % 3 == 1, F.concat(F.lit("Mathematics (P"), (size % 5).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("Unit"), (size % 6).cast("string")))
    code = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("WMA1"), (size % 4).cast("string"))).when(F.col("p_partkey") % 4 == 1, "WST01")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), unit.alias("u"), code.alias("c"))
    hits = F.array_compact(F.array(*(F.when(question_in_unit(F.col("u"), F.col("c"), w), k) for k, w in enumerate(WANTED))))
    found = p.select("part", F.explode(hits).alias("wanted")).groupBy("wanted").agg(many().alias("n"), F.sum("part").alias("parts"))
    every = spark.range(len(WANTED)).select(F.col("id").cast("int").alias("wanted"))
    return every.join(found, "wanted", "left").select("wanted", F.coalesce("n", F.lit(0)).alias("n"), "parts")


@query(f"""WITH {Q} SELECT unit, count(*) AS n, CAST(sum(marks) AS BIGINT) AS marks FROM q WHERE contains(lower(CAST(number AS VARCHAR)), '1#2') OR contains(lower(topic), '#12') OR contains(lower(subtopic), '#12') OR contains(lower(session || ' ' || year), '#12') OR contains(lower('Brand#' || (part % 40)), '#12') GROUP BY unit""")
def q_search_all_fields(spark, sf_dir):
    """A search through every field of a question and its related labels."""
    q = questions(spark, sf_dir)
    none = F.lit(None).cast("string")
    rows = q.select("unit", "marks", F.col("number").cast("string").alias("question_number"), "topic", none.alias("main_topic"), "subtopic", none.alias("main_subtopic"), none.alias("stem_summary"), F.concat("session", F.lit(" "), F.col("year").cast("string")).alias("series"), "session", none.alias("paper_code"), F.array(F.concat(F.lit("Brand#"), (F.col("part") % 40).cast("string"))).alias("related"))
    hits = rows.where(FilterSpec(search="#12").predicate(SEARCH_FIELDS, ("related",)))
    return hits.groupBy("unit").agg(many().alias("n"), F.sum("marks").cast("long").alias("marks"))


@query(ORACLES[q_exam_closest_totals.__name__])
def q_build_exam(spark, sf_dir):
    """The closest selections of every customer by the table function, in SQL."""
    register_build_exam(spark)
    _pool(spark, sf_dir, 80).createOrReplaceTempView("questmill_pool")
    chosen = spark.sql("SELECT * FROM build_exam(TABLE(questmill_pool) PARTITION BY pmod(hash(request), 4096) ORDER BY (request, `order`, id))")
    return chosen.groupBy("request").agg(F.sum("marks").cast("long").alias("total"), (F.count_distinct("id") == F.count("id")).alias("whole"))


@query("""WITH c AS (SELECT o_custkey AS cust, l_linenumber AS number, CAST(l_quantity AS INTEGER) % 10 + 1 AS marks, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT *, bool_or(number <= 2) OVER (PARTITION BY cust) AS choice FROM c), s AS (SELECT * FROM k WHERE NOT choice OR number <= 2), t AS (SELECT *, bool_or(marks = 3) OVER (PARTITION BY cust) AS has FROM s), u AS (SELECT * FROM t WHERE NOT has OR marks = 3),
g AS (SELECT cust, bool_or(choice) AS choice, bool_or(has) AS has, sum(marks) FILTER (quantity >= 40) AS fresh, count(*) FILTER (quantity >= 40) AS n, count(*) AS every FROM u GROUP BY cust)
SELECT CAST(cust AS VARCHAR) AS request, CASE WHEN n > 0 AND fresh >= 12 THEN n ELSE every END AS rows, array_to_string(list_filter([CASE WHEN NOT choice THEN 'MCQ-only filter' END, CASE WHEN NOT has THEN 'Selected topic/subtopic filter' END, CASE WHEN n > 0 AND fresh >= 12 THEN NULL WHEN n = 0 THEN 'Unattempted-only mode (no unattempted questions remaining)' WHEN n < every THEN 'Unattempted-only mode (supplemented with attempted questions)' END], lambda x: x IS NOT NULL), '; ') AS relaxed FROM g""")
def q_relaxed_constraints(spark, sf_dir):
    """What each customer's request had to give up."""
    q = _pool(spark, sf_dir, 12)
    bits = F.split("id", ":")
    rows = q.select("request", "target", "id", "marks", F.when(F.regexp_extract("id", r"_q(\d+):", 1).cast("int") <= 2, "mcq").otherwise("theory").alias("kind"), F.lit("t").alias("topic"), F.col("marks").cast("string").alias("subtopic"), F.lit("u").alias("unit"), F.lit("p").alias("paper"), F.when(bits[3].cast("double") < 40, "correct").alias("status"), F.lit(False).alias("is_bookmarked"))
    ready = prepare_pool(rows, mode="unattempted_only", structure="mcq_sprint", subtopics=["3"])
    return ready.groupBy("request").agg(many().alias("rows"), F.first(F.array_join("relaxed", "; ")).alias("relaxed"))


@query("""SELECT 'crops_web/' || page_id || CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' ELSE '' END AS key, strlen(html) + CASE WHEN page_id % 5 = 0 THEN 4 ELSE 0 END AS size, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS content_type, CASE WHEN page_id % 5 = 0 THEN 'no-cache' ELSE 'max-age=60' END AS cache_control FROM pages""")
def q_asset_store(spark, sf_dir):
    """Pages uploaded as assets, a fifth of them again at another size, then listed."""
    ending = F.when(F.col("page_id") % 3 == 0, ".png").when(F.col("page_id") % 3 == 1, ".JPG").otherwise("")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("crops_web/"), F.col("page_id").cast("string"), ending).alias("key"), F.encode("html", "UTF-8").alias("content"))
    store = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    upload(to_upload(pages, listing(spark, store), "max-age=60", "no-cache"), store)
    longer = F.when(F.col("page_id") % 5 == 0, F.concat("content", F.lit(b"more"))).otherwise(F.col("content"))
    upload(to_upload(pages.withColumn("content", longer), listing(spark, store), "max-age=60", "no-cache"), store)
    return listing(spark, store)


FILES = ["WCH1{u}-01{v}_que_2023.pdf", "wch1{u}{v} rms.pdf", "x_u{u}{v}_qp.pdf", "Unit {u}{v} unused.pdf", "au{u}.pdf", "WPH1{u}_01{v}.pdf", "Physics_U{u}{v}_MS.pdf", "wma1{u}-01{v}.pdf", "QuestionPaper-Pure MathematicsP{u}{v}.pdf", "maths-m1{v}_ms.pdf", "24_QP_S1{v}.pdf", "WME01-01{v} unused.pdf", "b p{u}{v} c.pdf", "nothing.pdf"]


def _name_sql(subject: str) -> str:
    names = SUBJECTS[subject]
    cases = lambda value: "CASE " + " ".join(f"WHEN regexp_matches(f, '{p}') THEN {value(p, unit)}" for p, unit in names.patterns) + " END"
    unit = cases(lambda p, unit: str(unit) if unit else f"CAST(regexp_extract(f, '{p}', 1) AS INTEGER)")
    variant = cases(lambda p, unit: f"upper(regexp_extract(f, '{p}', {1 if unit else 2}))")
    literal = lambda x: "NULL" if x is None else f"'{x}'"
    base = f"coalesce([{', '.join(map(literal, names.codes))}][u], {literal(names.unknown[1])})"
    return f"""SELECT part, '{subject}' AS subject, coalesce(u, {names.unknown[0] or 'NULL'}) AS unit, variant, base || CASE WHEN variant = 'UNUSED' THEN '_UNUSED' ELSE variant END AS unit_code, base || '/01' || variant AS paper_code
 FROM (SELECT *, CASE WHEN base IS NOT NULL AND contains(f, 'unused') THEN 'UNUSED' ELSE coalesce(v, '') END AS variant FROM (SELECT *, {base} AS base FROM (SELECT part, f, {unit} AS u, {variant} AS v FROM t)))"""


@query(f"""WITH t AS (SELECT p_partkey AS part, lower(replace(replace({FILES!r}[CAST(p_partkey % {len(FILES)} AS INTEGER) + 1], '{{u}}', CAST(p_size % 7 AS VARCHAR)), '{{v}}', ['', 'R', 'a'][CAST(p_size % 3 AS INTEGER) + 1])) AS f FROM part) {" UNION ALL ".join(map(_name_sql, SUBJECTS))}""")
def q_paper_names(spark, sf_dir):
    """What each subject's patterns read from file names of every kind."""
    size = F.col("p_size")
    given = F.get(F.array(*map(F.lit, FILES)), (F.col("p_partkey") % len(FILES)).cast("int"))
    file = F.replace(F.replace(given, F.lit("{u}"), (size % 7).cast("string")), F.lit("{v}"), F.get(F.array(F.lit(""), F.lit("R"), F.lit("a")), size % 3))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), file.alias("file"))
    out = [p.select("part", F.lit(s).alias("subject"), paper_name(F.col("file"), s).alias("n")) for s in SUBJECTS]
    return out[0].union(out[1]).union(out[2]).select("part", "subject", "n.unit", "n.variant", "n.unit_code", "n.paper_code")


@query("""WITH b AS (SELECT user_id, event_id, ts, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS band FROM events)
SELECT user_id, arg_min(event_id, (band, -epoch_us(ts), -event_id)) AS event_id, CAST(min(band) AS BIGINT) AS band FROM b GROUP BY user_id""")
def q_quietest_band(spark, sf_dir):
    """The event of each user around which five events have the least value."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.floor("value").alias("ink"))
    return quietest(e, ["user_id"], ["ts", "event_id"], F.col("ink"), 2, 2).select("user_id", "row.event_id", "band")


@query("""WITH e AS (SELECT event_id, event_id % 6 AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN kind = 5 THEN NULL WHEN kind = 3 THEN 1 WHEN kind = 4 THEN 0 ELSE 2 END AS n, CASE WHEN kind IN (4, 5) THEN NULL ELSE k END AS k FROM e""")
def q_fenced_answers(spark, sf_dir):
    """Answers in lists and objects, in code blocks and bare; one kind is no JSON."""
    one, kind = F.col("props"), F.col("event_id") % 6
    both = F.concat(F.lit("["), one, F.lit(', {"k": -1}]'))
    fence = lambda c, lang: F.concat(F.lit(f" ```{lang}\n"), c, F.lit("\n``` "))
    held = F.concat(F.lit('{"questions": '), both, F.lit("}"))
    raw = F.when(kind == 0, both).when(kind == 1, fence(both, "json")).when(kind == 2, fence(held, "")).when(kind == 3, one).when(kind == 4, F.lit('{"questions": []}')).otherwise("no answer")
    got = answers_of(raw, "struct<k:bigint>")
    return table(spark, sf_dir, "events").select("event_id", got.alias("a")).select("event_id", F.when(F.col("a").isNotNull(), F.size("a")).alias("n"), F.get("a", F.lit(0))["k"].alias("k"))


@query(r"""SELECT 'nation' AS "table", CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE contains(lower(n_name), 'an') OR contains(CAST(n_regionkey AS VARCHAR), 'an') UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region WHERE contains(lower(r_name), 'an')
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(replace(p_type, 'S', 'An')), 'an')""")
def q_lookup_search(spark, sf_dir):
    """One search through three lookup tables; types are written as formulas."""
    nation, region, part = (table(spark, sf_dir, t) for t in ("nation", "region", "part"))
    formula = F.concat(F.lit(r"\frac{"), F.replace("p_type", F.lit("S"), F.lit("A_{n}")), F.lit("}"))
    return search_tables({"nation": (nation, F.col("n_nationkey"), [F.col("n_name"), F.col("n_regionkey")], []), "region": (region, F.col("r_regionkey"), [F.col("r_name")], []), "part": (part, F.col("p_partkey"), [F.col("p_name")], [formula])}, " AN ")
