"""Phrases in documents, hazard checks of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curated as C
from ..operators.phrases import hazard_issues, phrase_hits
from ..registry import query
from .base import many, table

#: A place of a phrase may overlap another of its own ("the the" in "atthe the the"), so SQL splits by the first word and its blank, which
#: never overlap themselves, and looks for the second word behind each.
#: Phrases are the first two words of each benchmark text and of each question a user asked.
PHRASES = r"(SELECT DISTINCT lower(regexp_extract(text, '^([^\s]+ [^\s]+) ', 1)) AS p FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations WHERE turn = 0 AND role = 'user'))"


@query(rf"""WITH RECURSIVE p AS (SELECT p FROM {PHRASES} WHERE p <> ''), d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, t, p, split_part(p, ' ', 1) || ' ' AS one, split_part(p, ' ', 2) AS two, string_split(t, split_part(p, ' ', 1) || ' ') AS parts FROM d JOIN p ON contains(t, p)),
h AS (SELECT doc_id, t, p, unnest(list_transform(list_filter(range(1, len(parts)), lambda k: starts_with(parts[k + 1] || CASE WHEN k + 1 < len(parts) THEN one ELSE '' END, two)), lambda k: coalesce(list_sum(list_transform(parts[1:k], lambda x: length(x))), 0) + (k - 1) * length(one))) AS start FROM s),
w AS (SELECT doc_id, CAST(start AS BIGINT) AS start, length(p) AS len, p FROM h WHERE NOT (start > 0 AND regexp_matches(substr(t, CAST(start AS BIGINT), 1), '[\pL\pN]')) AND NOT regexp_matches(substr(t, CAST(start AS BIGINT) + length(p) + 1, 1), '[\pL\pN]')),
l AS (SELECT doc_id, start, max(len) AS len, arg_max(p, len) AS p FROM w GROUP BY doc_id, start), n AS (SELECT a.*, b.start AS next FROM (SELECT *, start + len AS stop FROM l) a ASOF LEFT JOIN l b ON a.doc_id = b.doc_id AND a.stop <= b.start),
g AS (SELECT n.* FROM n JOIN (SELECT doc_id, min(start) AS start FROM l GROUP BY doc_id) f ON f.doc_id = n.doc_id AND f.start = n.start UNION ALL SELECT n.* FROM g JOIN n ON n.doc_id = g.doc_id AND n.start = g.next)
SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS places, CAST(sum(len) AS BIGINT) AS covered, count(DISTINCT p) AS phrases FROM g GROUP BY doc_id""")
def q_phrase_hits(spark, sf_dir):
    """Where documents hold the openings of benchmark texts and of questions, longest first."""
    asked = table(spark, sf_dir, "conversations").where("turn = 0 and role = 'user'").select("text")
    phrases = table(spark, sf_dir, "benchmark").select("text").union(asked).select(F.regexp_extract("text", r"^([^\s]+ [^\s]+) ", 1).alias("p"))
    hits = phrase_hits(table(spark, sf_dir, "documents"), ["doc_id"], "text", phrases, "p").select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
    return hits.groupBy("doc_id").agg(many().alias("n"), F.sum(F.col("start").cast("long")).alias("places"), F.sum(F.col("length").cast("long")).alias("covered"), F.countDistinct("phrase").alias("phrases"))


ASKED = ["State one hazard of the acid.", "Give the name of the product.", "Write an equation for the combustion of butane.", "The toxic gas is kept in a fume cupboard.", "Calculate the mass.", "", "Show the hydrogenation of propene.", "Give the name of this toxic acid.", "State a precaution for the disposal of polymers."]
LABELS = [C.HAZARD, C.EQUATIONS, C.NAMING, C.FUELS, C.ALKENES, "2.1:"]


def _in(label: str, *codes: str) -> str:
    return "(" + " OR ".join(f"starts_with({label}, '{c}')" for c in codes) + ")"


GENERAL = (C.EQUATIONS, C.OLD_EQUATIONS, C.HAZARD, C.NAMING)


@query(f"""WITH t AS (SELECT p_partkey AS part, CASE WHEN p_size % 4 = 0 THEN 'Unit 2' ELSE 'Unit 1' END AS unit, {LABELS!r}[CAST(p_partkey % 6 AS INTEGER) + 1] AS main, list_slice([{LABELS!r}[CAST(p_size % 6 AS INTEGER) + 1], {LABELS!r}[CAST((p_partkey + p_size) % 5 AS INTEGER) + 1]], 1, p_partkey % 3) AS related,
 {ASKED!r}[CAST(p_size % 9 AS INTEGER) + 1] AS one, CASE WHEN p_partkey % 5 = 0 THEN {ASKED!r}[CAST(p_partkey % 7 AS INTEGER) + 1] ELSE '' END AS two FROM part),
b AS (SELECT *, trim(one || ' ' || two) AS txt, unit = 'Unit 1' AS first, {_in("main", C.HAZARD)} AS hazard, {_in("main", *GENERAL)} AS general, len(list_filter(related, lambda r: NOT {_in("r", *GENERAL)})) > 0 AS specific, len(list_filter(related, lambda r: {_in("r", C.HAZARD)})) > 0 AS also FROM t),
i AS (SELECT part, unnest(list_filter([CASE WHEN list_contains(list_append(related, main), '2.1:') THEN 'foreign_label' END, CASE WHEN general AND specific AND NOT (hazard AND first AND regexp_matches(txt, '{C.HAZARD_WORDS}')) THEN 'general_main' END,
 CASE WHEN general AND NOT specific AND {_in("main", C.EQUATIONS)} AND first THEN CASE WHEN regexp_matches(one, '{C.FUEL_WORDS}') THEN 'general_main {C.FUELS}' WHEN regexp_matches(one, '{C.ALKENE_WORDS}') THEN 'general_main {C.ALKENES}' END END,
 CASE WHEN hazard OR also THEN CASE WHEN NOT first THEN 'bleed_other_unit' WHEN txt <> '' AND NOT regexp_matches(txt, '{C.HAZARD_WORDS}') THEN 'bleed_no_hazard' WHEN NOT hazard AND one <> '' AND NOT regexp_matches(one, '{C.HAZARD_WORDS}') THEN 'bleed_prompt' WHEN regexp_matches(one, '{C.NAMES_ASKED}') AND NOT regexp_matches(one, '{C.HAZARD_ASKED}') THEN 'bleed_naming' END END,
 CASE WHEN first AND NOT hazard AND regexp_matches(one, '{C.HAZARD_ASKED}') AND NOT regexp_matches(one, '{C.NO_HAZARD}') THEN 'missing_hazard' END, CASE WHEN len(related) > 1 THEN 'many_related' END], lambda x: x IS NOT NULL)) AS issue FROM b)
SELECT issue, count(*) AS n, min(part) AS first FROM i GROUP BY issue""")
def q_hazard_issues(spark, sf_dir):
    """Bleeds, missing hazards and general main labels of parts with prompts."""
    part, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda held, n: F.get(F.array(*map(F.lit, held)), n.cast("int"))
    related = F.slice(F.array(pick(LABELS, size % 6), pick(LABELS, (part + size) % 5)), F.lit(1), (part % 3).cast("int"))
    rows = table(spark, sf_dir, "part").select(part.alias("part"), F.when(size % 4 == 0, "Unit 2").otherwise("Unit 1").alias("unit"), pick(LABELS, part % 6).alias("main"), related.alias("related"), pick(ASKED, size % 9).alias("prompt"), F.when(part % 5 == 0, pick(ASKED, part % 7)).alias("scheme"))
    foreign = F.array_contains(F.array_append("related", F.col("main")), "2.1:")
    issues = hazard_issues(F.col("unit"), F.col("main"), F.col("related"), foreign, F.col("prompt"), F.col("scheme"))
    return rows.select("part", F.explode(issues).alias("issue")).groupBy("issue").agg(many().alias("n"), F.min("part").alias("first"))
