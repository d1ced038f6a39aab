"""Papers read from lines: every line of a document is a block, some of them set as the openings of questions and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as Y
from ..registry import query
from .base import table

HEIGHT = 842.0
#: Line n of a document as a block: by its length and number it opens a question, a part of some kind, a stem or a section.
BLOCKS = """l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
b AS (SELECT doc, n AS line, n // 6 AS page, CASE (length(s) + n) % 8 WHEN 0 THEN ((n // 3) % 39 + 1) || '.' || chr(9) || 'The ' || s WHEN 1 THEN ((n // 3) % 39 + 1) || ':' || chr(9) || '(' || chr(CAST(97 + n % 3 AS INTEGER)) || ')' || chr(9) || s
 WHEN 2 THEN '(' || chr(CAST(97 + n % 5 AS INTEGER)) || ') ' || s || ' (' || (n % 7 + 1) || ')' WHEN 3 THEN '(' || chr(CAST(97 + n % 5 AS INTEGER)) || ')(' || ['i', 'ii', 'iii'][n % 3 + 1] || ') ' || s WHEN 4 THEN ((n // 3) % 39 + 1) || ': A text that investigates ' || s
 WHEN 5 THEN CASE WHEN n % 3 = 0 THEN 'Section A ' || s WHEN n % 3 = 1 THEN 'Section B ' || s ELSE '(Total for Question ' || ((n // 3) % 39 + 1) || ' = 1 mark)' END ELSE s END AS text,
 CAST(40 + n % 50 AS DOUBLE) AS x0, CAST(60 + (n % 6) * 120 AS DOUBLE) AS y0, CAST(500 AS DOUBLE) AS x1, CAST(160 + (n % 6) * 120 AS DOUBLE) AS y1 FROM l),
t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM b)"""
#: The layout's records, written as one window over each document.
RECORDS = rf"""{BLOCKS}, r AS (SELECT *, CASE WHEN bool_or(contains(upper(text), 'SECTION A') OR regexp_matches(text, '{Y.ONE_MARK}')) OVER p THEN 'A' WHEN bool_or(contains(upper(text), 'SECTION B')) OVER p THEN 'B' END AS section,
 first_value(CAST(nullif(regexp_extract(t, '{Y.STEM}', 1), '') AS INTEGER) IGNORE NULLS) OVER (PARTITION BY doc, page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS stem, min(line) OVER p AS first,
 CAST(nullif(regexp_extract(t, '{Y.COMPOUND}', 1), '') AS INTEGER) AS pair, CAST(nullif(regexp_extract(t, '{Y.CHOICE}', 1), '') AS INTEGER) AS single, nullif(regexp_extract(t, '{Y.PART}', 1), '') AS letter FROM t WINDOW p AS (PARTITION BY doc, page)),
k AS (SELECT *, CASE WHEN pair <= 35 THEN 'compound' WHEN single <= 35 THEN 'choice' WHEN letter IS NOT NULL THEN 'part' END AS kind FROM r),
o AS (SELECT *, CASE kind WHEN 'compound' THEN pair WHEN 'choice' THEN single ELSE CASE WHEN line = first THEN stem END END AS opened FROM k),
c AS (SELECT *, last_value(opened IGNORE NULLS) OVER w AS parent, last_value(CASE WHEN opened IS NOT NULL THEN line END IGNORE NULLS) OVER w AS question, last_value(CASE WHEN kind IS NOT NULL THEN line END IGNORE NULLS) OVER w AS record,
 CASE kind WHEN 'compound' THEN '(' || regexp_extract(t, '{Y.COMPOUND}', 2) || ')' WHEN 'part' THEN '(' || letter || ')' || coalesce('(' || nullif(regexp_extract(t, '{Y.ROMAN_PART}', 1), '') || ')', '') ELSE '' END AS sub FROM o WINDOW w AS (PARTITION BY doc ORDER BY line ROWS UNBOUNDED PRECEDING)),
h AS (SELECT doc, record AS line, count(*) AS n_lines, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS n_words, max(line) AS last_line FROM c WHERE record IS NOT NULL GROUP BY 1, 2),
rec AS (SELECT c.doc, c.line, page, kind, coalesce(parent, 20) || sub AS number, coalesce(parent, 20) AS parent, sub, CASE WHEN kind = 'part' THEN coalesce(CAST(nullif(regexp_extract(t, '{Y.MARKS}', 1), '') AS INTEGER), CASE WHEN section = 'A' THEN 1 ELSE 2 END) ELSE 1 END AS marks, section,
 CASE kind WHEN 'part' THEN stem IS NOT NULL OR parent IS NOT NULL WHEN 'choice' THEN FALSE ELSE coalesce(stem = parent, FALSE) END AS depends_on_stem, CASE WHEN kind = 'choice' THEN 'none' WHEN stem IS NOT NULL THEN 'current_page' WHEN kind = 'part' THEN 'previous_page' ELSE 'none' END AS stem_source,
 CAST(floor(greatest(0, y0 - 10) / 842 * 1000) AS INTEGER) AS "top", CAST(floor(least(842, y1 + CASE WHEN kind = 'part' THEN 200 ELSE 160 END) / 842 * 1000) AS INTEGER) AS bottom, CAST(floor(greatest(0, x0 - 15) / 595 * 1000) AS INTEGER) AS "left", CASE WHEN kind = 'part' THEN 960 ELSE CAST(floor(least(595, x1 + 60) / 595 * 1000) AS INTEGER) END AS "right",
 coalesce(question, -1) AS question, n_lines, n_words, last_line FROM c JOIN h ON h.doc = c.doc AND h.line = c.line WHERE kind IS NOT NULL)"""


def blocks(spark, sf_dir):
    """Lines of ``documents`` as blocks of pages of six."""
    l = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("n", "s"))  # noqa: E741
    n = F.col("n")
    number = (F.floor(n / 3) % 39 + 1).cast("string")
    letter = lambda k: F.chr(97 + n % k)
    roman = F.get(F.array(F.lit("i"), F.lit("ii"), F.lit("iii")), n % 3)
    section = F.when(n % 3 == 0, F.concat(F.lit("Section A "), "s")).when(n % 3 == 1, F.concat(F.lit("Section B "), "s")).otherwise(F.concat(F.lit("(Total for Question "), number, F.lit(" = 1 mark)")))
    shown = {
        0: F.concat(number, F.lit(".\tThe "), "s"),
        1: F.concat(number, F.lit(":\t("), letter(3), F.lit(")\t"), "s"),
        2: F.concat(F.lit("("), letter(5), F.lit(") "), "s", F.lit(" ("), (n % 7 + 1).cast("string"), F.lit(")")),
        3: F.concat(F.lit("("), letter(5), F.lit(")("), roman, F.lit(") "), "s"),
        4: F.concat(number, F.lit(": A text that investigates "), "s"),
        5: section,
    }
    text = F.coalesce(*(F.when((F.length("s") + n) % 8 == k, v) for k, v in shown.items()), "s")
    y0 = (60 + (n % 6) * 120).cast("double")
    return l.select("doc", n.cast("long").alias("line"), F.floor(n / 6).alias("page"), text.alias("text"), (40 + n % 50).cast("double").alias("x0"), y0.alias("y0"), F.lit(500.0).alias("x1"), (y0 + 100).alias("y1"), F.lit(595.0).alias("page_width"), F.lit(HEIGHT).alias("page_height"))


@query(f"WITH {RECORDS} SELECT * FROM rec")
def q_layout_records(spark, sf_dir):
    got = Y.parse_layout(blocks(spark, sf_dir))
    return got.select("doc", "line", "page", "kind", "number", "parent", "sub", "marks", "section", "depends_on_stem", "stem_source", "box.*", "question", "n_lines", "n_words", "last_line")


@query(f"WITH {RECORDS} SELECT doc, question, parent, count(*) AS n_records, CAST(sum(marks) AS BIGINT) AS marks, CAST(sum(n_words) AS BIGINT) AS n_words, min(page) AS first_page, max(page) AS last_page, max(last_line) AS last_line FROM rec GROUP BY ALL")
def q_layout_questions(spark, sf_dir):
    """Parts carried up to their question."""
    return Y.question_rollup(Y.parse_layout(blocks(spark, sf_dir)))


@query(rf"""WITH {RECORDS}, m AS (SELECT doc, page, CAST(floor((y0 - 8) * (1000 / 842.0::DOUBLE)) AS INTEGER) AS edge FROM t WHERE regexp_matches(t, '{Y.MARKER}')),
f AS (SELECT doc, page, CAST(floor(least(0.92 * 842, min(y0) FILTER (regexp_matches(t, '{Y.FOOTER}') OR (y0 > 0.85 * 842 AND regexp_matches(t, '^\s*\d{{1,2}}\s*$')))) * (1000 / 842.0::DOUBLE)) AS INTEGER) AS footer FROM t GROUP BY 1, 2),
tot AS (SELECT doc, page, CAST(regexp_extract(t, '{Y.TOTAL}', 1) AS INTEGER) AS parent, CAST(floor(least(0.95 * 842, max(y1) + 10) * (1000 / 842.0::DOUBLE)) AS INTEGER) AS total FROM t WHERE regexp_matches(t, '{Y.TOTAL}') GROUP BY 1, 2, 3),
x AS (SELECT rec.*, (SELECT min(edge) FROM m WHERE m.doc = rec.doc AND m.page = rec.page AND m.edge >= rec.top + 26) AS edge, lead("top") OVER (PARTITION BY rec.doc, rec.page, kind <> 'part' ORDER BY "top", line) AS nxt FROM rec),
z AS (SELECT x.*, footer, total FROM x LEFT JOIN f ON f.doc = x.doc AND f.page = x.page LEFT JOIN tot ON tot.doc = x.doc AND tot.page = x.page AND tot.parent = x.parent)
SELECT doc, page, line, "top", CASE WHEN kind = 'part' THEN least(bottom, coalesce(edge, bottom)) WHEN nxt IS NOT NULL THEN greatest("top" + 50, nxt - 10) WHEN total IS NOT NULL THEN total WHEN least(920, footer - 10) > "top" + 50 THEN greatest(bottom, least(920, footer - 10)) ELSE bottom END AS bottom FROM z""")
def q_snap_boxes(spark, sf_dir):
    """Boxes that end where the next marker, choice, total line or footer lets them."""
    b = blocks(spark, sf_dir)
    return Y.snap_boxes(Y.parse_layout(b), b, page_height=HEIGHT)
