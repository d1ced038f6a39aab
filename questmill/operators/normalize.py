"""Loosely typed question rows to one schema, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import first_text, leading_int

TEXT = "id questionNumber question_number parentQuestion subPart questionImagePath question_image_url question_image image image_url crop_path markSchemeImagePath mark_scheme_image_url mark_scheme_image ms_image ms_image_url ms_crop_path paperId paper_id unit unitCode paperCode paper_code series session topic subtopic mainTopic mainSubtopic section question_type questionType stemSummary marks total_marks year hasStem".split()
LISTS = ["subtopics", "topics", "relatedSubtopics"]


def normalize(raw: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """One row a question under fixed names: aliases coalesced, numbers parsed, defaults filled.

    Empty texts, and zero or unreadable numbers, count as missing. ``valid`` (unit, subtopic) restricts related subtopics to those
    of the row's unit. Columns that the input lacks count as null; columns it has besides are dropped. Idempotent.
    """
    have = set(raw.columns)
    df = raw.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in TEXT), *(F.col(f"`{c}`").cast("array<string>").alias(c) if c in have else F.lit(None).cast("array<string>").alias(c) for c in LISTS))
    c = F.col
    tail = F.regexp_replace(F.element_at(F.split("id", "_"), -1), "(?i)^q", "")
    number = F.coalesce("questionNumber", "question_number", F.nullif(tail, F.lit("")), F.lit("1"))
    subs = F.when(F.size("subtopics") > 0, c("subtopics")).when(F.nullif("subtopic", F.lit("")).isNotNull(), F.array("subtopic")).otherwise(F.array().cast("array<string>"))
    main = first_text(c("mainSubtopic"), c("subtopic"), F.get(subs, F.lit(0)), F.lit("General"))
    topic = first_text(c("mainTopic"), c("topic"), F.lit("General"))
    related = F.coalesce("relatedSubtopics", F.slice(subs, 2, F.greatest(F.size(subs) - 1, F.lit(0))))
    marks = F.coalesce(c("marks"), c("total_marks"), F.lit("1")).try_cast("double")
    year = F.nullif(c("year").try_cast("int"), F.lit(0))
    out = df.select(
        F.coalesce("id", F.lit("")).alias("id"),
        first_text(c("paperId"), c("paper_id"), F.lit("\u0000")).alias("paperId"),
        first_text(c("unit"), c("topic"), F.lit("\u0000")).alias("unit"),
        first_text(c("unitCode"), c("paperCode"), c("paper_code"), F.lit("\u0000")).alias("unitCode"),
        F.coalesce(year, F.lit(2024)).alias("year"),
        first_text(c("series"), c("session"), F.lit("\u0000")).alias("series"),
        number.alias("questionNumber"),
        first_text(c("parentQuestion"), F.regexp_replace(number, r"(?i)\([a-z0-9]+\).*$", ""), number).alias("parentQuestion"),
        first_text(c("subPart"), F.lit("\u0000")).alias("subPart"),
        F.when(F.isnan(marks) | (marks == 0) | marks.isNull(), 1).otherwise(marks.cast("int")).alias("marks"),
        topic.alias("mainTopic"),
        main.alias("mainSubtopic"),
        F.array_distinct(F.filter(related, lambda x: x.isNotNull() & (x != "") & (x != main))).alias("relatedSubtopics"),
        F.when(F.size("topics") > 0, c("topics")).otherwise(F.array(topic)).alias("topics"),
        F.coalesce(c("hasStem").try_cast("boolean"), F.lit(False)).alias("hasStem"),
        "stemSummary",
        first_text(*(c(x) for x in "questionImagePath question_image_url question_image image image_url crop_path".split()), F.lit("\u0000")).alias("questionImagePath"),
        first_text(*(c(x) for x in "markSchemeImagePath mark_scheme_image_url mark_scheme_image ms_image ms_image_url ms_crop_path".split())).alias("markSchemeImagePath"),
        "section",
        first_text(c("questionType"), c("question_type")).alias("questionType"),
    )
    out = out.withColumns({x: F.when(c(x) == "\u0000", "").otherwise(c(x)) for x in ("paperId", "unit", "unitCode", "series", "subPart", "questionImagePath")})
    if valid is not None:
        legal = valid.groupBy("unit").agg(F.collect_set("subtopic").alias("__legal"))
        out = out.join(legal, "unit", "left").withColumn("relatedSubtopics", F.array_intersect("relatedSubtopics", F.coalesce("__legal", F.array().cast("array<string>")))).drop("__legal")
    return out.withColumn("subtopics", F.array_distinct(F.concat(F.array("mainSubtopic"), "relatedSubtopics")))


def subject(unit_code: Column, paper: Column, qid: Column, image: Column, prefixes: dict[str, list[str]], default: str) -> Column:
    """The first subject one of whose prefixes begins any of the columns."""
    out = None
    for name, starts in prefixes.items():
        hit = F.lit(False)
        for column in (unit_code, paper, qid, image):
            for s in starts:
                hit = hit | F.coalesce(F.lower(column).startswith(s) | F.lower(column).contains("/" + s), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def question_type(df_subject: Column, unit: Column, unit_code: Column, section: Column, given: Column, parent: Column, number: Column, sub: Column) -> Column:
    """mcq or theory: maths and practical units have theory only; then the section or given type; then numbers above 20 and Roman
    sub-parts are theory and the rest up to 20 mcq."""
    practical = F.lower(unit).rlike(r"unit [36]") | F.upper(unit_code).rlike(r"^W[CP]H1[36]$")
    n = F.coalesce(leading_int(parent), leading_int(number), F.lit(0))
    roman = F.lower(number).rlike(r"\([ivx]+\)") | F.lower(F.coalesce(sub, F.lit(""))).rlike(r"\([ivx]+\)")
    return (
        F.when((df_subject == "mathematics") | practical, "theory").when((section == "A") | (given == "mcq"), "mcq").when(section.isin("B", "C") | (given == "theory"), "theory").when((n > 20) | roman, "theory").when(n >= 1, "mcq").otherwise("theory")
    )


def box(coordinates: Column) -> Column:
    """An ordered box on the scale 0-1000 from [y, x, y, x] on that scale or on 0-1."""
    scale = F.when(F.forall(coordinates, lambda x: x <= 1.0), 1000.0).otherwise(1.0)
    at = lambda i: F.least(F.lit(1000.0), F.greatest(F.lit(0.0), F.get(coordinates, F.lit(i)) * scale))
    return F.struct(F.least(at(0), at(2)).alias("ymin"), F.least(at(1), at(3)).alias("xmin"), F.greatest(at(0), at(2)).alias("ymax"), F.greatest(at(1), at(3)).alias("xmax"))


def marks_of(*sources: Column) -> Column:
    """The first source above zero, else one; the order of the sources is each subject's rule."""
    return F.coalesce(*(F.when(s > 0, s) for s in sources), F.lit(1))


# How papers and mark schemes of maths print the marks of a question.
TOTAL_OF_QUESTION = r"(?i)\(Total\s+for\s+Question\s+(\d+)\s+is\s+(\d{1,2})\s*marks?\)"
TOTAL_ANY = r"(?i)\(Total\s+(?:for\s+Question\s+\d{1,2}\s+is\s+)?(\d{1,2})\s*marks?\)"
TOTAL_PLAIN = r"(?i)\(Total\s+(\d{1,2})\s*marks?\)"
SCHEME_MARKS = (TOTAL_ANY, r"(?i)\((\d{1,2})\s*marks?\)", r"(?i)\bTotal\s+(\d{1,2})\b", r"(?i)\[Total\s*(\d{1,2})\]")


def last_number(text: Column, pattern: str, group: int = 1) -> Column:
    """The last number that a pattern finds in a text; null if none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1)).cast("int")


def _total_of(text: Column, number: Column) -> Column:
    """The last total that names the question."""
    found = F.filter(F.regexp_extract_all(text, F.lit(TOTAL_OF_QUESTION), F.lit(0)), lambda t: F.regexp_extract(t, TOTAL_OF_QUESTION, 1) == number.cast("string"))
    return F.regexp_extract(F.try_element_at(found, F.lit(-1)), TOTAL_OF_QUESTION, 2).try_cast("int")


def maths_marks(number: Column, paper: Column, question: Column, scheme: Column) -> Column:
    """Marks of a maths question: the paper's total that names it, the same or a plain total in its own text, then what the mark scheme
    says, by four patterns in order. Of several matches the last counts; 0 if there is none."""
    # totals that name the question and plain ones are one pattern: the later of both in the text
    both = F.filter(F.regexp_extract_all(question, F.lit(TOTAL_ANY), F.lit(0)), lambda t: t.rlike(TOTAL_PLAIN) | (F.regexp_extract(t, TOTAL_OF_QUESTION, 1) == number.cast("string")))
    own = F.regexp_extract(F.try_element_at(both, F.lit(-1)), TOTAL_ANY, 1).try_cast("int")
    marks = F.coalesce(*(last_number(scheme, p) for p in SCHEME_MARKS))
    return F.coalesce(_total_of(paper, number), own, marks, F.lit(0))
