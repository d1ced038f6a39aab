"""Papers read from the layout of their lines alone: what a line opens, which record it belongs to, where a record ends.

``blocks`` have (doc, page, line, text, x0, y0, x1, y1, page_width, page_height); ``line`` counts through a document. Work on lines
is done by page; a document's pages meet in windows that hold one row a page, so a document of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How lines of printed papers begin and end, and the margins of the boxes around them.
STEM = r"(?i)^(\d{1,2}):\s*([^\n\r]+(?:is about|investigates|concerns|shows|studies)[^\n\r]*)"
COMPOUND = r"^(\d{1,2})[:.\t]\s*\(([a-z])\)"
CHOICE = r"^\*?\s*(\d{1,2})[\t:.]\s*[A-Z]"
PART, ROMAN_PART = r"^\(([a-z])\)", r"^\([a-z]\)\s*\(([ivx]+)\)"
MARKS = r"\((\d+)\)\s*$"
ONE_MARK = r"\bQuestion \d+ = 1 mark\b"
TOTAL = r"(?i)\(Total for Question\s+(\d+)\s*="
MARKER = r"^(?:\d{1,2}\s*)?(?:(?:\([a-z]\)\s*)?\([ivx]{1,4}\)|\([a-z]\))"
FOOTER = r"(?i)rough working|TOTAL FOR SECTION A|TOTAL FOR PAPER|Turn over|\*P\d+"
MARGIN, CHOICE_BELOW, PART_BELOW = 10, 160, 200


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def read_lines(blocks: DataFrame, *, most: int = 35, choice_needs_section: bool = False, practical: bool = False) -> DataFrame:
    """Blocks with what each opens: ``kind`` (compound, choice, header, part or null), its ``number`` and ``sub`` label, the page's
    ``section`` and ``stem`` number.

    A compound line is a number with its part; a choice is a number up to ``most`` before a sentence, and only on pages of
    section A where ``choice_needs_section``; there, other numbers are headers: they are the parent of parts and no record.
    """
    t = F.regexp_replace("text", r"^\s+|\s+$", "")
    page = Window.partitionBy("doc", "page")
    rows = blocks.withColumn("__t", t)
    a = F.lit(False) if practical else F.max(F.upper("text").contains("SECTION A") | F.col("text").rlike(ONE_MARK)).over(page)
    b = F.lit(True) if practical else F.max(F.upper("text").contains("SECTION B")).over(page)
    stem = F.first(_found(F.col("__t"), STEM).cast("int"), ignorenulls=True).over(page.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("section", F.when(a, "A").when(b, "B")).withColumn("stem", stem)
    pair, single = _found(F.col("__t"), COMPOUND).cast("int"), _found(F.col("__t"), CHOICE).cast("int")
    in_a = F.col("section").eqNullSafe("A")
    choice = (single <= most) & in_a if choice_needs_section else single <= most
    header = single.isNotNull() & ((single > most) | (b if choice_needs_section else F.lit(False))) if choice_needs_section else F.lit(False)
    kind = F.when(pair <= most, "compound").when(choice, "choice").when(header, "header").when(_found(F.col("__t"), PART).isNotNull(), "part")
    rows = rows.withColumn("kind", kind)
    letter = F.when(F.col("kind") == "compound", F.regexp_extract("__t", COMPOUND, 2)).when(F.col("kind") == "part", F.regexp_extract("__t", PART, 1))
    roman = F.when(F.col("kind") == "part", _found(F.col("__t"), ROMAN_PART))
    sub = F.concat(F.lit("("), letter, F.lit(")"), F.coalesce(F.concat(F.lit("("), roman, F.lit(")")), F.lit("")))
    number = F.when(F.col("kind") == "compound", pair).when(F.col("kind").isin("choice", "header"), single)
    return rows.withColumn("number", number).withColumn("sub", F.coalesce(sub, F.lit(""))).withColumn("printed", _found(F.col("__t"), MARKS).cast("int")).drop("__t")


def carried_by_page(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` of the document so far, the line itself included; lines by page, then pages by document."""
    past = Window.partitionBy("doc", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__v", value).withColumn("__in", F.last("__v", ignorenulls=True).over(past))
    ends = rows.groupBy("doc", "page").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("line"))).alias("__end"))
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("doc", "page", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    return rows.join(ends, ["doc", "page"]).withColumn(name, F.coalesce("__in", "__before")).drop("__v", "__in", "__before")


def parse_layout(blocks: DataFrame, *, most: int = 35, choice_needs_section: bool = False, practical: bool = False, default_parent: int = 20) -> DataFrame:
    """One row for each record (question or part): doc, line, page, kind, number, parent, sub, marks, section, depends_on_stem,
    stem_source, box, question (line that opened its parent), and of all lines up to the next record n_lines, n_words, last_line.

    A part belongs to the number that was opened last, be it on an earlier page; the number in a page's stem holds from the top of
    that page. Lines before the first record belong to none. Texts that are null or empty open nothing; documents are read apart.
    """
    rows = read_lines(blocks.withColumn("text", F.coalesce("text", F.lit(""))), most=most, choice_needs_section=choice_needs_section, practical=practical)
    first = F.col("line") == F.min("line").over(Window.partitionBy("doc", "page"))
    opened = F.coalesce("number", F.when(first, F.col("stem")))
    rows = carried_by_page(rows, F.when(opened.isNotNull(), F.struct(opened.alias("number"), F.col("line"))), "parent_at")
    is_record = F.col("kind").isin("compound", "choice", "part")
    rows = carried_by_page(rows, F.when(is_record, F.col("line")), "record")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    held = rows.where("record is not null").groupBy("doc", F.col("record").alias("line")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(words).alias("n_words"), F.max("line").alias("last_line"))
    part, choice = F.col("kind") == "part", F.col("kind") == "choice"
    parent = F.coalesce("parent_at.number", F.lit(default_parent))
    has_stem = F.col("stem").isNotNull()
    x = lambda c: F.floor(c / F.col("page_width") * 1000).cast("int")
    y = lambda c: F.floor(c / F.col("page_height") * 1000).cast("int")
    box = F.struct(
        y(F.greatest(F.lit(0.0), F.col("y0") - MARGIN)).alias("top"),
        x(F.greatest(F.lit(0.0), F.col("x0") - 15)).alias("left"),
        y(F.least("page_height", F.col("y1") + F.when(part, PART_BELOW).otherwise(CHOICE_BELOW))).alias("bottom"),
        F.when(part, 960).otherwise(x(F.least("page_width", F.col("x1") + 60))).alias("right"),
    )
    out = rows.where(is_record).select(
        "doc", "line", "page", "kind",
        F.concat(parent.cast("string"), "sub").alias("number"),
        parent.alias("parent"),
        "sub",
        F.when(part, F.coalesce("printed", F.when(F.col("section").eqNullSafe("A"), 1).otherwise(2))).otherwise(1).alias("marks"),
        "section",
        F.when(part, has_stem | F.col("parent_at").isNotNull()).when(choice, False).otherwise(F.coalesce(F.col("stem") == parent, F.lit(False))).alias("depends_on_stem"),
        F.when(choice, "none").when(has_stem, "current_page").when(part, "previous_page").otherwise("none").alias("stem_source"),
        box.alias("box"),
        F.coalesce("parent_at.line", F.lit(-1)).alias("question"),
    )
    return out.join(held, ["doc", "line"])


def question_rollup(records: DataFrame) -> DataFrame:
    """Records carried up to the question that was open: parts, marks, words, pages from and to."""
    return records.groupBy("doc", "question", "parent").agg(F.count(F.lit(1)).alias("n_records"), F.sum("marks").alias("marks"), F.sum("n_words").alias("n_words"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.max("last_line").alias("last_line"))


def next_at(rows: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, name: str) -> DataFrame:
    """Each row with the smallest ``mark`` of its group that is not below its ``at``: one ordered pass over both."""
    extra = [c for c in rows.columns if c not in by]
    both = rows.select(*by, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.struct(*extra).alias("__row")).unionByName(marks.select(*by, F.col(mark).alias("__at"), F.lit(1).alias("__side")), allowMissingColumns=True)
    following = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(0, Window.unboundedFollowing)
    seen = both.withColumn(name, F.first(F.when(F.col("__side") == 1, F.col("__at")), ignorenulls=True).over(following))
    return seen.where("__side = 0").select(*by, "__row.*", name)


def snap_boxes(records: DataFrame, blocks: DataFrame, *, page_height: float, gap: int = 10, clear: int = 8, least: int = 50, lowest: int = 920) -> DataFrame:
    """Records (doc, page, line, kind, parent, box) with ``top`` and ``bottom`` moved to the nearest free boundaries, without overlap.

    A part ends ``clear`` points above the next part's marker that lies 20 points or more below its own top. A choice reaches down
    to ``gap`` above the next choice, but is at least ``least`` high; the last one of a page ends just below its total line, or,
    where it has none, above the first footer of the page. Records of a page come in the order of their tops; no record goes past the
    top of the next one of its page, save by the least height of a choice.
    """
    scale = 1000 / page_height
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    # an edge is the scaled place of a boundary; parts keep clear of markers below them
    markers = blocks.where(text.rlike(MARKER)).select("doc", "page", F.floor((F.col("y0") - clear) * scale).cast("int").alias("edge"))
    footer = text.rlike(FOOTER) | ((F.col("y0") > 0.85 * page_height) & text.rlike(r"^\s*\d{1,2}\s*$"))
    floors = blocks.groupBy("doc", "page").agg(F.floor(F.least(F.lit(0.92 * page_height), F.min(F.when(footer, F.col("y0")))) * scale).cast("int").alias("footer"))
    totals = blocks.select("doc", "page", F.regexp_extract(text, TOTAL, 1).alias("parent"), "y1").where("parent <> ''").groupBy("doc", "page", F.col("parent").cast("int").alias("parent"))
    totals = totals.agg(F.floor(F.least(F.lit(0.95 * page_height), F.max("y1") + 10) * scale).cast("int").alias("total"))
    rows = records.select("doc", "page", "line", "kind", "parent", F.col("box.top").alias("top"), F.col("box.bottom").alias("bottom"))
    rows = rows.withColumn("from", F.col("top") + F.lit(int((20 + MARGIN - clear) * scale)))
    rows = next_at(rows, markers, ["doc", "page"], "from", "edge", "edge").join(floors, ["doc", "page"], "left").join(totals, ["doc", "page", "parent"], "left")
    choice = F.col("kind") != "part"
    ordered = Window.partitionBy("doc", "page", choice).orderBy("top", "line")
    rows = rows.withColumn("next_top", F.lead("top").over(ordered))
    tall = F.col("top") + least
    last = F.coalesce("total", F.when(F.least(F.lit(lowest), F.col("footer") - gap) > tall, F.greatest("bottom", F.least(F.lit(lowest), F.col("footer") - gap))).otherwise(F.col("bottom")))
    reach = F.when(F.col("next_top").isNotNull(), F.greatest("bottom", F.greatest(tall, F.col("next_top") - gap))).otherwise(last)
    cut = F.when(F.col("next_top").isNotNull(), F.greatest(tall, F.least(reach, F.col("next_top") - gap))).otherwise(reach)
    return rows.select("doc", "page", "line", "top", F.when(choice, cut).otherwise(F.least("bottom", F.coalesce("edge", "bottom"))).alias("bottom"))
