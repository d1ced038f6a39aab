"""Structure of papers: hierarchical numbers, sub-part letters, noise, boundaries, groups, classifier batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ROMAN

# Words and signs of measure that follow a number where no question begins, and notices that pages carry.
UNITS = "cm dm mm m g mg kg mol j kj pa kpa v s sec second seconds min minute minutes hour hours h day days week weeks month months year years drop drops time times mark marks".split()
SIGNS = "°%"
NOTICES = ["DO NOT WRITE", "*P", "BLANK PAGE", "Turn over"]
#: A line's number, with or without the word question before it, and the power or fraction after a unit.
NUMBERED, POWER = r"^\s*(?:q(?:uestion\s|\.)?\s*)?\d{1,3}[.:]?\s+", r"[0-9/−–-]*"


def _roman(x: Column) -> Column:
    return x.isin(ROMAN[:10])


def letters_of(label: Column) -> Column:
    """Bracketed parts of a label, in lower case and order."""
    return F.regexp_extract_all(F.lower(label), F.lit(r"\(([a-z0-9]+)\)"), F.lit(1))


def alpha_letter(label: Column) -> Column:
    """The first bracketed part of letters that is no Roman numeral; null if there is none."""
    return F.get(F.filter(letters_of(label), lambda x: x.rlike("^[a-z]+$") & ~_roman(x)), F.lit(0))


def hierarchical_id(number: Column, parent: Column, sub: Column, active_parent: Column, active_letter: Column) -> Column:
    """struct<full, parent, sub> of a raw label, read in the context carried from the rows before.

    A label may be whole (``20(b)(iv)``, ``14a``), a sub-part alone (``(b)(i)``), or a number with its sub-part beside it. A lone
    Roman part belongs to the active letter, unless it is ``i`` after ``h``, where it is a letter itself.
    """
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^(?:question|q|\*+)\s*", ""), r"\*+", ""))
    q, p, s = bare(number), bare(parent), F.regexp_replace(F.trim(F.coalesce(sub, F.lit(""))), r"\*+", "")
    above = F.coalesce(F.nullif(p, F.lit("")), F.nullif(F.regexp_replace(F.trim(F.coalesce(active_parent, F.lit(""))), r"\*+", ""), F.lit("")))
    marks = r"\([A-Za-z0-9]+\)(?:\s*\([A-Za-z0-9]+\))*"
    squeezed = F.regexp_replace(q, r"\s+", "")
    own = F.regexp_extract(squeezed, r"^(\d+)", 1)
    has_letter = F.coalesce(active_letter, F.lit("")) != ""
    at_letter = F.concat(F.lit("("), active_letter, F.lit(")("))

    def placed(parts: Column, plain: Column) -> Column:
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        letter_i = (first == "i") & active_letter.isin("h", "i")
        return F.when((F.size(parts) == 1) & _roman(first) & has_letter & ~letter_i, F.concat(at_letter, first, F.lit(")"))).when((F.size(parts) >= 2) & _roman(first) & has_letter, F.concat(at_letter, second, F.lit(")"))).otherwise(plain)

    tail = F.regexp_replace(squeezed, r"^\d+", "")
    beside = F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0))
    beside_text = F.concat(F.lit("("), F.array_join(beside, ")("), F.lit(")"))

    def out(full: Column, parent_: Column, sub_: Column) -> Column:
        return F.struct(full.alias("full"), parent_.alias("parent"), sub_.alias("sub"))

    whole = placed(letters_of(squeezed), tail)
    lettered = F.concat(F.lit("("), F.lower(tail), F.lit(")"))
    alone = placed(letters_of(squeezed), squeezed)
    joined = placed(beside, beside_text)
    top = F.coalesce(above, F.lit("1"))
    return (
        F.when(q.rlike(rf"^\d+\s*{marks}$"), out(F.concat(own, whole), own, whole))
        .when(q.rlike(r"^\d+\s*[A-Za-z]$"), out(F.concat(own, lettered), own, lettered))
        .when(q.rlike(rf"^{marks}$"), out(F.concat(top, alone), top, alone))
        .when(q.rlike(r"^\d+$") & (F.size(beside) > 0), out(F.concat(q, joined), q, joined))
        .when(q.rlike(r"^\d+$"), out(q, q, F.lit("")))
        .otherwise(out(q, F.coalesce(above, q), s))
    )


def is_measure(text: Column) -> Column:
    """A number with a unit, which is no question header."""
    low = F.lower(text)
    word = F.regexp_extract(low, rf"{NUMBERED}([a-z]+){POWER}(?![a-z0-9_])", 1)
    return word.isin(UNITS) | low.rlike(rf"{NUMBERED}[{SIGNS}]{POWER}\b")


def is_noise(text: Column, y: Column, page_height: Column) -> Column:
    """Margins, bar codes, totals, dot leaders and running notes."""
    out = (y > page_height - 55) | (y < 32) | text.rlike(r"(?i)^\s*\(?total\b.*\d+\s*marks?\)?") | text.rlike(r"^[.\s_]{4,}$")
    for mark in NOTICES:
        out = out | text.contains(mark)
    return out


# What the header row of a table of answers says.
HEADER_WORDS, HEADER_ALONE = ("question", "acceptable", "additional guidance"), "number"


def is_header_row(cells: Column) -> Column:
    """Whether a row of cells heads a table of answers; cells that are null or empty say nothing."""
    text = F.lower(F.array_join(F.filter(F.coalesce(cells, F.array().cast("array<string>")), lambda c: c != ""), " "))
    out = F.trim(text) == HEADER_ALONE
    for word in HEADER_WORDS:
        out = out | text.contains(word)
    return out


def blank_pages(blocks: DataFrame, by: list[str], least_words: int = 5) -> DataFrame:
    """Pages with hardly a word once noise is gone: (keys, words, blank)."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x.rlike("[A-Za-z]{2,}")))
    kept = F.when(~is_noise(F.col("text"), F.col("y0"), F.col("page_height")), words).otherwise(0)
    return blocks.groupBy(*by).agg(F.sum(kept).alias("words"), F.bool_or(F.col("text").contains("BLANK PAGE")).alias("says_blank")).select(*by, "words", (F.col("says_blank") | (F.col("words") < least_words)).alias("blank"))


def marker_rank(label: Column) -> Column:
    """(number, letter, Roman) ranks of a label; successors compare greater."""
    parts = letters_of(label)
    roman = F.try_element_at(F.filter(parts, lambda x: _roman(x)), F.lit(-1))
    return F.struct(
        F.coalesce(F.regexp_extract(label, r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("number"),
        F.coalesce(F.ascii(alpha_letter(label)) - 96, F.lit(0)).alias("letter"),
        F.coalesce(F.array_position(F.array(*map(F.lit, ROMAN)), roman), F.lit(0)).cast("int").alias("roman"),
    )


def clamp_to_next(df: DataFrame, by: list[str], order: list, start: str, end: str, gap: float = 4.0) -> DataFrame:
    """Ends cut to just above the next start of the group."""
    nxt = F.lead(start).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(end, F.least(F.col(end), F.coalesce(nxt - gap, F.col(end))))


def guard_parent(df: DataFrame, by: list[str], order: list, header: Column, known: Column) -> DataFrame:
    """The running parent number: the last known header, never lower than one before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("parent_no", F.max(F.when(known, header)).over(w))


def letter_groups(df: DataFrame, by: list[str], order: list, letter: Column) -> DataFrame:
    """Islands of a letter and the Roman parts after it: ``letter_group`` counts the changes of the letter."""
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__l", F.last(letter, ignorenulls=True).over(past))
    change = F.when(F.col("__l").eqNullSafe(F.lag("__l").over(Window.partitionBy(*by).orderBy(*order))), 0).otherwise(1)
    return rows.withColumn("__c", change).withColumn("letter_group", F.sum("__c").over(past)).drop("__l", "__c")


def unit_category(units: Column) -> Column:
    """unit3_6, as, ia2 or mixed_or_all of a list of units, by name, code or digit."""
    one = lambda u: F.coalesce(F.nullif(F.regexp_extract(u, r"(?i)unit\s*([1-6])", 1), F.lit("")), F.nullif(F.regexp_extract(u, r"(?i)w[a-z]{2}1([1-6])", 1), F.lit("")), F.nullif(F.regexp_extract(u, r"^\s*([1-6])\s*$", 1), F.lit("")))
    numbers = F.filter(F.transform(F.coalesce(units, F.array().cast("array<string>")), one), lambda x: x.isNotNull())
    every = lambda *n: F.forall(numbers, lambda x: x.isin(*n))
    return F.when(F.size(numbers) == 0, "mixed_or_all").when(every("3", "6"), "unit3_6").when(every("4", "5"), "ia2").when(every("1", "2"), "as").otherwise("mixed_or_all")


def unit_code(text: Column, aliases: dict[str, str], pattern: str, default: str) -> Column:
    """A unit code by an exact alias, an alias within the text, a pattern, or the default."""
    low = F.lower(F.trim(text))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, code in aliases.items():
        out = out.when(low == name.lower(), code)
    for name, code in aliases.items():
        out = out.when(low.contains(name.lower()), code)
    return F.coalesce(out, F.nullif(F.upper(F.regexp_extract(low, pattern, 0)), F.lit("")), F.lit(default))


def clean_title(c: Column) -> Column:
    """A subtopic without its number or the word topic before it."""
    return F.trim(F.regexp_replace(c, r"(?i)^(\d+(\.\d+)*(-\d+(\.\d+)*)?:\s*|topic\s+\d+:\s*)", ""))


def series_label(session: Column, year: Column, series: Column, code: Column) -> Column:
    """``Jan 2024 · WCH11``; the series as given where the session is unknown."""
    low = F.lower(F.coalesce(session, F.lit("")))
    short = F.when(low.contains("jan"), "Jan").when(low.contains("june") | low.contains("may"), "June").when(low.contains("oct") | low.contains("nov"), "Oct").otherwise(F.nullif(session, F.lit("")))
    head = F.coalesce(F.concat(short, F.lit(" "), year.cast("string")), series)
    return F.concat_ws(" · ", head, F.nullif(code, F.lit("")))


def split_by_cache(items: DataFrame, cache: DataFrame, legal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items whose cached label (id, unit, label) is of their unit and still legal (unit, label), and the others."""
    good = cache.join(legal, ["unit", "label"], "left_semi")
    return items.join(good, ["id", "unit"]), items.join(good.select("id", "unit"), ["id", "unit"], "left_anti")


def repair(items: DataFrame, legal: DataFrame) -> DataFrame:
    """Labels that are not legal in their unit become the unit's first."""
    first = legal.groupBy("unit").agg(F.min("label").alias("__first"))
    ok = items.join(legal.withColumn("__ok", F.lit(True)), ["unit", "label"], "left").join(first, "unit", "left")
    return ok.withColumn("label", F.when(F.col("__ok"), F.col("label")).otherwise(F.coalesce("__first", F.col("label")))).drop("__ok", "__first")


def classify_in_batches(items: DataFrame, classify: Callable[[str, list[str]], list[str]], size: int = 65) -> DataFrame:
    """(id, unit, label) by an external classifier, which is called on the executors with the texts of one unit, ``size`` at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for unit, rows in frame.groupby("unit", sort=False):
                for at in range(0, len(rows), size):
                    part = rows.iloc[at : at + size]
                    yield pd.DataFrame({"id": part["id"], "unit": unit, "label": classify(unit, part["text"].tolist())})

    return items.select("id", "unit", "text").repartition("unit", F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions("unit").mapInPandas(run, "id string, unit string, label string")
