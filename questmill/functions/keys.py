"""Keys: canonical question numbers, slugs, natural order, seasons, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman numerals in rank order.
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]


def canonical_id(c: Column) -> Column:
    """Join key of a question number: lower case; from the word ``clip`` on, a leading ``q``/``question`` and marks removed."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"(?s)\bclip\b.*$", "")
    c = F.regexp_replace(c, r"^(question|q)", "")
    return F.regexp_replace(c, r"[*()\[\].\s_/†‡§#-]", "")


def slug(c: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one underscore; none at the ends; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""))


def natural_key(c: Column) -> Column:
    """A string whose plain order is natural order: digit runs, without leading zeros, come after their
    length (so numbers of any size compare right), letters in lower case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(F.regexp_replace(x, "^0+(?=.)", "")).cast("string"), 8, "0"), F.regexp_replace(x, "^0+(?=.)", ""))).otherwise(x)), "")


def leading_int(c: Column) -> Column:
    """The integer a string begins with, or null."""
    return F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("int")


def season(c: Column) -> Column:
    """January, October or May/June from any spelling of a session; else the text with a capital."""
    low = F.lower(F.trim(c))
    return F.when(low.contains("jan"), "January").when(low.contains("oct") | low.contains("nov"), "October").when(low.contains("may") | low.contains("jun"), "May/June").otherwise(F.initcap(low))


def session_name(c: Column) -> Column:
    """First match of the ordered table jan, june, may, oct; any other text with a capital."""
    low = F.lower(F.trim(c))
    return F.when(low.contains("jan"), "January").when(low.contains("jun"), "June").when(low.contains("may"), "May").when(low.contains("oct"), "October").otherwise(F.initcap(low))


def series_weight(c: Column) -> Column:
    """Later sessions of a year weigh more: October 3, May/June 2, January 1, else 0."""
    low = F.lower(c)
    return F.when(low.contains("oct"), 3).when(low.contains("jun") | low.contains("may"), 2).when(low.contains("jan"), 1).otherwise(0)


def paper_id(unit: Column, variant: Column, year: Column, session: Column) -> Column:
    """unit[_variant]_year_session in lower case; empty variants leave no mark."""
    return F.lower(F.concat_ws("_", unit, F.nullif(variant, F.lit("")), year.cast("string"), F.regexp_replace(session, r"[^a-zA-Z0-9]+", "")))


def question_id(paper: Column, number: Column) -> Column:
    return F.concat(paper, F.lit("_q"), slug(number))


def parent_number(number: Column) -> Column:
    """``20`` of ``20(a)(i)``; the number itself where it has no sub-part."""
    return F.coalesce(F.nullif(F.regexp_replace(number, r"(?i)\([a-z0-9]+\).*$", ""), F.lit("")), number)


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def roman_rank(c: Column) -> Column:
    """1 for i, 2 for ii, …; 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ROMAN)), F.lower(c)), F.lit(0)).cast("int")
