"""The explorer: filter specification to predicate, search, facets, sort, page."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import natural_key, series_weight
from ..functions.text import matches_any


#: The fields that a search looks into, and the short codes of maths units (fixed values).
SEARCH_FIELDS = ("question_number", "topic", "main_topic", "subtopic", "main_subtopic", "stem_summary", "series", "session", "paper_code")
UNIT_ALIASES = {"p1": "wma11", "p2": "wma12", "p3": "wma13", "p4": "wma14", "m1": "wme01", "s1": "wst01"}


@dataclass(frozen=True)
class FilterSpec:
    """What a user asked for; an empty list or text asks for nothing."""

    units: list[str] = field(default_factory=list)
    subtopics: list[str] = field(default_factory=list)
    years: list[int] = field(default_factory=list)
    series: list[str] = field(default_factory=list)
    search: str = ""
    kind: str = ""
    primary_only: bool = False
    status: str = ""
    bookmarked: bool = False

    def predicate(self, search_fields: tuple[str, ...] = ("id", "unit", "topic", "subtopic"), search_arrays: tuple[str, ...] = ()) -> Column:
        """One conjunction over the normalised question columns: pushed to the scan as far as it reaches. A search looks into
        ``search_fields`` (``SEARCH_FIELDS`` are all that a question has) and the elements of ``search_arrays``."""
        parts = [F.lit(True)]
        if self.units:
            parts.append(F.col("unit").isin(self.units))
        if self.subtopics:
            main = F.col("subtopic").isin(self.subtopics)
            parts.append(main if self.primary_only else main | F.arrays_overlap("related", F.array(*map(F.lit, self.subtopics))))
        if self.years:
            parts.append(F.col("year").isin(self.years))
        if self.series:
            parts.append(reduce(lambda a, b: a | b, (series_bucket(F.col("session"), s) for s in self.series)))
        if self.kind:
            parts.append(F.col("kind") == self.kind)
        if self.search:
            found = matches_any(self.search, *(F.col(c) for c in search_fields))
            low = self.search.lower()
            parts.append(reduce(lambda a, b: a | b, (F.coalesce(F.exists(c, lambda x: F.lower(x).contains(low)), F.lit(False)) for c in search_arrays), found))
        return reduce(lambda a, b: a & b, parts)

    def user_predicate(self) -> Column:
        """What depends on a user's progress; a missing status counts as unattempted."""
        ok = F.lit(True)
        if self.status:
            ok = ok & (F.coalesce("status", F.lit("unattempted")) == self.status)
        if self.bookmarked:
            ok = ok & F.coalesce("is_bookmarked", F.lit(False))
        return ok


def series_bucket(session: Column, bucket: str) -> Column:
    """Whether a session belongs to a bucket: January, May/June, October, or any that holds the text."""
    low, want = F.lower(session), bucket.lower()
    if "jan" in want:
        return low.contains("jan")
    if "may" in want or "jun" in want:
        return low.contains("may") | low.contains("jun")
    if "oct" in want:
        return low.contains("oct")
    return low.contains(want)


def latest_first() -> list[Column]:
    """Unit in natural order, then the latest year and series, then paper and number in natural order."""
    return [natural_key(F.col("unit")), F.col("year").desc(), series_weight(F.col("session")).desc(), F.col("paper"), F.col("number"), F.col("id")]


def unit_matches(unit: Column, wanted: str) -> Column:
    """A unit by its name, without regard to spaces, by what stands before a colon, or by its first digit 1-6."""
    low, want = F.lower(unit), wanted.lower()
    bare = F.regexp_replace(low, r"\s", "")
    squeezed = bare == "".join(want.split())
    head = F.split(bare, ":")[0] == "".join(want.split(":")[0].split())
    digit = next((c for c in want if c in "123456"), None)
    by_digit = F.regexp_extract(low, r"\b([1-6])\b", 1) == digit if digit else F.lit(False)
    return squeezed | head | by_digit


def question_in_unit(unit: Column, code: Column, wanted: str) -> Column:
    """Whether a question is of a wanted unit: by name or code without regard to case and spaces, by the short code of a maths unit, be it an
    alias of the code or in brackets in the name, by what stands before a colon, or by the first number 1 to 6. Nulls match nothing."""
    want = wanted.strip().lower()
    if not want:
        return F.lit(False)
    low, low_code = F.lower(F.trim(F.coalesce(unit, F.lit("")))), F.lower(F.trim(F.coalesce(code, F.lit(""))))
    digit = re.search(r"\b([1-6])\b", want)
    head = want.split(":")[0].strip()
    checks = [low == want, (low_code != "") & (F.regexp_replace(low_code, r"\s", "") == re.sub(r"\s", "", want)), F.regexp_extract(low, r"\(([a-z0-9]+)\)", 1) == want]
    if want in UNIT_ALIASES:
        checks.append(low_code == UNIT_ALIASES[want])
    if head:
        checks.append(F.trim(F.split(low, ":")[0]) == head)
    if digit:
        checks.append(F.regexp_extract(low, r"\b([1-6])\b", 1) == digit[1])
    return reduce(lambda a, b: a | b, checks)


def facet(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def facet_many(df: DataFrame, buckets: dict[str, Column], name: str = "bucket") -> DataFrame:
    """Counts of buckets that may overlap: a row counts in each that it belongs to."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in buckets.items())))
    return df.select(F.explode(names).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def facet_all(df: DataFrame, by: str, every: DataFrame) -> DataFrame:
    """Counts for every value of the dimension, zeros included."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
