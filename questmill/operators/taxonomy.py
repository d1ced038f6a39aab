"""Taxonomy as a dimension: code index, resolver cascade, keyword rules, hierarchy rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import fallback_join

# Forms of syllabus numbers in labels and in given codes.
THREE_PARTS = r"\b\d+\.\d+\.\d+[a-z]?\b"
TWO_PARTS = r"(?<!\.)\b\d+\.\d+[a-z]?\b(?!\.)"
LEADING = r"^([A-Z0-9]+(?:\s+[0-9]+(?:\.[0-9]+)+[a-z]?|[0-9]+(?:\.[0-9]+)+[a-z]?))"
UNIT_AND_NUMBER = r"\b(?:P[1-4]|M[1-3]|S[1-3]|WPH\d\d|WCH\d\d)\s+\d+\.\d+[a-z]?\b"
NUMBER_RANGE = r"(\d+)\.(\d+)\s*-\s*(?:\1\.)?(\d+)"
LETTER_AT_START, LETTER = r"^([0-9]+[A-Za-z])\b", r"\b(\d+[A-Za-z])\b"
PRACTICAL = r"^(U\d+\.\d+)"
SPEC_RANGE, SPEC_IN_LABEL, SPEC_GIVEN = r"Spec\s+\d+\s*-\s*\d+", r"Spec\s+(\d+)", r"\bSpec(?:ification)?\s*(\d+)\b"
KEYWORD = r"[a-z0-9]{3,}"
INVALID_LABELS = ["general", "unknown", "none"]


def code_index(dim: DataFrame, unit: str, label: str) -> DataFrame:
    """Every code under which a label is known in its unit: the whole label, its head before a colon, its first word. Longer codes
    win over shorter, and of equal codes the first label in order."""
    forms = F.array(F.struct(F.lit(1).alias("p"), F.lower(F.col(label)).alias("code")), F.struct(F.lit(2).alias("p"), F.lower(F.trim(F.split(F.col(label), ":")[0])).alias("code")), F.struct(F.lit(3).alias("p"), F.lower(F.split(F.col(label), r"\s+")[0]).alias("code")))
    rows = dim.select(F.col(unit).alias("unit"), F.col(label).alias("label"), F.explode(forms).alias("f")).select("unit", "label", "f.*").where("code <> ''")
    return rows.groupBy("unit", "code").agg(F.min(F.struct("p", "label")).alias("m")).select("unit", "code", F.col("m.label").alias("label"))


def resolve(items: DataFrame, index: DataFrame, keys: list[str], unit: Column, given: Column) -> DataFrame:
    """The label that a given text stands for in its unit: as a whole, by its head, by its first word. Null if none."""
    low = F.lower(F.trim(given))
    code = lambda c: F.concat_ws("\u0001", unit, c)
    forms = [code(low), code(F.trim(F.split(low, ":")[0])), code(F.split(low, r"\s+")[0])]
    known = index.select(F.concat_ws("\u0001", "unit", "code").alias("key"), "label")
    return fallback_join(items, known, keys, forms, "key")


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match in upper case; null if none."""
    return F.nullif(F.upper(F.regexp_extract(text, f"(?i){pattern}", group)), F.lit(""))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(group)), F.upper)


def _run(low: Column, high: Column, head: Column) -> Column:
    """Codes of a head and each number of a range; none if it runs backwards."""
    low, high = low.try_cast("long"), high.try_cast("long")
    return F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>")), lambda n: F.concat(head, n.cast("string")))


def number_index(dim: DataFrame, unit: str, label: str, place: str) -> DataFrame:
    """(unit, code, label): every number, letter or head that stands for a label of its unit, in upper case.

    Whole labels, heads before a colon, leading tokens, three-part numbers and practical codes: of several labels the last in place.
    Then two-part numbers, ranges written out and ``Spec n`` with its ranges: the first. Then letter codes that only one label has.
    """
    p = F.trim(F.split(F.col(label), ":")[0])
    lead, practical, spec = _found(p, LEADING, 1), _found(p, PRACTICAL, 1), F.regexp_extract(p, f"(?i){SPEC_RANGE}", 0)
    strong = F.concat(F.array(F.upper(label), F.upper(p), lead, F.get(F.split(lead, r"\s+"), F.lit(1)), practical, F.substr(practical, F.lit(2))), _all(p, THREE_PARTS))

    part = lambda r, g: F.regexp_extract(r, NUMBER_RANGE, g)
    ranges = F.flatten(F.transform(F.regexp_extract_all(p, F.lit(NUMBER_RANGE), F.lit(0)), lambda r: _run(part(r, 2), part(r, 3), F.concat(part(r, 1), F.lit(".")))))
    numbers = F.concat(_run(F.regexp_extract(spec, r"(\d+)\s*-", 1), F.regexp_extract(spec, r"-\s*(\d+)", 1), F.lit("")), F.regexp_extract_all(p, F.lit(f"(?i){SPEC_IN_LABEL}"), F.lit(1)))
    weak = F.concat(_all(p, TWO_PARTS), ranges, F.transform(numbers, lambda n: F.concat(F.lit("SPEC "), n)), F.transform(numbers, lambda n: F.concat(F.lit("SPEC"), n)))
    rows = dim.select(F.col(unit).alias("unit"), F.col(label).alias("label"), F.col(place).alias("place"), strong.alias("s"), weak.alias("w"))
    codes = lambda column, kind, at: rows.select("unit", "label", F.lit(kind).alias("kind"), at.alias("at"), F.explode(column).alias("code"))
    letters = letter_groups_of(dim, unit, label, place).where("size(held) = 1").select("unit", F.col("held")[0]["label"].alias("label"), F.lit(3).alias("kind"), F.lit(0).alias("at"), "code")
    every = codes("s", 1, -F.col("place")).unionByName(codes("w", 2, F.col("place"))).unionByName(letters).where("code <> ''")
    return every.groupBy("unit", "code").agg(F.min_by("label", F.struct("kind", "at", "label")).alias("label"))


def letter_groups_of(dim: DataFrame, unit: str, label: str, place: str) -> DataFrame:
    """(unit, code, held): labels of a unit whose head begins with the same letter code, in place order."""
    code = _found(F.trim(F.split(F.col(label), ":")[0]), LETTER_AT_START, 1)
    rows = dim.select(F.col(unit).alias("unit"), code.alias("code"), F.struct(F.col(place).alias("place"), F.col(label).alias("label")).alias("x")).where("code is not null")
    return rows.groupBy("unit", "code").agg(F.array_sort(F.collect_list("x")).alias("held"))


def resolve_number(items: DataFrame, dim: DataFrame, unit: str, label: str, place: str, keys: list[str], given: Column, *, foreign: Column | None = None, strict: Column | None = None) -> DataFrame:
    """Items with the ``label`` of their unit (column ``unit``) that a given text stands for, or null.

    In this order: the whole text, its head, a three-part number, a unit with a number, a two-part number, a letter code, of labels
    with the same letter code the one that shares most words, a spec number, and the first label that holds the text or is held by
    it. Items that are ``foreign`` (they name another unit) stop after the head, ``strict`` ones after a three-part number that is
    unknown, all after an unknown unit with a number. ``dim`` is a syllabus: a unit's labels fit one row.
    """
    text = F.trim(given)
    spec = F.concat(F.lit("SPEC "), _found(text, SPEC_GIVEN, 1))
    codes = [F.upper(text), F.upper(F.trim(F.split(text, ":")[0])), _found(text, THREE_PARTS), _found(text, UNIT_AND_NUMBER), _found(text, TWO_PARTS), _found(text, LETTER, 1), spec]
    key = lambda u, c: F.concat_ws("\u0001", u, c)
    known = number_index(dim, unit, label, place).select(key("unit", "code").alias("key"), F.col("label").alias("__label"))
    tried = fallback_join(items.drop("label"), known, keys, [F.when(c.isNotNull(), key(F.col(unit), c)) for c in codes], "key").drop("matched_key")
    groups = letter_groups_of(dim, unit, label, place).select(F.col("unit").alias("__u"), F.col("code").alias("__c"), "held")
    tried = tried.join(groups, (F.col(unit) == F.col("__u")) & (_found(text, LETTER, 1) == F.col("__c")), "left")
    labels = dim.groupBy(F.col(unit).alias("__unit")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place), F.col(label).alias("label")))), lambda x: x["label"]).alias("__labels"))
    tried = tried.join(labels, F.col(unit) == F.col("__unit"), "left")
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(KEYWORD), F.lit(0)))
    scored = F.transform("held", lambda x: F.struct((-F.size(F.array_intersect(words(text), words(x["label"])))).alias("s"), x["place"].alias("p"), x["label"].alias("label")))
    overlap = F.array_min(scored)["label"]
    low = F.lower(text)
    within = F.get(F.filter("__labels", lambda x: F.lower(x).contains(low) | low.contains(F.lower(x))), F.lit(0))
    no = F.lit(False)
    stop = F.when(F.coalesce(foreign, no) if foreign is not None else no, 2).when((F.coalesce(strict, no) if strict is not None else no) & _found(text, THREE_PARTS).isNotNull(), 3).when(_found(text, UNIT_AND_NUMBER).isNotNull(), 4).otherwise(9)
    at = F.coalesce("matched_by", F.lit(9))
    out = F.when((at <= 6) & (at <= stop), F.col("__label")).when(stop < 9, None).when(F.col("held").isNotNull(), overlap).when(at == 7, F.col("__label")).when(text != "", within)
    return tried.withColumn("label", out).drop("matched_by", "__label", "__u", "__c", "held", "__unit", "__labels")


def classify_by_keywords(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first rule with any of its keywords in the text."""
    low, out = F.lower(text), None
    for label, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


Rule = Callable[[Column, Column], tuple[Column, Column]]


def scoped(legal: Column) -> Rule:
    """Labels of the unit only: a foreign or missing main label gives way to the first related one, else to the unit's first label."""

    def rule(main: Column, related: Column) -> tuple[Column, Column]:
        rest = F.array_distinct(F.filter(F.coalesce(related, F.array().cast("array<string>")), lambda x: F.array_contains(legal, x)))
        new = F.when(F.array_contains(legal, main), main).otherwise(F.coalesce(F.get(rest, F.lit(0)), F.get(legal, F.lit(0))))
        return new, F.filter(rest, lambda x: x != new)

    return rule


def stripped(label: str, when: Column) -> Rule:
    """A label that does not belong goes; as main label it gives way to the first related one, if there is one."""

    def rule(main: Column, related: Column) -> tuple[Column, Column]:
        rest = F.when(when, F.array_remove(related, F.lit(label))).otherwise(related)
        moved = F.coalesce(when, F.lit(False)) & (main == label) & (F.size(rest) > 0)
        return F.when(moved, F.get(rest, F.lit(0))).otherwise(main), F.when(moved, F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)

    return rule


def led_by(label: str, when: Column) -> Rule:
    """A label becomes the main one where it must, and the one before it the first related."""

    def rule(main: Column, related: Column) -> tuple[Column, Column]:
        moved = F.coalesce(when, F.lit(False)) & (main != label)
        return F.when(moved, F.lit(label)).otherwise(main), F.when(moved, F.concat(F.array(main), F.array_remove(related, F.lit(label)))).otherwise(related)

    return rule


def specific_first(generic: list[str], foundational: list[str]) -> Rule:
    """A generic main label changes places with the first related one that is not foundational."""

    def rule(main: Column, related: Column) -> tuple[Column, Column]:
        first = F.get(F.filter(related, lambda x: ~x.isin(foundational)), F.lit(0))
        moved = main.isin(generic) & first.isNotNull()
        return F.when(moved, first).otherwise(main), F.when(moved, F.concat(F.array(main), F.array_remove(related, first))).otherwise(related)

    return rule


def replaced(label: str, when: Column, by: str) -> Rule:
    """Where a text says so, a main label becomes the only related one of another."""

    def rule(main: Column, related: Column) -> tuple[Column, Column]:
        moved = F.coalesce(when, F.lit(False)) & (main == label)
        return F.when(moved, F.lit(by)).otherwise(main), F.when(moved, F.array(main)).otherwise(related)

    return rule


def consistency(main_topic: Column, main: Column, related: Column, topic: Column, subtopic: Column, topics_held: Column, subtopics_held: Column, parent: Column, *, legal: Column, known: Column, topics: Column, subject: str = "", cap: int = 1) -> Column:
    """Issue codes of a classified row against its syllabus: labels without meaning or unknown, main and related labels of another
    unit, a topic that is not the main label's parent, too many related labels or the main one among them, older fields that differ.
    ``legal`` are the labels of the row's unit, ``known`` those of all units, ``topics`` all topics. A null differs from any value."""
    rest = F.coalesce(related, F.array().cast("array<string>"))
    invalid = lambda c: c.isNull() | (F.trim(c) == "") | F.lower(F.trim(c)).isin(*INVALID_LABELS, f"general {subject}")
    missing = lambda held, c: ~F.coalesce(F.array_contains(held, c), F.lit(False))
    checks = {
        "invalid_main_topic": invalid(main_topic),
        "invalid_main": invalid(main),
        "invalid_topic": invalid(topic),
        "invalid_subtopic": invalid(subtopic),
        "unknown_main_topic": missing(topics, main_topic),
        "unknown_main": missing(known, main),
        "unknown_related": F.exists(rest, lambda x: missing(known, x)),
        "foreign_main": missing(legal, main),
        "wrong_parent": ~main_topic.eqNullSafe(parent),
        "many_related": F.size(rest) > cap,
        "main_repeated": F.exists(rest, lambda x: x.eqNullSafe(main)),
        "foreign_related": F.exists(rest, lambda x: missing(legal, x)),
        "legacy_topic": ~topic.eqNullSafe(main_topic),
        "legacy_subtopic": ~subtopic.eqNullSafe(main),
        "legacy_subtopics": ~F.coalesce(F.get(subtopics_held, F.lit(0)).eqNullSafe(main) & (F.size(subtopics_held) > 0), F.lit(False)),
        "legacy_topics": ~F.coalesce(F.get(topics_held, F.lit(0)).eqNullSafe(main_topic) & (F.size(topics_held) > 0), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(c, k) for k, c in checks.items())))


def apply_rules(df: DataFrame, main: str, related: str, rules: list[Rule], cap: int = 1) -> DataFrame:
    """Ordered rules on (main label, related labels): each reads what the one before left. Related labels end distinct, without the
    main one, and at most ``cap`` of them."""
    for rule in rules:
        new_main, new_related = rule(F.col(main), F.col(related))
        df = df.withColumns({main: new_main, related: new_related})
    return df.withColumn(related, F.slice(F.filter(F.array_distinct(related), lambda x: x != F.col(main)), 1, cap))


def promote(generic: Column) -> Rule:
    """A generic main label gives way to its first related label and becomes related itself."""

    def rule(main: Column, related: Column) -> tuple[Column, Column]:
        moved = generic & (F.size(related) > 0)
        return F.when(moved, F.get(related, F.lit(0))).otherwise(main), F.when(moved, F.concat(F.slice(related, 2, F.greatest(F.size(related) - 1, F.lit(0))), F.array(main))).otherwise(related)

    return rule
