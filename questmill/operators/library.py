"""Lookups, corrections and user events around the question bank: keys with a prefix, candidate paths, errata, overrides, presets,
taxonomy search and diagnostics, answers, carts, sign-outs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_latex
from .match import fallback_join

# What a status is called.
STATUS_LABELS = {"correct": "Correct", "incorrect": "Incorrect", "review": "Review", "unattempted": "Unattempted"}
# Mark bands by subject, as name, least and most marks.
MARK_BANDS = {"mathematics": [("short", 1, 5), ("medium", 6, 9), ("long", 10, None)], "": [("short", 1, 3), ("medium", 4, 6), ("long", 7, None)]}


def status_label(status: Column) -> Column:
    """A status's name; a missing or unknown one is unattempted."""
    names = F.create_map(*(F.lit(x) for kv in STATUS_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, F.coalesce(status, F.lit(""))), F.lit(STATUS_LABELS["unattempted"]))


def mark_band(marks: Column, subject: Column) -> Column:
    """The band of a mark, by the subject's own limits."""

    def of(bands: list[tuple[str, int, int | None]]) -> Column:
        out = F.when(F.lit(False), "")
        for name, low, high in bands:
            out = out.when((marks >= low) if high is None else marks.between(low, high), name)
        return out

    out = F.when(F.lit(False), "")
    for name, bands in MARK_BANDS.items():
        out = out.when(subject == name, of(bands)) if name else out.otherwise(of(bands))
    return out


def prefix_match(answers: DataFrame, known: DataFrame, answer_id: list[str], given: Column, pattern: str, key: str = "key") -> DataFrame:
    """Answers whose key stands in ``known``; else by the prefix that ``pattern`` (one group) finds in the key; else null."""
    trimmed = F.trim(given)
    return fallback_join(answers, known, answer_id, [trimmed, F.nullif(F.regexp_extract(trimmed, pattern, 1), F.lit(""))], key)


def first_existing(rows: DataFrame, files: DataFrame, row_id: list[str], candidates: list[Column], path: str = "path") -> DataFrame:
    """Each row with the first of its candidate paths that ``files`` lists (``matched_key``), or null."""
    return fallback_join(rows, files.select(path).distinct(), row_id, candidates, path)


def apply_errata(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries (paper, cid, mark) under corrected keys. A rule (paper, place, ms_cid, qp_cid, mark_hint, override_mark) applies to the
    entry of its old key; it may set the mark, and moves the entry to the new key if the mark agrees with the hint. An entry that
    has the new key already stays, and the moved one is dropped; of two moved to one key the earlier rule's stays."""
    r = rules.select("paper", F.col("ms_cid").alias("cid"), "place", "qp_cid", "mark_hint", "override_mark")
    joined = entries.join(r, ["paper", "cid"], "left").withColumn("mark", F.coalesce("override_mark", "mark"))
    moved = F.col("qp_cid").isNotNull() & (F.col("qp_cid") != F.col("cid")) & (F.col("mark_hint").isNull() | (F.col("mark") == F.col("mark_hint")))
    to = joined.select("paper", F.when(moved, F.col("qp_cid")).otherwise(F.col("cid")).alias("to"), F.when(moved, F.col("place")).otherwise(-1).alias("place"), "cid", "mark")
    best = to.groupBy("paper", "to").agg(F.min(F.struct("place", "cid", "mark")).alias("m"))
    return best.select("paper", F.col("to").alias("cid"), F.col("m.mark").alias("mark"), (F.col("m.place") >= 0).alias("moved"))


def with_overrides(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """Curated values by key win over what the rules gave."""
    o = overrides.select(key, F.col(column).alias("__curated"))
    return df.join(o, key, "left").withColumn(column, F.coalesce("__curated", column)).drop("__curated")


def preset_pool(questions: DataFrame, presets: DataFrame, families: list[str]) -> DataFrame:
    """Questions of each preset (preset, unit_code): by the unit code itself, or by ``Unit n`` for a code whose family (all but the
    last character) is listed. One equi-join on the codes that a question answers to."""
    digit = F.regexp_extract("unit", r"^Unit ([0-9])", 1)
    by_name = [F.when(digit != "", F.concat(F.lit(f), digit)) for f in families]
    codes = F.array_distinct(F.array_compact(F.array(F.upper("unit_code"), *by_name)))
    return questions.withColumn("__code", F.explode(codes)).join(presets.select("preset", F.upper("unit_code").alias("__code")), "__code").drop("__code")


def taxonomy_search(dim: DataFrame, topic: str, child: str, term: str) -> DataFrame:
    """All children of a topic whose name holds the term, and else the children that hold it; an empty term asks for nothing."""
    low = term.strip().lower()
    return dim.where(F.lower(topic).contains(low) | F.lower(child).contains(low)) if low else dim


def primary_first(main: Column, wanted: list[str]) -> list[Column]:
    """Sort key before all others: rows whose main subtopic is one of those chosen; none where nothing is chosen."""
    return [F.when(main.isin(wanted), 0).otherwise(1)] if wanted else []


def active_first(subject: Column, active: str) -> list[Column]:
    return [F.when(subject == active, 0).otherwise(1)]


def reading_order(x: Column, y: Column, middle: float) -> list[Column]:
    """Left column before right, then from the top, then from the left."""
    return [(x >= middle).cast("int"), y, x]


def labels_of(raw: Column) -> Column:
    """struct<main, related> from a classifier's answer: an object with both, a list whose first is the main one, or a bare text."""
    text = F.trim(raw)
    shaped = F.from_json(text, "struct<main: string, related: array<string>>")
    items = F.from_json(text, "array<string>")
    none = F.array().cast("array<string>")
    main = F.when(text.startswith("{"), shaped["main"]).when(text.startswith("["), F.get(items, F.lit(0))).otherwise(text)
    rest = F.when(text.startswith("{"), shaped["related"]).when(text.startswith("["), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))))
    return F.struct(F.nullif(main, F.lit("")).alias("main"), F.coalesce(rest, none).alias("related"))


def diagnose(main: Column, related: Column, legal: Column, generic: list[str]) -> Column:
    """Issue codes of a classified question: labels not of its unit, a generic main label although a related one is specific, more than
    one related label, a repeated one, the main one again among them."""
    none = F.array().cast("array<string>")
    rest, ok = F.coalesce(related, none), F.coalesce(legal, none)
    specific = F.exists(rest, lambda x: ~x.isin(generic) & F.array_contains(ok, x))
    checks = {
        "foreign_main": ~F.array_contains(ok, main),
        "foreign_related": F.exists(rest, lambda x: ~F.array_contains(ok, x)),
        "generic_main": main.isin(generic) & specific,
        "many_related": F.size(rest) > 1,
        "repeated_related": F.size(F.array_distinct(rest)) < F.size(rest),
        "main_repeated": F.array_contains(rest, main),
    }
    return F.array_compact(F.array(*(F.when(c, k) for k, c in checks.items())))


def prefix_collisions(dim: DataFrame, unit: str, label: str, head: Column) -> DataFrame:
    """Heads (codes, first words) that stand for more than one label of a unit."""
    rows = dim.select(F.col(unit).alias("unit"), head.alias("head"), F.col(label).alias("label")).distinct()
    return rows.groupBy("unit", "head").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first")).where("n > 1")


def own_text(existing: Column, parsed: Column, parent: Column, has_sub: Column) -> Column:
    """The longer of a question's stored and parsed text; its parent's if both are empty and it is no sub-part."""
    a, b = F.coalesce(existing, F.lit("")), F.coalesce(parsed, F.lit(""))
    return F.when((a != "") & (F.length(a) > F.length(b)), a).when((b == "") & ~has_sub, F.coalesce(parent, F.lit(""))).otherwise(b)


def page_span(height: Column, page: float) -> Column:
    """Pages that a picture covers: half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(height / page).cast("int"))


def countdown(seconds: Column) -> Column:
    """h:mm:ss, never below zero."""
    s = F.greatest(F.lit(0), seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))


def without_phantoms(df: DataFrame, text: Column, section: Column, real: Column) -> DataFrame:
    """Rows less those that hold no word, outside section A, unless they are known to be real."""
    return df.where(text.rlike("[A-Za-z]{2,}") | (section == "A") | real)


def answered(events: DataFrame, keys: list[str], order: list[str], answer: str, correct: str) -> DataFrame:
    """State after answer events: (keys, answer, status). A blank answer resets both; one that was not judged keeps the status."""
    given = F.trim(F.col(answer))
    at = F.struct(*order)
    blank = given == ""
    status = F.when(blank, "unattempted").when(F.col(correct), "correct").when(~F.col(correct), "incorrect")
    rows = events.select(*keys, at.alias("at"), F.when(~blank, given).alias("given"), status.alias("effect"))
    out = rows.groupBy(*keys).agg(F.max_by("given", "at").alias("answer"), F.max_by("effect", F.when(F.col("effect").isNotNull(), F.col("at"))).alias("status"))
    return out.select(*keys, "answer", F.coalesce("status", F.lit("unattempted")).alias("status"))


def after_sign_out(state: DataFrame, events: DataFrame, user: str, at: str) -> DataFrame:
    """State rows that are newer than their user's last sign-out (user, at)."""
    last = events.groupBy(user).agg(F.max(at).alias("__out"))
    return state.join(last, user, "left").where(F.col("__out").isNull() | (F.col(at) > F.col("__out"))).drop("__out")


def carts(events: DataFrame, user: str, item: str, order: list[str], added: Column) -> DataFrame:
    """(user, item, place) after events that add and remove: an item stands where it was added last after it was removed; adding what
    is there already changes nothing."""
    rows = events.select(user, item, F.struct(*order).alias("at"), added.alias("added"))
    w = Window.partitionBy(user, item).orderBy("at")
    fresh = rows.withColumn("fresh", F.col("added") & ~F.coalesce(F.lag("added").over(w), F.lit(False)))
    last = fresh.groupBy(user, item).agg(F.max_by("added", "at").alias("held"), F.max(F.when(F.col("fresh"), F.col("at"))).alias("since")).where("held")
    return last.select(user, item, F.row_number().over(Window.partitionBy(user).orderBy("since")).alias("place"))


def unfenced(raw: Column) -> Column:
    """A text without the marks of a code block around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def answers_of(raw: Column, element: str, field: str = "questions") -> Column:
    """array of ``element`` (a DDL type) from an answer in JSON: a list, or an object that holds one as ``field``, in a code block or not. An
    object without it is one element; what is no JSON is null."""
    text = unfenced(raw)
    listed, held, alone = F.from_json(text, f"array<{element}>"), F.from_json(text, f"struct<`{field}`:array<{element}>>"), F.from_json(text, element)
    has = F.get_json_object(text, f"$.{field}").isNotNull()
    return F.when(text.startswith("["), listed).when(has, held[field]).when(text.startswith("{") & F.get_json_object(text, "$").isNotNull(), F.array(alone))


def search_tables(tables: dict[str, tuple[DataFrame, Column, list[Column], list[Column]]], wanted: str) -> DataFrame:
    """(table, key) of the rows of several lookup tables that hold a text: each table with its key, the columns to look into, and
    columns of formulas, which are compared without their markup. An empty text finds every row."""
    low = wanted.strip().lower()
    plain = re.sub(r"\\[a-z]+|[{}$^_\\\s]", "", low)
    out = None
    for name, (df, key, columns, formulas) in tables.items():
        hit = F.lit(low == "")
        for c in columns:
            hit = hit | F.coalesce(F.lower(c.cast("string")).contains(low), F.lit(False))
        for c in formulas:
            hit = hit | F.coalesce(F.regexp_replace(F.lower(strip_latex(c)), r"\s+", "").contains(plain), F.lit(False)) & F.lit(plain != "")
        rows = df.where(hit).select(F.lit(name).alias("table"), key.cast("string").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


def tab_to_show(counts: dict[str, int], active: str) -> str:
    """The active table where a search finds something in it, else the first one where it does, else the active one."""
    return active if counts.get(active) else next((name for name, n in counts.items() if n), active)
