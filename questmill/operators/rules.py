"""Hierarchy rules as rows: one ordered pass over a unit's rules decides each item's main and related labels.

A rule names labels by their beginnings, so that a code such as ``5.3:`` is enough. Its conditions are on the labels held (``mains``,
``needs``, ``absent``) and on the item's own texts (patterns of the prompt, and of prompt and scheme together); its action is one of

    swap    the first related label that fits ``picks`` and no ``bars`` leads, the main one comes first behind it
    yield   the same, and the main one goes
    lead    ``label`` leads, the main one comes first behind it
    turn    ``label`` leads and the main one is all that stays behind it
    become  ``label`` leads, the main one goes
    add     ``label`` comes first behind the main one, unless it is there
    remove  related labels that begin with any of ``picks`` go

Of the rules of one ``group`` the first that acts is the only one. Rules are data: they travel as rows, are joined by unit and read
by one fold, so that new rules need no new plan.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRINGS = "array<string>"
RULE = f"unit string, place int, act string, label string, mains {STRINGS}, needs {STRINGS}, absent {STRINGS}, picks {STRINGS}, bars {STRINGS}, prompt_has {STRINGS}, prompt_lacks {STRINGS}, text_has {STRINGS}, text_lacks {STRINGS}, given boolean, least int, short boolean, `group` string"


@dataclass(frozen=True)
class Rule:
    """One row. ``given``: the prompt must not be empty (with patterns of the whole text only: the text). ``least``: characters of
    the whole text from which patterns are read; a shorter text fails the rule or, if ``short``, passes its patterns."""

    unit: str
    act: str
    label: str = ""
    mains: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    absent: tuple[str, ...] = ()
    picks: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()
    prompt_has: tuple[str, ...] = ()
    prompt_lacks: tuple[str, ...] = ()
    text_has: tuple[str, ...] = ()
    text_lacks: tuple[str, ...] = ()
    given: bool = False
    least: int = 0
    short: bool = False
    group: str = ""


def rule_rows(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table, in their order."""
    rows = [asdict(r) | {"place": k} for k, r in enumerate(rules)]
    names = [x.strip().split()[0].strip("`") for x in RULE.split(", ")]
    return spark.createDataFrame([tuple(list(row[n]) if isinstance(row[n], tuple) else row[n] for n in names) for row in rows], RULE)


def _begins(label: Column, heads: Column) -> Column:
    return F.exists(heads, lambda h: F.startswith(label, h))


def _step(state: Column, rule: Column, legal: Column, prompt: Column, text: Column) -> Column:
    main, related, done = state["main"], state["related"], state["done"]
    none = lambda c: F.size(c) == 0
    every = lambda value, patterns: F.forall(patterns, lambda p: F.regexp_like(value, p))
    no = lambda value, patterns: ~F.exists(patterns, lambda p: F.regexp_like(value, p))
    holds = lambda heads: F.exists(related, lambda x: _begins(x, heads))
    patterns = every(prompt, rule["prompt_has"]) & no(prompt, rule["prompt_lacks"]) & every(text, rule["text_has"]) & no(text, rule["text_lacks"])
    whole = none(rule["prompt_has"]) & none(rule["prompt_lacks"])
    patterns = patterns & (~rule["given"] | F.when(whole, text != "").otherwise(prompt != ""))
    fits = F.when(F.length(text) >= rule["least"], patterns).otherwise(rule["short"])
    fits = fits & (none(rule["mains"]) | _begins(main, rule["mains"])) & (none(rule["needs"]) | holds(rule["needs"])) & ~holds(rule["absent"])
    fits = fits & ((rule["group"] == "") | ~F.array_contains(done, rule["group"]))
    act = rule["act"]
    picked = F.get(F.filter(related, lambda x: (none(rule["picks"]) | _begins(x, rule["picks"])) & ~_begins(x, rule["bars"])), F.lit(0))
    named = F.get(F.filter(legal, lambda x: F.startswith(x, rule["label"])), F.lit(0))
    new = F.when(act.isin("swap", "yield"), picked).when(act == "remove", F.when(holds(rule["picks"]), main)).otherwise(named)
    able = new.isNotNull() & F.when(act.isin("lead", "turn", "become"), new != main).when(act == "add", (new != main) & ~F.array_contains(related, new)).otherwise(True)
    acts = F.coalesce(fits & able, F.lit(False))
    without = F.filter(related, lambda x: x != new)
    kept = F.concat(F.array(main), without)
    after = (
        F.when(act.isin("swap", "lead"), kept)
        .when(act == "turn", F.array(main))
        .when(act == "add", F.concat(F.array(new), related))
        .when(act == "remove", F.filter(related, lambda x: ~_begins(x, rule["picks"])))
        .otherwise(without)
    )
    leads = F.when(acts & act.isin("swap", "yield", "lead", "turn", "become"), new).otherwise(main)
    fired = F.when(acts & (rule["group"] != ""), F.array_append(done, rule["group"])).otherwise(done)
    return F.struct(leads.alias("main"), F.when(acts, after).otherwise(related).alias("related"), fired.alias("done"))


def apply_rule_table(items: DataFrame, rules: DataFrame, dim: DataFrame, *, unit: str = "unit", main: str = "main", related: str = "related", prompt: str = "prompt", scheme: str = "scheme", cap: int = 1) -> DataFrame:
    """``items`` with their main and related labels as the rules leave them.

    ``dim`` (unit, label, place) are the labels of each unit in order. Labels of other units go first: a foreign or missing main label
    gives way to the first related one, else to the unit's first label. Then the unit's rules act in order, and of the related labels
    that are left, at most ``cap`` stay, each once and none of them the main one. Rules of the unit ``*`` hold for every unit. Items
    of a unit without labels stay as they are. Null texts are empty. A unit's labels and rules are a syllabus: they fit one row.
    """
    labels = dim.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("__legal"))
    fields = [c for c in rules.columns if c != "unit"]
    both = labels.select("unit", F.explode(F.array("unit", F.lit("*"))).alias("__of"))
    own = both.join(rules.withColumnRenamed("unit", "__of"), "__of").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("place", *(f for f in fields if f != "place")))).alias("__rules"))
    known = labels.join(own, "unit", "left").withColumnRenamed("unit", "__unit")
    rows = items.join(known, F.col(unit) == F.col("__unit"), "left")
    empty = F.array().cast(STRINGS)
    legal = F.col("__legal")
    rest = F.array_distinct(F.filter(F.coalesce(F.col(related), empty), lambda x: F.array_contains(legal, x)))
    scoped = F.when(F.coalesce(F.array_contains(legal, F.col(main)), F.lit(False)), F.col(main)).otherwise(F.coalesce(F.get(rest, F.lit(0)), F.get(legal, F.lit(0))))
    one, two = F.trim(F.coalesce(F.col(prompt), F.lit(""))), F.trim(F.coalesce(F.col(scheme), F.lit("")))
    rows = rows.withColumns({"__main": scoped, "__prompt": one, "__text": F.trim(F.concat(one, F.lit(" "), two))})
    start = F.struct(F.col("__main").alias("main"), F.filter(rest, lambda x: x != F.col("__main")).alias("related"), empty.alias("done"))
    end = F.aggregate("__rules", start, lambda state, rule: _step(state, rule, legal, F.col("__prompt"), F.col("__text")))
    rows = rows.withColumn("__end", F.when(F.col("__rules").isNull(), start).otherwise(end))
    left = F.slice(F.filter(F.array_distinct("__end.related"), lambda x: x != F.col("__end.main")), 1, cap)
    own_unit = legal.isNotNull()
    return rows.withColumns({main: F.when(own_unit, F.col("__end.main")).otherwise(F.col(main)), related: F.when(own_unit, left).otherwise(F.col(related))}).drop("__unit", "__legal", "__rules", "__main", "__prompt", "__text", "__end")
