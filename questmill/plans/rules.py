"""Hierarchy rules over parts: types are units, brands their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rules import Rule, apply_rule_table, rule_rows
from ..registry import query
from .base import table

RULES = [
    Rule("ECONOMY", "swap", mains=("Brand#1", "Brand#2"), bars=("Brand#15", "Brand#22"), prompt_lacks=("(?i)red|blue",), group="one"),
    Rule("ECONOMY", "turn", "Brand#5", mains=("Brand#1", "Brand#3"), prompt_has=("[gz]e",), given=True, group="one"),
    Rule("*", "yield", mains=("Brand#3", "Brand#4"), picks=("Brand#1", "Brand#7"), text_has=("(?i)ring|gear|SMALL",)),
    Rule("SMALL", "lead", "Brand#7", prompt_has=("bolt|widget",), prompt_lacks=("hot",), given=True),
    Rule("*", "add", "Brand#9", mains=("Brand#1", "Brand#8"), absent=("Brand#24",), text_lacks=("cold",), least=16),
    Rule("LARGE", "remove", picks=("Brand#1",), needs=("Brand#2",), least=15, short=True, text_has=("LARGE",)),
    Rule("PROMO", "become", "Brand#6", mains=("Brand#2",), prompt_has=("e",)),
    Rule("*", "remove", picks=("Brand#25", "Brand#9"), text_has=("ECON|PRO",)),
    Rule("MEDIUM", "swap", picks=("Brand#12", "Brand#2"), group="two"),
    Rule("MEDIUM", "yield", group="two"),
]


def _sql(value) -> str:
    if isinstance(value, tuple):
        return "CAST([" + ", ".join(map(_sql, value)) + "] AS VARCHAR[])"
    return f"'{value}'" if isinstance(value, str) else str(value).upper()


FIELDS = "unit act label mains needs absent picks bars prompt_has prompt_lacks text_has text_lacks given least short group".split()
TABLE = "(VALUES " + ", ".join(f"({k}, " + ", ".join(_sql(getattr(r, f)) for f in FIELDS) + ")" for k, r in enumerate(RULES)) + ") AS v(place, " + ", ".join(f + "_" if f == "group" else f for f in FIELDS) + ")"
BEGINS = "len(list_filter({heads}, lambda p: starts_with({label}, p))) > 0"
HOLDS = "len(list_filter(related, lambda x: len(list_filter({heads}, lambda p: starts_with(x, p))) > 0)) > 0"
EVERY, NONE = "len(list_filter({p}, lambda p: NOT regexp_matches({t}, p))) = 0", "len(list_filter({p}, lambda p: regexp_matches({t}, p))) = 0"
RULE_SQL = f"""WITH RECURSIVE dim AS (SELECT DISTINCT p_type AS unit, p_brand AS label FROM part WHERE p_size > 35), legal AS (SELECT unit, list(label ORDER BY label) AS legal FROM dim GROUP BY unit), rules AS (SELECT * FROM {TABLE}),
own AS (SELECT l.unit AS of, row_number() OVER (PARTITION BY l.unit ORDER BY place) AS n, r.* FROM legal l JOIN rules r ON r.unit IN (l.unit, '*')),
i AS (SELECT p_partkey AS part, p_type AS unit, p_brand AS given_main, ['Brand#' || (p_partkey % 25 + 1), 'Brand#' || (p_size % 25 + 1), 'Brand#' || (p_partkey % 7 + 1)] AS given_related, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END AS prompt, trim(CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END || ' ' || p_type) AS txt FROM part),
a AS (SELECT i.*, legal, list_distinct_ordered AS rest FROM (SELECT i.*, legal, list_filter(given_related, lambda x, k: list_contains(legal, x) AND list_position(given_related, x) = k) AS list_distinct_ordered FROM i JOIN legal ON legal.unit = i.unit) i),
b AS (SELECT part, unit, prompt, txt, legal, rest, CASE WHEN list_contains(legal, given_main) THEN given_main ELSE coalesce(rest[1], legal[1]) END AS main FROM a),
f AS (SELECT part, unit, prompt, txt, legal, CAST(0 AS BIGINT) AS n, main, list_filter(rest, lambda x: x <> main) AS related, CAST([] AS VARCHAR[]) AS done FROM b
UNION ALL SELECT part, unit, prompt, txt, legal, n, CASE WHEN acts AND act NOT IN ('add', 'remove') THEN new ELSE main END, CASE WHEN NOT acts THEN related WHEN act IN ('swap', 'lead') THEN list_concat([main], list_filter(related, lambda x: x <> new)) WHEN act = 'turn' THEN [main]
 WHEN act = 'add' THEN list_concat([new], related) WHEN act = 'remove' THEN list_filter(related, lambda x: NOT {BEGINS.format(heads="picks", label="x")}) ELSE list_filter(related, lambda x: x <> new) END, CASE WHEN acts AND group_ <> '' THEN list_append(done, group_) ELSE done END
 FROM (SELECT *, coalesce(fits AND new IS NOT NULL AND CASE WHEN act IN ('lead', 'turn', 'become') THEN new <> main WHEN act = 'add' THEN new <> main AND NOT list_contains(related, new) ELSE TRUE END, FALSE) AS acts
  FROM (SELECT f.part, f.unit, prompt, txt, legal, o.n, main, related, done, act, picks, group_,
   CASE WHEN act IN ('swap', 'yield') THEN list_filter(related, lambda x: (len(picks) = 0 OR {BEGINS.format(heads="picks", label="x")}) AND NOT {BEGINS.format(heads="bars", label="x")})[1] WHEN act = 'remove' THEN CASE WHEN {HOLDS.format(heads="picks")} THEN main END ELSE list_filter(legal, lambda x: starts_with(x, label))[1] END AS new,
   CASE WHEN length(txt) >= least THEN {EVERY.format(p="prompt_has", t="prompt")} AND {NONE.format(p="prompt_lacks", t="prompt")} AND {EVERY.format(p="text_has", t="txt")} AND {NONE.format(p="text_lacks", t="txt")} AND (NOT given OR CASE WHEN len(prompt_has) + len(prompt_lacks) = 0 THEN txt <> '' ELSE prompt <> '' END) ELSE short END
   AND (len(mains) = 0 OR {BEGINS.format(heads="mains", label="main")}) AND (len(needs) = 0 OR {HOLDS.format(heads="needs")}) AND NOT ({HOLDS.format(heads="absent")}) AND (group_ = '' OR NOT list_contains(done, group_)) AS fits
   FROM f JOIN own o ON o.of = f.unit AND o.n = f.n + 1) x) y)
SELECT part, main, related[1] AS related FROM (SELECT part, main, list_filter(related, lambda x: x <> main) AS related, row_number() OVER (PARTITION BY part ORDER BY n DESC) AS r FROM f) WHERE r = 1
UNION ALL SELECT part, given_main, given_related[1] FROM i WHERE unit NOT IN (SELECT unit FROM legal)"""


@query(RULE_SQL)
def q_rule_table(spark, sf_dir):
    """Ten rules of every kind, those of one unit and of all, as rows."""
    part = table(spark, sf_dir, "part")
    dim = part.where("p_size > 35").select(F.col("p_type").alias("unit"), F.col("p_brand").alias("label"), F.col("p_brand").alias("place")).distinct()
    brand = lambda n: F.concat(F.lit("Brand#"), (n + 1).cast("string"))
    related = F.array(brand(F.col("p_partkey") % 25), brand(F.col("p_size") % 25), brand(F.col("p_partkey") % 7))
    prompt = F.when(F.col("p_size") % 9 != 0, F.col("p_name"))
    items = part.select(F.col("p_partkey").alias("part"), F.col("p_type").alias("unit"), F.col("p_brand").alias("main"), related.alias("related"), prompt.alias("prompt"), F.col("p_type").alias("scheme"))
    return apply_rule_table(items, rule_rows(spark, RULES), dim).select("part", "main", F.get("related", F.lit(0)).alias("related"))
