"""Many phrases looked for at once, and the checks of hazard labels that rest on words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curated import ALKENE_WORDS, ALKENES, EQUATIONS, FUEL_WORDS, FUELS, HAZARD, HAZARD_ASKED, HAZARD_WORDS, NAMES_ASKED, NAMING, NO_HAZARD, OLD_EQUATIONS

#: Characters of phrases that one automaton holds; beyond, phrases are dealt to several, with one pass over the texts for each.
MOST_CHARACTERS = 8_000_000
HITS = "array<struct<start:int,length:int,phrase:string>>"


def lowered(text: str) -> str:
    """Lower case letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def longest_first(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (start, end) spans in any order, those that reading from the left takes: at each place the longest, none over another."""
    out, at = [], 0
    for start, end in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start >= at:
            out.append((start, end))
            at = end
    return out


def find_phrases(batches: Iterator[pa.RecordBatch], phrases: list[str]) -> Iterator[pa.RecordBatch]:
    """All whole-word places of the phrases in the last column's texts, which the hits replace."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(phrase, len(phrase))
    found.make_automaton()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("phrase", pa.string())]))
    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            low, hits = lowered(text or ""), []
            for last, size in found.iter(low) if phrases else ():
                start, end = last - size + 1, last + 1
                if not (start and low[start - 1].isalnum()) and not (end < len(low) and low[end].isalnum()):
                    hits.append({"start": start, "length": size, "phrase": low[start:end]})
            out.append(hits)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], [*batch.schema.names[:-1], "hits"])


def phrase_hits(texts: DataFrame, keys: list[str], text: str, phrases: DataFrame, phrase: str, *, overlapping: bool = False, most: int = MOST_CHARACTERS) -> DataFrame:
    """(keys, hits): where each text holds phrases as whole words, letters of any case: start, length, phrase in lower case.

    One automaton finds every phrase in one pass over a text. Of hits that overlap, reading from the left takes the longest, unless
    ``overlapping``. The phrases' size is measured first; where they are more than ``most`` characters, they are dealt to as many
    automata as it takes and the hits of a text are put together. Empty and null phrases find nothing; null texts have no hits.
    """
    known = phrases.select(F.lower(F.col(phrase)).alias("p")).where("p <> ''").distinct()
    size = known.agg(F.sum(F.length("p"))).first()[0] or 0
    pieces = int(size // most) + 1
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema) + f", hits {HITS}"
    rows, out = texts.select(*keys, text), None
    for k in range(pieces):
        mine = [r["p"] for r in known.where(F.pmod(F.xxhash64("p"), F.lit(pieces)) == k).collect()]
        found = rows.mapInArrow(lambda batches, mine=mine: find_phrases(batches, mine), columns)
        out = found if out is None else out.unionByName(found)
    if pieces > 1:
        out = out.groupBy(*keys).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    placed = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (-h["length"]).alias("minus"), h["phrase"].alias("phrase"))))
    if not overlapping:
        start = F.struct(F.lit(0).alias("at"), F.slice(placed, 1, 0).alias("kept"))
        placed = F.aggregate(placed, start, lambda acc, h: F.when(h["start"] >= acc["at"], F.struct((h["start"] - h["minus"]).alias("at"), F.array_append(acc["kept"], h).alias("kept"))).otherwise(acc), lambda acc: acc["kept"])
    return out.select(*keys, F.transform(placed, lambda h: F.struct(h["start"].alias("start"), (-h["minus"]).alias("length"), h["phrase"].alias("phrase"))).alias("hits"))


def hazard_issues(unit: Column, main: Column, related: Column, foreign: Column, prompt: Column, scheme: Column) -> Column:
    """Issue codes of a classified part: labels of another unit (``foreign``), a general main label before a specific one, hazard labels
    where nothing speaks of hazards, missing hazard labels, too many related labels. Labels begin with their codes; nulls are empty."""
    rest = F.coalesce(related, F.array().cast("array<string>"))
    head = lambda label, *codes: F.coalesce(F.exists(F.array(*map(F.lit, codes)), lambda c: F.startswith(label, c)), F.lit(False))
    one, two = F.trim(F.coalesce(prompt, F.lit(""))), F.trim(F.coalesce(scheme, F.lit("")))
    both = F.trim(F.concat(one, F.lit(" "), two))
    first = unit == "Unit 1"
    is_hazard = head(main, HAZARD)
    specific = F.exists(rest, lambda r: ~head(r, EQUATIONS, OLD_EQUATIONS, HAZARD, NAMING))
    general = head(main, EQUATIONS, OLD_EQUATIONS, HAZARD, NAMING)
    held = is_hazard | F.exists(rest, lambda r: head(r, HAZARD))
    alone = general & ~specific & head(main, EQUATIONS) & first
    bleed = (
        F.when(~first, "bleed_other_unit")
        .when((both != "") & ~both.rlike(HAZARD_WORDS), "bleed_no_hazard")
        .when(~is_hazard & (one != "") & ~one.rlike(HAZARD_WORDS), "bleed_prompt")
        .when(one.rlike(NAMES_ASKED) & ~one.rlike(HAZARD_ASKED), "bleed_naming")
    )
    codes = F.array(
        F.when(foreign, "foreign_label"),
        F.when(general & specific & ~(is_hazard & first & both.rlike(HAZARD_WORDS)), "general_main"),
        F.when(alone & one.rlike(FUEL_WORDS), f"general_main {FUELS}").when(alone & one.rlike(ALKENE_WORDS), f"general_main {ALKENES}"),
        F.when(held, bleed),
        F.when(first & ~is_hazard & one.rlike(HAZARD_ASKED) & ~one.rlike(NO_HAZARD), "missing_hazard"),
        F.when(F.size(rest) > 1, "many_related"),
    )
    return F.array_compact(codes)
