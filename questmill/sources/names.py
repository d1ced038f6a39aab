"""What the file names of papers say: unit, variant and codes, by an ordered list of patterns for each subject."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RETAKE = "([ra]?)"


@dataclass(frozen=True)
class Names:
    """Patterns in order: a pattern's last group is the variant; its first the unit, unless ``unit`` fixes that. ``codes`` are the codes
    of units 1 to 6, ``unknown`` the unit and code of names that say nothing."""

    patterns: tuple[tuple[str, int | None], ...]
    codes: tuple[str, ...]
    unknown: tuple[int | None, str | None]


def _maths() -> tuple[tuple[str, int | None], ...]:
    # Forms of names, each for pure units, mechanics and statistics.
    forms = [("wma1([1-4])[-_]01", "wme01[-_]01", "wst01[-_]01", ""), ("wma1([1-4])", "wme01", "wst01", ""), (r"pure\s*mathematics\s*p([1-4])", r"mechanics\s*m1", r"statistics\s*s1", "")]
    forms += [(f"{head}p([1-4])", f"{head}m1", f"{head}s1", r"[_\s.]") for head in (r"maths[_\s-]", r"(?:qp|ms)[_\s-]", r"[_\s-]")]
    return tuple((p + RETAKE + end, unit) for *three, end in forms for p, unit in zip(three, (None, 5, 6), strict=True))


# How each subject's files are named.
SUBJECTS = {
    "chemistry": Names(
        (("wch1([1-6])[-_]01([ra]?)", None), ("wch1([1-6])([ra]?)", None), (r"[^a-z0-9]u([1-6])[\s_-]?([ra]?)[^a-z0-9]", None), (r"unit[\s_-]?([1-6])[\s_-]?([ra]?)", None), ("u([1-6])()", None)),
        tuple(f"WCH1{n}" for n in range(1, 7)),
        (None, "UNKNOWN"),
    ),
    "physics": Names(
        (("wph1([1-6])[-_]01([ra]?)", None), ("wph1([1-6])([ra]?)", None), (r"unit[\s_-]?([1-6])(?:\(wph1[1-6]\))?[\s_-]?([ra]?)", None), (r"[_\s-]u([1-6])([ra]?)[_\s.]", None)),
        tuple(f"WPH1{n}" for n in range(1, 7)),
        (1, "WPH11"),
    ),
    "mathematics": Names(_maths(), ("WMA11", "WMA12", "WMA13", "WMA14", "WME01", "WST01"), (None, None)),
}


def paper_name(file: Column, subject: str) -> Column:
    """struct<unit, variant, base_code, unit_code, paper_code> of a file name: the first pattern that fits tells unit and variant; a name that
    says unused has that variant. Names of maths papers that say nothing have nulls and no variant."""
    names, low = SUBJECTS[subject], F.lower(F.coalesce(file, F.lit("")))
    found = F.lit(None).cast("struct<unit:int,variant:string>")
    for pattern, unit in reversed(names.patterns):
        number = F.lit(unit) if unit else F.regexp_extract(low, pattern, 1).try_cast("int")
        found = F.when(low.rlike(pattern), F.struct(number.alias("unit"), F.upper(F.regexp_extract(low, pattern, 1 if unit else 2)).alias("variant"))).otherwise(found)
    unit = F.coalesce(found["unit"], F.lit(names.unknown[0]).cast("int"))
    base = F.coalesce(F.get(F.array(*map(F.lit, names.codes)), found["unit"] - 1), F.lit(names.unknown[1]))
    known = base.isNotNull()
    variant = F.when(known & low.contains("unused"), "UNUSED").otherwise(F.coalesce(found["variant"], F.lit("")))
    code = F.concat(base, F.when(variant == "UNUSED", "_UNUSED").otherwise(variant))
    return F.struct(unit.alias("unit"), variant.alias("variant"), base.alias("base_code"), code.alias("unit_code"), F.concat(base, F.lit("/01"), variant).alias("paper_code"))
