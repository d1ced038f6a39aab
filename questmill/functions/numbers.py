"""Numbers: duration, grades, normal distribution, boxes, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exam_minutes(marks: Column, maths: Column, practical: Column, physics_practical: Column) -> Column:
    """Minutes for a paper: maths 1.2 a mark; 80 marks 90, 90 marks 105; 50 marks, or within two of it for a practical, 75 (physics
    practicals 80); else 1.15 a mark. Rounded half up; 0 for no marks."""
    near = (marks == 50) | (practical & (F.abs(marks - 50) <= 2))
    science = F.when(marks == 80, 90).when(marks == 90, 105).when(near, F.when(physics_practical, 80).otherwise(75)).otherwise(F.round(marks * 1.15).cast("int"))
    return F.when(marks <= 0, 0).when(maths, F.round(marks * 1.2).cast("int")).otherwise(science)


def format_minutes(m: Column) -> Column:
    """0m, 45m, 1h, 1h 15m."""
    h, r = F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int")
    return F.when(h == 0, F.concat(r.cast("string"), F.lit("m"))).when(r == 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.concat(h.cast("string"), F.lit("h "), r.cast("string"), F.lit("m")))


# Least percentage of each grade.
GRADES = [(85, "A*"), (75, "A"), (65, "B"), (55, "C"), (45, "D"), (35, "E")]


def grade(earned: Column, most: Column) -> Column:
    percent = F.when(most > 0, earned * 100.0 / most)
    out = F.when(percent.isNull(), "Ungraded")
    for least, name in GRADES:
        out = out.when(percent >= least, name)
    return out.otherwise("U")


def normal_cdf(z: Column) -> Column:
    """Cumulative standard normal to four places: Abramowitz and Stegun 26.2.17; 1 from 3.9 on, and symmetric."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 1 - 0.3989422804014327 * F.exp(-a * a / 2) * poly
    value = F.when(a >= 3.9, F.lit(1.0)).otherwise(upper)
    return F.round(F.when(z < 0, 1 - value).otherwise(value), 4)


def overlap_share(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Common length over the shorter length, which counts as 0.001 at least; 0 if apart."""
    common = F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))
    return common / F.greatest(F.lit(0.001), F.least(hi_a - lo_a, hi_b - lo_b))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, at most 100; 0 of nothing."""
    return F.when(whole > 0, F.least(F.lit(100.0), F.round(part * 100.0 / whole, 2))).otherwise(F.lit(0.0))
