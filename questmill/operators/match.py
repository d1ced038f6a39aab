"""Joins that a plain equality does not express: ordered fallback, as-of, nearest, range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fallback_join(left: DataFrame, right: DataFrame, left_id: list[str], candidates: list[Column], key: str) -> DataFrame:
    """Left join on the first of several candidate keys that has a match.

    Each left row offers its keys in order; one equi-join finds all matches and the best priority wins, so it costs one shuffle of
    the narrow candidate rows however many fallbacks there are. ``right`` must be unique by ``key``. Adds ``matched_by`` (1-based).
    """
    keys = F.filter(F.transform(F.array(*(F.struct(F.lit(i + 1).alias("p"), c.alias("k")) for i, c in enumerate(candidates))), lambda s: s), lambda s: s["k"].isNotNull() & (s["k"] != ""))
    offers = left.select(*left_id, F.explode(keys).alias("o")).select(*left_id, F.col("o.p").alias("matched_by"), F.col("o.k").alias(key))
    columns = [c for c in right.columns if c != key]
    hits = offers.join(right, key).groupBy(*left_id).agg(F.min(F.struct("matched_by", F.col(key).alias("matched_key"), *columns)).alias("m"))
    return left.join(hits.select(*left_id, "m.*"), left_id, "left")


def asof_join(events: DataFrame, anchors: DataFrame, by: list[str], order: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Each event takes the last anchor whose position is at most ``tolerance`` after its own, within ``by``; one sort, no pairs."""
    a = anchors.select(*by, (F.col(order) - tolerance).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    extra = [c for c in events.columns if c not in by]
    e = events.select(*by, F.col(order).alias("__at"), F.lit(1).alias("__side"), F.struct(*extra).alias("__row"))
    both = a.unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__value", F.last("__value", ignorenulls=True).over(w)).where("__side = 1").select(*by, "__row.*", F.col("__value").alias(value))


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], position: str, value: str, band: float) -> DataFrame:
    """The right row with the smallest distance within ``band``; ties take the smaller position. Positions are cut into cells of the
    band's width, so each left row meets three cells and never the whole group. Rows with
    nulls, and repeated ones, keep their match."""
    r = right.select(*by, F.floor(F.col(position) / band).alias("__cell"), F.col(position).alias("__p"), F.col(value).alias(value))
    near = left.withColumn("__cell", F.explode(F.array(*(F.floor(F.col(position) / band) + d for d in (-1, 0, 1)))))
    hit = near.join(r, [*by, "__cell"]).where(F.abs(F.col("__p") - F.col(position)) <= band)
    best = hit.groupBy(*left.columns).agg(F.min(F.struct(F.abs(F.col("__p") - F.col(position)).alias("d"), F.col("__p"), F.col(value))).alias("__m"))
    same = reduce(lambda x, y: x & y, (left[c].eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(left.columns)))
    best = best.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(left.columns)), F.col(f"__m.{value}").alias("__v"), F.col("__m.d").alias("distance"))
    return left.join(best, same, "left").select(*(left[c] for c in left.columns), F.col("__v").alias(value), "distance")


def contained_join(points: DataFrame, ranges: DataFrame, by: list[str], low: Column, high: Column, at: Column) -> DataFrame:
    """Rows of ``points`` whose position lies in a range of the same group."""
    return points.join(ranges, by).where((at >= low) & (at <= high))


def anti_any(left: DataFrame, right: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Rows without a partner under any of several key lists: one anti-join a list instead of one disjunctive join."""
    for on in keys:
        left = left.join(right.select(*on).where(" and ".join(f"{k} is not null" for k in on)).distinct(), on, "left_anti")
    return left


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], lo: str, hi: str, unit: float) -> DataFrame:
    """All pairs of intervals of one group that share a point: columns of ``left`` as they are, of ``right`` with ``right_`` before them.

    Intervals are put into cells. An interval's own level is the first whose cells, ``unit`` times a power of two wide, are as wide
    as it, so that it lies in two of them at most. A pair meets at the higher of its two levels: one side with its own cells, the
    other with its cells of that level; and of the cells that both lie in, the one that holds the later start reports it. A group
    is spread over its cells, long intervals cost no more copies than there are levels, and no pair comes twice. Rows with nulls
    have no pairs.
    """
    ready = []
    for df, head in ((left, ""), (right, "right_")):
        size = F.greatest(F.col(hi) - F.col(lo), F.lit(unit)) / F.lit(unit)
        rows = df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi))).withColumn("__own", F.ceil(F.log2(size)).cast("int"))
        ready.append((rows, head))
    highest = max((rows.agg(F.max("__own")).first()[0] or 0) for rows, _ in ready)
    copies = []
    for rows, head in ready:
        levels = rows.withColumn("__level", F.explode(F.sequence("__own", F.lit(highest))))
        wide = F.lit(unit) * F.pow(F.lit(2.0), "__level")
        first, last = F.floor(F.col(lo) / wide), F.floor(F.col(hi) / wide)
        named = [F.col(c) if c in by else F.col(c).alias(head + c) for c in rows.columns if not c.startswith("__")]
        copies.append(levels.withColumn("__cell", F.explode(F.sequence(first, last))).select(*named, first.alias(f"__from{head}"), "__cell", "__level", (F.col("__level") == F.col("__own")).alias(f"__at{head}")))
    a, b = copies
    meets = (F.col("__cell") == F.greatest("__from", "__fromright_")) & (F.col(lo) <= F.col(f"right_{hi}")) & (F.col(f"right_{lo}") <= F.col(hi))
    keys = [*by, "__cell", "__level"]
    pairs = a.where("__at").join(b, keys).unionByName(a.where("not __at").join(b.where("__atright_"), keys))
    return pairs.where(meets).drop("__cell", "__level", "__from", "__fromright_", "__at", "__atright_")
