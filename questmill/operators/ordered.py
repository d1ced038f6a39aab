"""Operators that need an order: carry-forward, islands, gates, neighbours, ranks, round robin."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def running_max(df: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """A state that never goes back."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(value).over(w))


def before_cutoff(df: DataFrame, by: list[str], order: list, cut: Column) -> DataFrame:
    """Rows of a group before the first that is a delimiter."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__cut", F.max(cut.cast("int")).over(w)).where("__cut = 0").drop("__cut")


def islands(df: DataFrame, by: list[str], order: list, start: Column, end: Column, gap: Column, name: str = "island") -> DataFrame:
    """Number the groups of intervals that follow each other by at most ``gap``; rows come in ``order`` of their start."""
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(past)
    fresh = F.when(reach.isNull() | (start > reach + gap), 1).otherwise(0)
    return df.withColumn("__new", fresh).withColumn(name, F.sum("__new").over(run)).drop("__new")


def sequential_gate(numbers: Column) -> Column:
    """Of an ordered array, the numbers that follow the last accepted one by exactly 1, from 1 on: a fold, no window."""
    return F.aggregate(numbers, F.lit(0).cast("int"), lambda acc, x: F.when(x == acc + 1, acc + 1).otherwise(acc))


def fold_machine(df: DataFrame, by: list[str], chunk: Column, order: list, event: Column, states: int, step: Callable[[Column, Column], Column], start: int = 0, name: str = "state") -> DataFrame:
    """The state of a machine of ``states`` states (0, 1, ...) after all events of each group: (by, ``name``).

    The rows of a group are cut by ``chunk``, which never falls along ``order`` (a day, a block of numbers). A chunk's events are folded
    into one array, the state after the chunk for each state before it; a group then folds its few arrays. So a group of any size is
    spread over tasks, and no row holds more than the events of a chunk. ``step`` gives the state (int) after an event.
    """
    fresh = F.sequence(F.lit(0), F.lit(states - 1))
    rows = df.select(*by, chunk.alias("__chunk"), F.struct(*order, event.alias("__event")).alias("__x"))
    folded = rows.groupBy(*by, "__chunk").agg(F.aggregate(F.array_sort(F.collect_list("__x")), fresh, lambda now, x: F.transform(now, lambda s: step(s, x["__event"]).cast("int"))).alias("__map"))
    maps = F.array_sort(F.collect_list(F.struct("__chunk", "__map")))
    return folded.groupBy(*by).agg(F.aggregate(maps, F.lit(start), lambda s, x: F.get(x["__map"], s)).alias(name))


def keep_best(df: DataFrame, by: list[str], *order) -> DataFrame:
    """One row a key, the first in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def group_rank(df: DataFrame, by: list[str], chunk: Column, order: list, name: str = "place") -> DataFrame:
    """The place of each row in its group, from 1, in ``order``, of which ``chunk`` is a part that comes first (a prefix of the key, a
    block of numbers): rows are sorted by chunk alone, and a chunk begins after the rows of the chunks before it. A group of any
    size is so spread over tasks; only a count a chunk meets in a group's window."""
    df = df.withColumn("__chunk", chunk)
    within = F.row_number().over(Window.partitionBy(*by, "__chunk").orderBy(*order))
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__chunk").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.col("__chunk").eqNullSafe(F.col("__of")))
    return df.withColumn(name, within).join(starts, same).withColumn(name, F.col("__start") + F.col(name)).select(*(c for c in df.columns if c != "__chunk"), name)


def round_robin(df: DataFrame, by: list[str], bucket: str, order: list, name: str = "turn") -> DataFrame:
    """Deal rows bucket by bucket: first each bucket's first, then each bucket's second. A row's turn follows from its place in its
    bucket and the sizes of the group's buckets, so only a count a bucket meets in one row."""
    dealt = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)))
    sizes = df.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.collect_list(F.struct(F.col(bucket).alias("b"), "n")).alias("__sizes"))
    n = F.col("__n")
    full = F.aggregate("__sizes", F.lit(0).cast("long"), lambda acc, x: acc + F.least(x["n"], (n - 1).cast("long")))
    ahead = F.size(F.filter("__sizes", lambda x: (x["n"] >= n) & (x["b"] <= F.col(bucket))))
    return dealt.join(sizes, by).withColumn(name, full + ahead).drop("__n", "__sizes")


def page_of(df: DataFrame, by: list[str], chunk: Column, order: list, size: int) -> DataFrame:
    """Position and page of each row in its sorted group; ``chunk`` as for ``group_rank``."""
    ranked = group_rank(df, by, chunk, order, "position")
    return ranked.withColumn("page", F.floor((F.col("position") - 1) / size) + 1)


def quietest(df: DataFrame, by: list[str], order: list, value: Column, before: int, after: int) -> DataFrame:
    """(by, row, band) of each group: the row around which the moving sum of ``value`` is least, the last of several."""
    band = F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-before, after))
    rows = df.withColumn("__band", band)
    last = F.max_by(F.struct(*(c for c in df.columns if c not in by)), F.struct((-F.col("__band")).alias("b"), *order))
    return rows.groupBy(*by).agg(last.alias("row"), F.min("__band").alias("band"))
