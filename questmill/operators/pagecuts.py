"""Where to cut tall images into pages, and bar codes in their tops: the numeric part, over rows of ink counts and byte arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cuts:
    """A page's height and how cuts are chosen. A gap is a run of blank rows.

    Up to ``page`` rows below the last cut lies the target. The lowest gap is taken that ends below the least cut (``lead`` rows or
    ``share`` of the page, whichever is less), begins ``near`` rows above the target or higher, is ``gap`` rows high and ``shown`` of them
    above the target; else the lowest gap further up of at least ``loose`` rows; else the quietest band of five rows. Cuts lie ``clear``
    rows above the end of their gap, at least ``step`` rows below the cut before; the search leaves ``skip`` rows free below it.
    """

    page: int
    gap: int = 20
    shown: int = 18
    loose: int = 18
    near: int = 6
    clear: int = 4
    step: int = 8
    skip: int = 12
    lead: int = 200
    share: float = 0.4


def next_cut(rows: list[tuple], at: int, height: int, cuts: Cuts) -> int:
    """The cut after ``at`` from the rows (y, band, gap_from, gap_to) between it and its target."""
    target = at + cuts.page
    least = at + min(cuts.lead, int(cuts.page * cuts.share))
    gaps = sorted({(a, b) for _, _, a, b in rows if a >= 0})
    good = [(a, b) for a, b in gaps if b > least and a <= target - cuts.near and b - a + 1 >= cuts.gap and min(b, target) - a >= cuts.shown]
    good = good or [(a, b) for a, b in gaps if b > at + cuts.skip and a <= least and b - a + 1 >= cuts.loose]
    if good:
        return max(at + cuts.step, min(target, good[-1][1] - cuts.clear))
    first, last = max(at + cuts.skip, min(least, target - cuts.near + 1)), min(height - 3, target)
    bands = [(band, -y) for y, band, _, _ in rows if first <= y <= last]
    return max(at + cuts.step, -min(bands)[1]) if bands else target


def _fold(frames: Iterator[pd.DataFrame], cuts: Cuts) -> Iterator[pd.DataFrame]:
    """Rows in order of image and y: of an image, the rows of one page are held at a time."""
    image, at, place, held, tall = None, 0, 0, [], 0
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if image is None or row.image != image:
                image, at, place, held, tall = row.image, 0, 0, [], int(row.height)
            held.append((int(row.y), row.band, int(row.gap_from), int(row.gap_to)))
            while at + cuts.page < tall and row.y >= at + cuts.page:
                at = next_cut([r for r in held if r[0] <= at + cuts.page], at, tall, cuts)
                place += 1
                out.append((image, place, at))
                held = [r for r in held if r[0] >= at]
        yield pd.DataFrame(out, columns=["image", "place", "cut"])


def page_cuts(rows: DataFrame, cuts: Cuts, blank: Column) -> DataFrame:
    """(image, place, cut) from the rows (image, y, ink) of tall images, y counted from 0; ``blank`` says which rows hold nothing.

    Each search begins at the cut before, so an image is one fold in order of y; it keeps the rows of one page in memory, however tall
    the image. Images are spread over tasks.
    """
    by, run = Window.partitionBy("image"), Window.partitionBy("image").orderBy("y")
    band = F.sum("ink").over(run.rowsBetween(-2, 2))
    rows = rows.select("image", "y", "ink", blank.alias("blank")).withColumn("band", band).withColumn("height", F.max("y").over(by) + 1)
    rows = rows.withColumn("gap", F.when(F.col("blank"), F.col("y") - F.sum(F.col("blank").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))))
    gap = Window.partitionBy("image", "gap")
    ends = [F.when(F.col("blank"), f("y").over(gap)).otherwise(-1).cast("long").alias(n) for f, n in ((F.min, "gap_from"), (F.max, "gap_to"))]
    ready = rows.select("image", "y", F.col("band").cast("double").alias("band"), *ends, "height")
    kind = dict(ready.dtypes)["image"]
    return ready.repartition("image").sortWithinPartitions("image", "y").mapInPandas(lambda frames: _fold(frames, cuts), f"image {kind}, place long, cut long")


def byte_values(raw: Column) -> Column:
    """The bytes of a binary column as numbers 0 to 255."""
    return F.transform(F.regexp_extract_all(F.hex(raw), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripe_windows(values: Column, width: Column, *, dark: int = 120, tops: range = range(0, 35, 3), band: range = range(0, 18, 3), window: int = 300, step: int = 40) -> Column:
    """array<struct<top, start, bars, changes>> of an image's grey values, row by row: in bands of rows, the columns that are dark in all of
    them (bars), counted with their changes in windows ``step`` apart. ``values`` must hold the rows of the lowest band."""
    starts = F.when(width > window - 50, F.sequence(F.lit(0), width - (window - 50) - 1, F.lit(step)))
    empty = F.struct(F.lit(0).alias("bars"), F.lit(0).alias("changes"), F.lit(-1).alias("last"))

    def windows(held: Column, top: Column) -> Column:
        value = lambda y, x: F.get(held, (y * width + x).cast("int"))
        dark_column = lambda x: F.forall(F.array(*map(F.lit, band)), lambda dy: F.coalesce(value(top + dy, x) < dark, F.lit(False))).cast("int")

        def count(solid: Column, start: Column) -> Column:
            seen = F.aggregate(F.slice(solid, start + 1, F.lit(window)), empty, lambda a, x: F.struct((a["bars"] + x).alias("bars"), (a["changes"] + F.when((a["last"] >= 0) & (a["last"] != x), 1).otherwise(0)).alias("changes"), x.alias("last")))
            return F.struct(top.alias("top"), start.cast("int").alias("start"), seen["bars"].alias("bars"), seen["changes"].alias("changes"))

        found = let(F.transform(F.sequence(F.lit(0), width - 1), dark_column), lambda solid: F.transform(starts, lambda start: count(solid, start)))
        return F.coalesce(found, F.array().cast("array<struct<top:int,start:int,bars:int,changes:int>>"))

    return let(values, lambda held: F.flatten(F.transform(F.array(*map(F.lit, tops)), lambda top: windows(held, top))))


def first_stripes(found: Column, bars: int = 40, changes: int = 45) -> Column:
    """The first window that looks like a bar code; null if none does."""
    return F.get(F.filter(found, lambda w: (w["bars"] >= bars) & (w["changes"] >= changes)), F.lit(0))
