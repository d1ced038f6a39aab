"""Cuts, stripes and interval pairs against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from questmill.operators.match import overlap_join
from questmill.operators.pagecuts import Cuts, byte_values, first_stripes, page_cuts, stripe_windows


def test_pairs_of_intervals(spark):
    rng = random.Random(4)

    def side(n):
        rows = [(rng.choice("ab"), k, (lo := rng.uniform(-50, 50)), lo + rng.choice([0, 0.5, 3, 40, 700])) for k in range(n)]
        return rows + [("a", n, None, 1.0), ("a", n + 1, 2.0, None), ("b", n + 2, 5.0, 1.0), (None, n + 3, 0.0, 9.0)] + rows[:2]

    one, two = side(150), side(120)
    schema = "g string, k int, lo double, hi double"
    got = overlap_join(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), ["g"], "lo", "hi", 1.0)
    want = [(x[1], y[1]) for x in one for y in two if x[0] and x[0] == y[0] and None not in (*x, *y) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted((r.k, r.right_k) for r in got.collect()) == sorted(want)
    assert overlap_join(spark.createDataFrame(one, schema), spark.createDataFrame([], schema), ["g"], "lo", "hi", 1.0).count() == 0


def test_a_hot_group_is_spread_over_cells(spark):
    frame = spark.range(4000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("lo"), (F.col("id") + 0.5).alias("hi"))
    assert overlap_join(frame, frame, ["g"], "lo", "hi", 1.0).count() == 4000


def test_cuts(spark):
    cuts = Cuts(page=400)
    ink = [9] * 1500
    for y in [*range(330, 360), *range(600, 625), *range(940, 958), *range(1100, 1105)]:
        ink[y] = 0
    ink[1250:1255] = [1] * 5
    rows = [("tall", y, v) for y, v in enumerate(ink)] + [("low", y, 5) for y in range(300)]
    frame = spark.createDataFrame(rows, "image string, y int, ink int").repartition(3)
    got = sorted((r.image, r.place, r.cut) for r in page_cuts(frame, cuts, F.col("ink") == 0).collect())
    # the gap that ends at 359; the one that ends at 624; 940 is 18 rows high, too low for a good gap, and too far down for a loose one: the quietest band
    want, at = [], 0
    for cut in (355, 620, None, None):
        if at + 400 >= 1500:
            break
        if cut is None:
            first, last = max(at + 12, min(at + 160, at + 395)), min(1497, at + 400)
            sums = [(sum(ink[y - 2 : y + 3]), -y) for y in range(first, last + 1)]
            cut = max(at + 8, -min(sums)[1])
        at = cut
        want.append(at)
    assert got == [("tall", k + 1, c) for k, c in enumerate(want)]


@pytest.mark.parametrize("striped", [True, False])
def test_stripes(spark, striped):
    width, height = 420, 60
    line = [30 if (x // 3) % 2 == 0 and 60 <= x < 350 else 250 for x in range(width)]
    plain = [30] * 200 + [250] * (width - 200)
    raw = bytes((line if striped else plain) * height)
    frame = spark.createDataFrame([(bytearray(raw),)], "raw binary").select(byte_values(F.col("raw")).alias("v"))
    got = frame.select(first_stripes(stripe_windows(F.col("v"), F.lit(width))).alias("w")).first().w
    if not striped:
        assert got is None
        return
    bars = lambda s: [int(v < 120) for v in line[s : s + 300]]
    s = next(s for s in range(0, width - 250, 40) if sum(bars(s)) >= 40 and sum(a != b for a, b in zip(bars(s), bars(s)[1:], strict=False)) >= 45)
    assert got.asDict() == {"top": 0, "start": s, "bars": sum(bars(s)), "changes": sum(a != b for a, b in zip(bars(s), bars(s)[1:], strict=False))}
