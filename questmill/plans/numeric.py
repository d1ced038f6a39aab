"""Page cuts, stripes and interval pairs over events and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.match import overlap_join
from ..operators.pagecuts import Cuts, byte_values, first_stripes, page_cuts, stripe_windows
from ..registry import query
from .base import many, table

CUTS = Cuts(page=60, gap=5, shown=4, loose=4, near=2, clear=1, step=8, skip=12, lead=200)


@query("""WITH RECURSIVE r AS (SELECT user_id % 7 AS image, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) - 1 AS y, CAST(floor(value) AS BIGINT) AS ink, CAST(floor(value) AS BIGINT) % 5 < 3 AS blank FROM events),
s AS (SELECT *, sum(ink) OVER (PARTITION BY image ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS band, max(y) OVER (PARTITION BY image) + 1 AS h, CASE WHEN blank THEN y - sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY image ORDER BY y ROWS UNBOUNDED PRECEDING) END AS g FROM r),
gaps AS (SELECT image, min(y) AS a, max(y) AS b FROM s WHERE blank GROUP BY image, g),
good AS (SELECT c.image, c.y, max(b) AS b FROM s c JOIN gaps ON gaps.image = c.image AND b > c.y + 24 AND a <= c.y + 58 AND b - a >= 4 AND least(b, c.y + 60) - a >= 4 GROUP BY 1, 2),
loose AS (SELECT c.image, c.y, max(b) AS b FROM s c JOIN gaps ON gaps.image = c.image AND b > c.y + 12 AND a <= c.y + 24 AND b >= c.y AND b - a >= 3 GROUP BY 1, 2),
quiet AS (SELECT c.image, c.y, arg_min(v.y, (v.band, -v.y)) AS v FROM s c JOIN s v ON v.image = c.image AND v.y BETWEEN c.y + 24 AND least(c.h - 3, c.y + 60) GROUP BY 1, 2),
nxt AS (SELECT s.image, s.y, s.h, CASE WHEN coalesce(good.b, loose.b) IS NOT NULL THEN greatest(s.y + 8, least(s.y + 60, coalesce(good.b, loose.b) - 1)) WHEN quiet.v IS NOT NULL THEN greatest(s.y + 8, quiet.v) ELSE s.y + 60 END AS cut FROM s LEFT JOIN good USING (image, y) LEFT JOIN loose USING (image, y) LEFT JOIN quiet USING (image, y)),
f AS (SELECT image, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS cut FROM s WHERE y = 0 UNION ALL SELECT f.image, f.place + 1, n.cut FROM f JOIN nxt n ON n.image = f.image AND n.y = f.cut WHERE f.cut + 60 < n.h)
SELECT image, place, CAST(cut AS BIGINT) AS cut FROM f WHERE place > 0""")
def q_page_cuts(spark, sf_dir):
    """Users' events as rows of seven tall images."""
    w = Window.partitionBy("image").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("image", F.col("user_id") % 7).select("image", (F.row_number().over(w) - 1).alias("y"), F.floor("value").alias("ink"))
    return page_cuts(rows, CUTS, F.col("ink") % 5 < 3)


@query("""WITH v AS (SELECT page_id, list_transform(regexp_extract_all(hex(encode(html)), '..'), lambda h: CAST('0x' || h AS INTEGER)) AS b FROM pages),
s AS (SELECT page_id, top, list_transform(range(0, 100), lambda x: CASE WHEN coalesce(b[CAST(top * 100 + x + 1 AS BIGINT)], 999) < 105 AND coalesce(b[CAST((top + 3) * 100 + x + 1 AS BIGINT)], 999) < 105 THEN 1 ELSE 0 END) AS solid FROM v, (SELECT unnest([0, 4, 8]) AS top)),
w AS (SELECT page_id, top, start, list_slice(solid, start + 1, start + 80) AS x FROM s, (SELECT unnest([0, 20, 40, 60]) AS start)),
c AS (SELECT page_id, top, start, list_sum(x) AS bars, len(list_filter(range(2, len(x) + 1), lambda i: x[i] <> x[i - 1])) AS changes FROM w)
SELECT page_id, CAST(arg_min(top, top * 100 + start) AS INTEGER) AS top, CAST(arg_min(start, top * 100 + start) AS INTEGER) AS start, CAST(arg_min(bars, top * 100 + start) AS INTEGER) AS bars, CAST(arg_min(changes, top * 100 + start) AS INTEGER) AS changes FROM c WHERE bars >= 14 AND changes >= 26 GROUP BY page_id""")
def q_stripes(spark, sf_dir):
    """Pages' bytes as images 100 wide: the first window with many narrow dark columns."""
    values = table(spark, sf_dir, "pages").select("page_id", byte_values(F.encode("html", "UTF-8")).alias("values"))
    found = values.select("page_id", stripe_windows(F.col("values"), F.lit(100), dark=105, tops=range(0, 12, 4), band=range(0, 6, 3), window=80, step=20).alias("found"))
    return found.select("page_id", first_stripes(F.col("found"), 14, 26).alias("w")).where("w is not null").select("page_id", "w.*")


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + event_id % 97 * event_id % 977 * 60 AS b FROM events)
SELECT x.user_id, count(*) AS pairs, CAST(sum(least(x.b, y.b) - greatest(x.a, y.a)) AS BIGINT) AS shared, CAST(sum(x.event_id * 3 + y.event_id) AS BIGINT) AS mark FROM e x JOIN e y ON x.user_id = y.user_id AND x.a <= y.b AND y.a <= x.b WHERE x.event_type = 'view' AND y.event_type IN ('click', 'purchase') GROUP BY 1""")
def q_overlap_pairs(spark, sf_dir):
    """Views that last while the same user clicks or buys."""
    a = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", a.alias("a"), (a + i % 97 * i % 977 * 60).alias("b"))
    kept = lambda where: e.where(where).select("user_id", "event_id", "a", "b")
    pairs = overlap_join(kept("event_type = 'view'"), kept("event_type in ('click', 'purchase')"), ["user_id"], "a", "b", 600.0)
    shared = F.least("b", "right_b") - F.greatest("a", "right_a")
    return pairs.groupBy("user_id").agg(many().alias("pairs"), F.sum(shared).alias("shared"), F.sum(F.col("event_id") * 3 + F.col("right_event_id")).alias("mark"))
