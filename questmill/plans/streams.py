"""Streams over the events table, run to their end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..operators.ordered import fold_machine
from ..streaming.progress import distinct_events, event_stream, folded, merge_batches, windowed_counts
from ..streaming.sittings import CYCLE, FIRST, run_sittings
from .base import many, table


def shared_folder(spark) -> str:
    """A new folder that every node can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        root = tempfile.mkdtemp(prefix="questmill-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("SELECT user_id, max_by(event_type, ts) AS event_type, max_by(event_id, ts) AS event_id FROM events GROUP BY user_id")
def q_stream_progress(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = event_stream(spark, f"{sf_dir}/events.parque[t]", schema)
    folder = shared_folder(spark)
    merge_batches(stream, f"{folder}/state", f"{folder}/checkpoint", ["user_id"])
    return folded(spark, f"{folder}/state", ["user_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def q_stream_windows(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    folder = shared_folder(spark)
    counts = windowed_counts(event_stream(spark, f"{sf_dir}/events.parque[t]", schema)).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    newest = out.agg(F.max("batch").alias("b")).first()["b"]
    return out.where(F.col("batch") == newest).drop("batch")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, CAST(floor(value) AS BIGINT) AS marks, event_type = 'purchase' AS submits, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, ts, ts AS opened, CAST(1 AS BIGINT) AS answers, marks AS total, submits FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.ts, CASE WHEN f.submits OR e.ts >= f.opened + INTERVAL 10 HOUR THEN e.ts ELSE f.opened END, CASE WHEN f.submits OR e.ts >= f.opened + INTERVAL 10 HOUR THEN 1 ELSE f.answers + 1 END, CASE WHEN f.submits OR e.ts >= f.opened + INTERVAL 10 HOUR THEN e.marks ELSE f.total + e.marks END, e.submits FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, opened ORDER BY n DESC) AS r, max(n) OVER (PARTITION BY user_id) AS last FROM f)
SELECT user_id, opened, CASE WHEN submits THEN ts ELSE opened + INTERVAL 10 HOUR END AS closed, answers, total, CASE WHEN submits THEN 'submitted' ELSE 'time' END AS reason FROM g WHERE r = 1 AND (submits OR n < last OR opened + INTERVAL 10 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)""")
def q_stream_sittings(spark, sf_dir):
    """Sittings of ten hours that close by a submission or by themselves; those still open at the end of the stream are not there."""
    events = event_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)
    rows = events.select("user_id", "ts", "event_id", F.floor("value").cast("long").alias("marks"), (F.col("event_type") == "purchase").alias("submits"))
    folder = shared_folder(spark)
    closed = run_sittings(spark, rows, 600, "1 hour", f"{folder}/out", f"{folder}/checkpoint")
    return closed.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("opened", "closed")), "answers", "total", "reason")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type")
def q_stream_distinct(spark, sf_dir):
    """Events that are sent one to three times each, kept once."""
    events = event_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)
    sent = events.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))))
    folder = shared_folder(spark)
    stream = distinct_events(sent).select("event_id", "event_type").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(f"{folder}/out").groupBy("event_type").agg(many().alias("n"), F.min("event_id").alias("first"))


STATES = [FIRST, "review", "mastered", "correct", "incorrect"]


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id % 5 AS item, event_type, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'view'),
f AS (SELECT DISTINCT user_id, item, CAST(0 AS BIGINT) AS n, 'unattempted' AS status FROM e UNION ALL SELECT e.user_id, e.item, e.n,
CASE e.event_type WHEN 'purchase' THEN 'correct' WHEN 'error' THEN 'incorrect' ELSE CASE status WHEN 'unattempted' THEN 'review' WHEN 'review' THEN 'mastered' WHEN 'incorrect' THEN 'mastered' ELSE 'unattempted' END END FROM f JOIN e ON e.user_id = f.user_id AND e.item = f.item AND e.n = f.n + 1)
SELECT user_id, item, arg_max(status, n) AS status FROM f GROUP BY user_id, item""")
def q_status_machine(spark, sf_dir):
    """The status of each item after clicks and answers: a machine of five states, folded day by day."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view'").withColumn("item", F.col("event_id") % 5)
    at = {name: k for k, name in enumerate(STATES)}
    clicks = F.array(*(F.lit(at[CYCLE.get(name, FIRST)]) for name in STATES))

    def step(now, kind):
        return F.when(kind == "purchase", at["correct"]).when(kind == "error", at["incorrect"]).otherwise(F.get(clicks, now))

    ends = fold_machine(e, ["user_id", "item"], F.to_date("ts"), ["ts", "event_id"], F.col("event_type"), len(STATES), step, name="at")
    return ends.select("user_id", "item", F.get(F.array(*map(F.lit, STATES)), F.col("at")).alias("status"))
