"""User progress from a stream of events.

Events arrive as files; a watermark bounds the state. Statuses, bookmarks and answers are folded per micro-batch and merged into a
table by key, so replays of a batch change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import latest


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events as a stream with a proper event time; ``path`` is a folder, or one file as a pattern, which Spark lists as a folder."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling counts and sums per event type; windows close after the watermark."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def distinct_events(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def merge_batches(stream: DataFrame, target: str, checkpoint: str, keys: list[str], every: int = 16) -> None:
    """Fold each batch to the last event a key and add it to the Parquet folder ``target`` as ``delta=<batch>``.

    A batch writes only its own keys. After ``every`` batches the deltas since the last full state are folded into ``full=<batch>``,
    so that the cost of a batch does not grow with the state. A batch that is run again writes the same folders again; folders
    that were not committed are passed over.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch, keys, ["ts"], "event_type", "event_id", "ts").write.mode("overwrite").parquet(f"{target}/delta={number}")
        if (number + 1) % every == 0:
            folded(spark, target, keys, number).write.mode("overwrite").parquet(f"{target}/full={number}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _committed(spark: SparkSession, target: str, kind: str) -> list[int]:
    """Numbers of the folders of one kind whose write was completed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in files.globStatus(path(target, f"{kind}=*/_SUCCESS")) or [])


def folded(spark: SparkSession, target: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """The state: the newest full folder before ``upto`` and the deltas after it, the last event of each key."""
    fulls = [n for n in _committed(spark, target, "full") if upto is None or n < upto]
    since = fulls[-1] if fulls else -1
    parts = [f"{target}/full={since}"] * bool(fulls) + [f"{target}/delta={n}" for n in _committed(spark, target, "delta") if n > since and (upto is None or n <= upto)]
    return latest(spark.read.parquet(*parts), keys, ["ts"], "event_type", "event_id", "ts")
