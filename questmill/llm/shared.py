"""Helpers that several operators of this subpackage use: stored intermediate tables, global ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that every node can reach: ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        found = tempfile.mkdtemp(prefix="questmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, *by: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps neither recompute it nor depend on executors that were lost.
    ``by`` are columns that the table is partitioned by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """Bound what one Arrow batch holds: documents can be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def map_arrow(df: DataFrame, fn: Callable[..., Iterator[pa.RecordBatch]], schema: str | StructType, **fixed) -> DataFrame:
    """``mapInArrow`` in small batches; ``fixed`` are small arguments that travel with the function."""
    return small_batches(df).mapInArrow(partial(fn, **fixed) if fixed else fn, schema)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns under fixed names, so that extra columns with clashing names never reach an operator."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def sample_rows(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """At most ``bound`` rows, those with the smallest hash of ``keys``. Rows above a limit that follows from the count are left out
    first, so what is ordered (and carries the other columns along) is about one and a half times ``bound`` rows in all."""
    total = df.count()
    order = F.xxhash64(*keys).bitwiseAND(F.lit((1 << 63) - 1))
    if total > 2 * bound:
        df = df.where(order < F.lit(int((1 << 63) * 1.5 * (bound + 100) / total)))
    return df.orderBy(order, *keys).limit(bound)


def global_rank(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Add a gapless 0-based position in the order of ``keys``.

    Rows are range-partitioned by the keys (a unique last key keeps equal leading keys from meeting in one task) and stored;
    only one count a partition goes to the driver. Positions are the offset of the partition plus the place within it.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = stash(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted(tuple(r) for r in at.groupBy("__part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "__part long, __start long")
    return at.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges``; a component's name is its smallest node.

    A node's label is a smaller node of its component. Each round takes the smallest label of its neighbours' labels, for the node
    and for the node that is its label (hooking), and follows labels once more (pointer jumping). Chains of 1000 nodes take 11
    rounds and of 200,000 nodes 19, in falling, rising or random order. Rounds go on until no label moves; ``max_rounds`` is for
    errors only and raises. Joins and minima only: no node's edges are gathered in one row.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stash(pairs.union(pairs.select("v", "u")).distinct())
    labels = stash(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    for _ in range(max_rounds):
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("far"))
        far = stash(labels.join(jump, "label").select("u", "label", "far"))
        near = both.join(far.select(F.col("u").alias("v"), "far"), "v").groupBy("u").agg(F.min("far").alias("near"))
        step = stash(far.join(near, "u").select("u", "label", F.least("far", "near").alias("low")))
        hook = step.groupBy(F.col("label").alias("u")).agg(F.min("low").alias("hook"))
        low = F.least("low", F.coalesce("hook", "low"))
        nxt = stash(step.join(hook, "u", "left").select("u", low.alias("label"), (low < F.col("label")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        labels = nxt.drop("moved")
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"labels of connected components still move after {max_rounds} rounds")


def stretch(text: Column, order: Column, length: int) -> Column:
    """At most ``length`` characters of a text: of a longer one those from a place that ``order``, a number of the row, names."""
    start = F.pmod(order, F.greatest(F.length(text) - length, F.lit(0)) + 1).cast("int") + 1
    return F.when(F.length(text) > length, F.substr(text, start, F.lit(length))).otherwise(text)


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, or with underscores after it where a column is called so."""
    while name in taken:
        name += "_"
    return name


def named(name: str) -> Column:
    """A column by its exact name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def text_list(column: pa.Array) -> list[str]:
    """Python strings of a batch's column; null becomes the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
