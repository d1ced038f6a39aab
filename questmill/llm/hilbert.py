"""Shards along a Hilbert curve over several metadata dimensions.

Size (log scale), source, language and id are quantised to four bits each; a row's place on the curve through that grid comes first
in its sort key. Runs of the global order become shards, so each shard covers a compact region in every dimension and a file's
minima and maxima prune well for filters on any of them. Rows with equal texts take the place of one of them, the one with the
smallest id, and are ordered by checksum and digest of their text, so they stand together and at most a shard border parts them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import global_rank, stash

SHARDS = 8
BITS = 4


def curve_index(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of integer points, shape (points, dimensions), each coordinate below 2**bits.

    Works from the highest bit down with a per-point orientation (entry corner and direction), so that consecutive indices are
    neighbouring cells.
    """
    points = np.asarray(coordinates, np.int64)
    n, dims = points.shape
    mask = (1 << dims) - 1
    entry, direction, index = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def turn_right(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        by = by % dims
        return ((x >> by) | (x << (dims - by))) & mask

    def turn_left(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return turn_right(x, dims - by % dims)

    def gray(x: np.ndarray) -> np.ndarray:
        return x ^ (x >> 1)

    for bit in range(bits - 1, -1, -1):
        corner = np.zeros(n, np.int64)
        for d in range(dims):
            corner |= ((points[:, d] >> bit) & 1) << d
        seen = turn_right(corner ^ entry, direction + 1)
        word = seen.copy()
        shift = 1
        while shift < dims:
            word ^= word >> shift
            shift *= 2
        index = (index << dims) | word
        start = np.where(word == 0, 0, gray(2 * ((word - 1) // 2)))
        entry ^= turn_left(start, direction + 1)
        odd = np.where(word % 2 == 0, word - 1, word)  # its trailing ones give the axis travelled along
        ones = sum(((odd & low) == low).astype(np.int64) for low in [(2 << k) - 1 for k in range(dims)])
        direction = (direction + np.where(word == 0, 0, ones % dims) + 1) % dims
    return index


@F.pandas_udf(LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(curve_index(np.stack([x.to_numpy(np.int64) for x in (a, b, c, d)], axis=1)))


def _hashed(column: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(column.cast("string"), F.lit(""))), F.lit(1 << BITS))


def _ranked(docs: DataFrame, shards: int, id_col: str, text_col: str, source_col: str, lang_col: str, keep_row: bool) -> DataFrame:
    """Rows with shard and slot; on request with the whole input row as ``row``."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    base = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in (("doc_id", id_col), ("text", text_col), ("source", source_col), ("lang", lang_col))), *([whole] if keep_row else []))
    rows = base.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("digest"),
        _hashed(F.col("source")).alias("by_source"),
        _hashed(F.col("lang")).alias("by_lang"),
        *(["row"] if keep_row else []),
    )
    span = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, width, total = span["lo"] or 0, max(1, (span["hi"] or 0) - (span["lo"] or 0) + 1), span["n"]
    # texts that occur more than once, with the coordinates of their first row; one row a text, so a hot one is split on the other side
    place = F.struct(F.coalesce("doc_id", F.lit(lo)).alias("at"), "by_source", "by_lang")
    shared = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")
    rows = rows.join(stash(shared), "digest", "left").withColumn("first", F.coalesce("first", place))
    by_size = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.col("size").cast("double")) * 0.75)).cast("long")
    by_id = F.floor((F.col("first.at") - lo).cast("double") * (1 << BITS) / width).cast("long")
    keyed = rows.select(F.coalesce("doc_id", F.lit(-1)).alias("__id"), "doc_id", "size", "text_crc32", "digest", _curve(by_size, "first.by_source", "first.by_lang", by_id).alias("curve"), *(["row"] if keep_row else []))
    ranked = global_rank(keyed, ["curve", "text_crc32", "digest", "__id"])
    # shard s holds the ranks from ceil(s * n / shards) on
    shard = F.expr(f"(rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)


def hilbert_shards(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve): law ``rows``, shard sizes at most one row apart.

    ``size`` is the text's UTF-8 bytes plus one, ``text_crc32`` its checksum (null text: empty). Null metadata counts as the empty
    string, a null id as -1. Repeated rows each get a slot; ties in every key are broken by chance, as such rows look the same here. Other columns are ignored; an empty table gives none.
    ``curve`` is the place on the curve; min and max of it, of size and of id describe a shard to a reader that prunes.
    """
    out = _ranked(docs, shards, id_col, text_col, source_col, lang_col, keep_row=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> None:
    """Write every row of ``docs`` into one folder a shard (``shard=n``), rows in curve order within their files. Rows without an id and
    rows that repeat one are written like any other. An input column called ``shard`` is refused."""
    if "shard" in docs.columns:
        raise ValueError("documents already have a column called shard")
    placed = _ranked(docs, shards, id_col, text_col, source_col, lang_col, keep_row=True).select("row", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    dealt = placed.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    dealt.select("row.*", F.col("__shard").alias("shard")).write.partitionBy("shard").mode("overwrite").parquet(path)
