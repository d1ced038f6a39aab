"""Importance resampling towards a target distribution, with hashed n-grams counted once for each distinct line.

Features are runs of one to three words, hashed to ``BUCKETS`` buckets. New lines cut a text into segments: the features of each
distinct line are computed once, stored, and multiplied by the line's occurrences, for the corpus totals as for the documents' weights; n-grams
that reach over a line's end are added document by document. A bucket's gain is the log ratio of its smoothed shares in
target and corpus; a document's weight is the sum of its features' gains. Documents are drawn without replacement by adding Gumbel noise,
which a hash of the id fixes, and taking the highest scores.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import global_rank, map_arrow, pick, stash

BUCKETS = 10_000
#: A line with more than this share of all lines is hot; there can be at most 1000 of them.
HOT_SHARE = 0.001
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gram_buckets(words: list[bytes]) -> list[int]:
    """Buckets of all runs of one to three of ``words``; a longer run's checksum goes on from the shorter one's."""
    out, one, two = [], None, None
    for w in words:
        first, spaced = crc32(w), b" " + w
        out.append(first % BUCKETS)
        pair = None
        if one is not None:
            pair = crc32(spaced, one)
            out.append(pair % BUCKETS)
        if two is not None:
            out.append(crc32(spaced, two) % BUCKETS)
        one, two = first, pair
    return out


def crossing_buckets(lines: list[list[bytes]]) -> list[int]:
    """Buckets of the runs of up to three words that reach over the end of a line."""
    out, tail = [], []
    for words in lines:
        if tail and words:
            around = tail + words[:2]
            at = len(tail)
            runs = [around[at - 1 : at + 1], around[at - 1 : at + 2] if len(words) > 1 else [], around[at - 2 : at + 1] if at > 1 else []]
            out += [crc32(b" ".join(r)) % BUCKETS for r in runs if r]
        tail = (tail + words)[-2:]
    return out


def read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [x.encode() for x in batch.column(0).to_pylist()]
        found = [gram_buckets(WORD.findall(x)) for x in lines]
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(x).digest() for x in lines], pa.binary()), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["line", "times", "buckets"])


def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its distinct lines that hold a word, with their occurrences, and the buckets of runs across lines."""
    row = TaskContext.get().partitionId() << 40
    lines_type = pa.list_(pa.struct([("line", pa.binary()), ("times", pa.int64())]))
    for batch in batches:
        n_words, lines, crossing = [], [], []
        for text in batch.column(1).to_pylist():
            split = [] if text is None else text.encode().lower().split(b"\n")
            words = [WORD.findall(x) for x in split]
            n_words.append(sum(map(len, words)))
            lines.append([{"line": hashlib.md5(x).digest(), "times": n} for x, n in Counter(x for x, w in zip(split, words, strict=True) if w).items()])
            crossing.append(crossing_buckets(words))
        rows = pa.array(range(row, row + len(n_words)), pa.int64())
        row += len(n_words)
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(n_words, pa.int64()), pa.array(lines, lines_type), pa.array(crossing, pa.list_(pa.int32()))], ["row", "doc_id", "n_words", "lines", "buckets"])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of one task's rows of (times, buckets)."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        column = batch.column(1)
        sizes = np.diff(column.offsets.to_numpy())
        np.add.at(total, column.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), sizes))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def weigh(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The other columns with the number of features and the sum of their gains in place of the last one."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        running = np.concatenate([[0], np.cumsum(gains[column.flatten().to_numpy()])])
        found = [pa.array(np.diff(ends).astype(np.int64)), pa.array(running[ends[1:]] - running[ends[:-1]])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*batch.schema.names[:-1], "n", "weight"])


def distinct_lines(texts: DataFrame) -> DataFrame:
    """(line, times, buckets): every distinct line of column ``text``, A to Z in lower case, by its digest."""
    lines = texts.where("text is not null").select(F.explode(F.split(F.translate("text", UPPER, LOWER), "\n", -1)).alias("line"))
    counted = lines.where(F.col("line").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    return stash(map_arrow(counted, read_lines, "line binary, times long, buckets array<int>"))


def documents_of(texts: DataFrame) -> DataFrame:
    return stash(map_arrow(texts, read_documents, "row long, doc_id long, n_words long, lines array<struct<line:binary,times:bigint>>, buckets array<int>"))


def totals(lines: DataFrame, documents: DataFrame) -> list[int]:
    """Features in each bucket: those of distinct lines times their occurrences, and those across lines. ``BUCKETS`` numbers."""
    both = lines.select("times", "buckets").union(documents.select(F.lit(1).cast("long"), "buckets"))
    counts = map_arrow(both, add_up, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * BUCKETS
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    s, t = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus, target, strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: str = "42") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    Of the N rows with at least ``least_words`` words, floor(``percent`` * N / 100) are drawn, those of the highest scores; rank counts
    them from 1, ties go to the smaller id, and the others have null. Null and empty texts have no words, no features and weight 0.
    Noise comes from ``seed`` and the id, so rows that repeat an id share it but are drawn one by one; rows without an id have the
    noise of the empty one and come first among equal scores. Other columns never reach the result; an empty table gives none; with
    an empty target all gains follow from smoothing alone.
    """
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = pick(target, text=target_text).select(F.lit(None).cast("long").alias("doc_id"), "text")
    lines, documents = distinct_lines(texts), documents_of(texts)
    gain = gains(totals(lines, documents), totals(distinct_lines(wanted), documents_of(wanted)))
    limit = HOT_SHARE * (lines.agg(F.sum("times")).first()[0] or 0)
    weighed = map_arrow(lines, weigh, "line binary, times long, n long, weight long", gains=gain)
    weighed = stash(weighed.select("line", "n", "weight", (F.col("times") > limit).alias("hot")), "hot")
    hot = F.broadcast(weighed.where("hot").drop("hot"))
    own = map_arrow(documents.select("row", "doc_id", "n_words", "buckets"), weigh, "row long, doc_id long, n_words long, n long, weight long", gains=gain)
    held = documents.select("row", F.explode("lines").alias("x")).select("row", "x.*")
    common = held.join(hot, "line")
    rare = held.join(hot.select("line"), "line", "left_anti").join(weighed.where("not hot").drop("hot"), "line")
    nothing = F.lit(None).cast("long")
    parts = [x.select("row", nothing.alias("doc_id"), nothing.alias("n_words"), (F.col("times") * F.col("n")).alias("n"), (F.col("times") * F.col("weight")).alias("weight")) for x in (common, rare)]
    judged = own.union(parts[0]).union(parts[1]).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("n").alias("n_features"), F.sum("weight").alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    judged = judged.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))
    judged = judged.withColumn("late", F.col("n_words") < least_words).withColumn("falling", -F.col("score"))
    ranked = global_rank(judged, ["late", "falling", "doc_id", "row"], "place")
    drawn = percent * documents.where(F.col("n_words") >= least_words).count() // 100
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
