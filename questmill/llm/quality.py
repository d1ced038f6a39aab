"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

The last three characters of each word, and pairs of neighbouring words, are hashed to ``BUCKETS`` buckets. The raw corpus's multinomial counts
every document; the trusted target's counts at most ``TARGET_DOCS`` documents labelled good, those with the smallest hash of their
id. A document's score is the mean over its n-grams of log p_target - log p_raw; it is kept when the score is above ``THRESHOLD``
and the base rules hold. Scores of ordinary text lie within 0.1 of zero; markup debris and tables fall below -0.7.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import named, pick, sample_rows

BUCKETS = 1 << 14
TARGET_DOCS = 20_000
THRESHOLD = -0.2
SMOOTHING = 1.0
#: Up to so many repeated hashes of a text, their positions are looked for one by one.
FEW = 32
SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def _hashes(words: Column | str) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(words, lambda x: F.xxhash64(x))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _ending(word: Column) -> Column:
    """Bucket of a word's last three characters."""
    return _bucket(F.xxhash64(F.substring(word, -3, 3)))


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all of ``docs`` (doc_id, text) and over those whose id is in ``trusted`` (doc_id)."""
    flagged = docs.join(trusted.withColumn("trusted", F.lit(1)), "doc_id", "left").select(F.coalesce("trusted", F.lit(0)).alias("trusted"), _words(F.col("text")).alias("words"))
    rows = flagged.select("trusted", "words", F.posexplode("words").alias("at", "word"))
    pair = F.when(F.col("at") > 0, _bucket(F.xxhash64("word", F.get("words", F.col("at") - 1))))
    both = rows.select("trusted", F.explode(F.array(_ending(F.col("word")), pair)).alias("bucket")).where("bucket is not null")
    return both.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").cast("long").alias("target"))


def weights(counts: DataFrame) -> list[float]:
    """log p_target - log p_raw of every bucket, smoothed; zero everywhere when there is no target. ``BUCKETS`` numbers."""
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * BUCKETS
    a, b = sum(raw) + SMOOTHING * BUCKETS, sum(target) + SMOOTHING * BUCKETS
    return [math.log((t + SMOOTHING) / b) - math.log((r + SMOOTHING) / a) for r, t in zip(raw, target, strict=True)]


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` from ``words`` and their hashes ``grams``: positions that lie in a three-word window which the text
    holds more than once.

    Only a text with two equal window hashes is looked at. Positions of the hashes that repeat (of all, where many do) give structs
    of hash, words and position, which are sorted, so that equal windows become neighbours.
    """
    hashed = F.transform(F.slice("grams", F.lit(3), F.greatest(F.size("grams") - 2, F.lit(0))), lambda h, i: F.xxhash64(F.get("grams", i), F.get("grams", i + 1), h))
    df = df.withColumn("hashed", hashed)
    df = df.withColumn("in_order", F.when(F.size(F.array_distinct("hashed")) < F.size("hashed"), F.sort_array("hashed")))
    df = df.withColumn("often", F.array_distinct(F.filter("in_order", lambda h, i: h == F.get("in_order", i + 1))))
    every = F.sequence(F.lit(0), F.size("hashed") - 1)
    some = F.filter(every, lambda i: F.array_contains("often", F.get("hashed", i)))
    df = df.withColumn("places", F.when(F.size("often") > FEW, every).when(F.size("often") > 0, some))

    def window(i: Column) -> Column:
        return F.struct(F.get("hashed", i).alias("h"), F.get("words", i).alias("a"), F.get("words", i + 1).alias("b"), F.get("words", i + 2).alias("c"), i.alias("i"))

    df = df.withColumn("windows", F.sort_array(F.transform("places", window)))

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    again = F.filter("windows", lambda x, k: equal(x, F.get("windows", k - 1)) | equal(x, F.get("windows", k + 1)))
    df = df.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"])))
    # each such window covers three words, or as many as there are before the next one
    cover = F.aggregate(F.transform("again", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("again", k + 1) - x, F.lit(3)))), F.lit(0), lambda total, x: total + x)
    return df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).drop("hashed", "in_order", "often", "places", "windows", "again")


def with_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target_docs: int = TARGET_DOCS, name: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``labels`` has (doc_id, quality); quality 1 marks trusted documents, of which at most ``target_docs`` train the target. Null
    text: all counts 0, base rules failed, not kept. Without trusted documents every score is 0. A score equal to ``threshold`` is
    not kept. Every row is judged by itself, repeats alike, and whole however long its text is; an input column called ``name`` is
    replaced, the others pass through; an empty table stays empty.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = sample_rows(good, target_docs, "doc_id")
    corpus = pick(docs, doc_id=id_col, text=text_col).where("text is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    table = F.split(F.lit(",".join(map(repr, weights(gram_counts(corpus, trusted))))), ",").cast("array<double>")
    rows = docs.select(F.struct(*(named(c) for c in docs.columns if c != name)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", _words(F.col("text"))).withColumn("grams", _hashes("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = _repeat_words(rows)
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    n = F.size("words")
    one = F.aggregate("words", F.lit(0.0), lambda acc, w: acc + F.get(table, _ending(w)))
    pairs = F.transform(F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda w, i: F.get(table, _bucket(F.xxhash64(w, F.get("words", i)))))
    total = F.aggregate(pairs, one, lambda acc, x: acc + x)
    rows = rows.withColumn("score", F.when(n > 0, total / (2 * n - 1)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    fields = F.struct(
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "base_failed",
        "score",
        # the row number keeps a later filter on this field from being pushed below, where it would compute the counts again
        (~F.col("base_failed") & F.coalesce(F.col("score") > threshold, F.lit(False)) & (F.monotonically_increasing_id() >= 0)).alias("kept"),
    )
    return rows.select("row", fields.alias("judged")).select("row.*", F.col("judged").alias(name))
