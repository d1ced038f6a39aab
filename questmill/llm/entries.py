"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, pii
from .bpe import encode_documents
from .embed_dup import similar_vectors
from .hilbert import hilbert_shards
from .html_main import extract_pages
from .importance import resample
from .katz import score_texts
from .langid import held_out, with_language
from .near_dup import near_duplicates
from .packing import pack_documents
from .quality import with_quality
from .runs import periodic_runs
from .shared import vocabulary
from .token_edits import count_edited


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(_table(spark, sf_dir, "documents"))


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(_table(spark, sf_dir, "embeddings"))


def op7_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "quality.*")


def op8_lstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = with_language(docs.select("doc_id", "text"), langid.fit(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose crc32(doc_id) mod 10 is 0 are held out."""
    return score_texts(_table(spark, sf_dir, "documents"), held_out=F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document (by its id's crc32) is given a tail that repeats, as the contract has it; then the runs of all."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    docs = _table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), F.size(words).cast("long").alias("n"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    docs = docs.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    runs = periodic_runs(docs.select("doc_id", F.array_join(F.when(F.col("a").isNotNull(), again).otherwise(F.col("words")), " ").alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("x"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e
), walk AS (
  SELECT x AS doc_id, x AS node FROM both_ways UNION SELECT walk.doc_id, b.y FROM walk JOIN both_ways b ON walk.node = b.x
), c AS (SELECT doc_id, min(node) AS low FROM walk GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v
), e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93
), walk AS (
  SELECT x AS vec_id, x AS node FROM e UNION SELECT walk.vec_id, e.y FROM walk JOIN e ON walk.node = e.x
), c AS (SELECT vec_id, min(node) AS low FROM walk GROUP BY vec_id
), n AS (SELECT x AS vec_id, count(*) AS n FROM e GROUP BY x)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.low, t.vec_id) AS component_id, coalesce(c.low, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_minhash, op2_edited_token_counts, op3_tree_scoring, op4_hilbert_shards, op5_nnls_packing, op6_vector_tiles, op7_quality_ratio, op8_lstm_crf_pii, op9_prefix_bpe, op10_crf_language, op11_katz_scores, op12_periodic_runs, op13_segment_resampling)
    return {fn.__name__: fn for fn in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op6_vector_tiles": OP6_SQL}
